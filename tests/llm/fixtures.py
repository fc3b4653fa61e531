"""Small documents with copies, near copies, shared passages and every odd case."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("_key", T.LongType()), T.StructField("_row", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_chars", T.LongType()),
])
SYLLABLES = "th on er in ti ré ß ción an ou st ing ea ly and he de la".split()


def prose(r: random.Random, words: int) -> str:
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 5))) for _ in range(words)]
    for i in range(11, words, 23):
        out[i] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    texts = [prose(r, r.randrange(5, 160)) for _ in range(n)]
    passage = prose(r, 30).replace("\n", " ")
    texts += [texts[3]] * 6 + [texts[5] + " end"] * 2
    for i in (7, 9, 11):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[13][:40] + passage + texts[14][:50], passage + passage, "x" + passage, passage[:99], passage[1:101]]
    texts += ["", None, "   \n\n ", "a", "a" * 400, "ab" * 300, "\n".join(["same line of some words here"] * 5), "\x1c\x00\x85 \x1d", "secret: abcdefgh12345"]
    texts += ["line one of the text is long enough to compare\nzzz", "line one of the text is long enough to compara\nyyy", "tokens <|endoftext|> in <|startoftext|>text ΑΣ ß İ"]
    texts += [prose(r, 9000)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    out = [(i, t, "k", 5, "r", 0.5, len(t or "")) for i, t in zip(ids, texts)]
    out += [out[2], out[2], (None, texts[20], "k", 5, "r", None, 0), (None, None, None, None, None, None, None), (ids[4], "another text of one id", None, 1, "", 1.0, 3)]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
