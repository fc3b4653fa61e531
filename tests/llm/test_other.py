"""Chat formatting, toxicity, top-k search and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auralake.llm import chat, queries, secrets, simhash, topk, toxicity

from .fixtures import documents, rows
from .test_documents import kept_text, line_rows, row_keys, survivors

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def conversations():
    said = "<|im_end|><|im_start|>assistant ok"
    out = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", "<\\|x <|"), (2, None, None, None), (2, 0, "assistant", "  lead é😀 \n\n"), (2, 0, "assistant", "  lead é😀 \n\n")]
    out += [(3, i, "assistant" if i % 2 else "user", f"text {i} " * 3000) for i in range(60)]
    return out + [(None, 0, "assistant", "null id"), (4, 1, "sys|tem\nx\\", ""), (4, 2, "assistant", ""), (5, 1, "assistant", None)]


def test_chat(spark, monkeypatch):
    data = [(*r, "extra") for r in conversations()]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    made = chat.format_conversations(df, BYTE_BPE)
    whole = {r.conv_id: r for r in made.collect()}
    assert made.count() == 6  # a row for each conversation
    want = set()
    by = defaultdict(list)
    for c, t, role, text, _ in data:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    got = chat.read_back(made).collect()
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    tok = Tokenizer.from_file(BYTE_BPE)
    for r in made.where("conv_id in (1, 2)").collect():
        assert len(r.ids) == len(r.loss_mask) and any(r.loss_mask)
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert all(s in tok.decode([i for i, m in zip(r.ids, r.loss_mask) if m]) for s in spans)
    monkeypatch.setattr(chat, "SEGMENT", 100_000)
    cut = chat.format_conversations(df, BYTE_BPE)
    parts = sorted(cut.where("conv_id = 3").collect(), key=lambda r: r.segment)
    one = whole[3]
    assert len(parts) > 3 and "".join(p.formatted for p in parts) == one.formatted
    assert [i for p in parts for i in p.ids] == one.ids and [m for p in parts for m in p.loss_mask] == one.loss_mask
    assert [s for p in parts for s in p.loss_spans] == one.loss_spans
    assert {tuple(r) for r in chat.read_back(cut).collect()} == {tuple(r) for r in got}
    assert made.limit(0).count() == 0 and chat.format_conversations(df.limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|im_end\\|>", "a<b|c", "", "<|<|\\"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role = text + "\n|\\n\\p"
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        rank[np.flatnonzero(score == v)] = np.searchsorted(score[order], v) + (np.sum(score == v) + 1) / 2
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.9
    assert (got.predicted == got.toxic).mean() > 0.95


def test_interactions_are_learned():
    r = np.random.default_rng(3)
    x = [sorted(set(r.choice(20, 5).tolist()) | {i for i, p in ((20, 0.4), (21, 0.4)) if r.random() < p}) for _ in range(4000)]
    y = np.array([float(20 in v and 21 in v) for v in x])
    fm = toxicity.FactorizationMachine(list(range(22)), 0.0)
    fm.fit(x, y, epochs=20)
    assert ((fm.scores(x) >= 0.5) == y).mean() > 0.97


def test_toxicity_edges(spark):
    docs = documents(spark)
    for none in ([], [(3, None), (4, 7), (None, 1)], [(i, 1) for i in range(50)]):
        labels = spark.createDataFrame(none, "doc_id long, toxic int")
        got = toxicity.score(docs, labels).collect()
        assert len(got) == docs.count() and {r.predicted for r in got} == {0}
        assert toxicity.drop_toxic(docs, labels).count() == docs.count()
    labels = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows() if r[0] is not None] + [(None, 1), (3, None), (4, -1), (5, 9)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and toxicity.score(documents(spark, []), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, labels).collect())


def test_score_is_the_sum_over_pairs():
    """The machine's score by its definition: every pair of terms on its own."""
    r = np.random.default_rng(5)
    fm = toxicity.FactorizationMachine(list(range(30)), -0.3)
    fm.w, fm.v = r.normal(0, 0.5, 30), r.normal(0, 0.4, fm.v.shape)
    data = [sorted(r.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 5, 12)]
    for got, t in zip(fm.scores(data), data):
        z = fm.w0 + sum(fm.w[i] for i in t) + sum(float(fm.v[i] @ fm.v[j]) for a, i in enumerate(t) for j in t[:a])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_pairs_that_tell_only_together_are_kept(spark):
    """Two words, each as frequent in clean rows as in toxic ones, and toxic only together: through fit() and score()."""
    import random

    r = random.Random(6)
    data, labels = [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = [f"filler{r.randrange(300)}" for _ in range(8)] + ["alpha"] * a + ["omega"] * b
        r.shuffle(w)
        data.append((i, " ".join(w)))
        labels.append((i, int(a == b)))  # the exclusive or: neither word tells anything alone
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95


def test_sample_of_huge_tables_is_not_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "stage", lambda df, name: seen.append(df.count()) or df)
    toxicity.fit(docs, labels, sample=100)
    assert 50 < seen[0] < 150


def test_every_labelled_row_is_learned_from(spark):
    """A word that only rows have which a sample of 20,000 by the hash of doc_id would leave out."""
    docs = spark.range(32_000).selectExpr("id as doc_id", "shiftrightunsigned(xxhash64(id, 'sample'), 2) / shiftleft(1L, 62) > 0.8 as late", "crc32(cast(id as string)) % 5 = 0 as held", "pmod(xxhash64(id), 3) = 0 as bad")
    word = F.when(F.col("bad") & (F.col("late") | F.col("held")), "venom").otherwise("plain")
    docs = docs.select("doc_id", F.concat_ws(" ", F.concat(F.lit("filler"), F.translate(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(50)).cast("string"), "0123456789", "abcdefghij")), word).alias("text")).localCheckpoint()
    marks = docs.select("doc_id", F.col("text").contains("venom").cast("int").alias("toxic"))
    got = toxicity.score(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert got.toxic.sum() > 1000 and (got.predicted == got.toxic).all()


def test_parts_learn_what_one_model_learns(spark, monkeypatch):
    """Eight parts, averaged in several steps, of words that tell only together; the order of rows does not matter."""
    monkeypatch.setattr(toxicity, "PART", 3_200)
    monkeypatch.setattr(toxicity, "TOGETHER", 2)
    r = np.random.default_rng(6)
    words = [[f"filler{'abcdefghij'[i]}" for i in r.integers(0, 10, 4)] + ["alpha"] * int(a) + ["omega"] * int(b) for a, b in r.random((32_000, 2)) < 0.5]
    data = [(i, " ".join(w)) for i, w in enumerate(words)]
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(("alpha" in w) == ("omega" in w))) for i, w in enumerate(words)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    one, other = toxicity.fit(docs, marks), toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(3), marks.repartition(5))
    assert (one.state() == other.state()).all()


def test_mean_state_is_by_rows_of_each_term():
    a, b = np.full((3, 18), 1.0), np.full((3, 18), 4.0)
    n, got = toxicity.mean_state([(np.array([1, 0, 5]), a), (np.array([2, 0, 10]), b)])
    assert n.tolist() == [3, 0, 15] and got[:, 0].tolist() == [3.0, 1.0, 3.0]


def test_rarity_counts_every_document(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    level = simhash.rarity(docs)
    assert level.max() == 16 and (level > 0).sum() == 1  # 2 ** 15 < 40,000 <= 2 ** 16


def brute(vectors, k):
    q = {}  # by id the smallest vector, and its row
    x = {}
    for i, (d, v) in enumerate(vectors):
        if d is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x[i] = (d, [int(np.floor(1024 * float(c))) for c in v])
        if d % 100 == 0:
            q[d] = min(q.get(d, (list(v), i)), (list(v), i))
    out = set()
    for d, (v, own) in q.items():
        v = [int(np.floor(1024 * float(c))) for c in v]
        s = sorted((-sum(a * b for a, b in zip(v, w)), e) for i, (e, w) in x.items() if i != own)
        out |= {(d, n, e, -m) for n, (m, e) in enumerate(s[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "large", "odd"])
def test_top_k(spark, kind):
    r = np.random.default_rng(1)
    n = 700
    x = {"normal": r.normal(0, 0.1, (n, 32)), "ties": r.integers(-1, 2, (n, 4)) / 4, "large": r.normal(0, 3e5, (n, 3)), "odd": r.normal(0, 1, (n, 5))}[kind]
    data = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    if kind == "odd":
        data += [(None, [1.0] * 5), (900, None), (901, [None] * 5), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, []), (905, [9.0]), (906, [9.0] * 9), (100, data[7][1]), (7, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block=3)
    assert {tuple(v) for v in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(data, 10)


def test_index_stops_early():
    r = np.random.default_rng(1)
    x = topk.quantised((r.normal(0, 0.1, (5000, 64)) + r.normal(0, 0.1, (5000, 1)) * np.linspace(-1, 1, 64)).tolist())
    index = topk.Index(np.arange(5000), x)
    read, rescored = [], []
    for i in range(0, 5000, 250):
        s, at = index.search(x[i], 10)
        every = x @ x[i]
        read.append(index.read / x.size)
        rescored.append(index.rescored / len(x))
        want = np.lexsort((np.arange(5000), -every))[:10]
        assert at.tolist() == want.tolist() and s.tolist() == every[want].tolist()
    assert np.mean(read) < 0.6 and np.mean(rescored) < 0.6


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() against its five stages one by one in plain Python: pairwise scores, all pairs of lines and of texts, the
    base patterns by other means, and the library's tokenizer."""
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int("changed" in (r[1] or ""))) for r in rows() if r[0] is not None], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    fm = toxicity.fit(docs, labels)
    terms = toxicity.Terms(frozenset(fm.index))

    def toxic(text):
        t = sorted(fm.index[x] for x in terms(text or ""))
        return fm.w0 + sum(fm.w[i] for i in t) + sum(float(fm.v[i] @ fm.v[j]) for a, i in enumerate(t) for j in t[:a]) >= 0

    kept = [(r[0], r[1]) for r in rows() if not toxic(r[1])]
    stay = line_rows(kept, row_keys(docs))
    kept = [(d, kept_text(t, stay[(d, t)])) for d, t in kept]
    alive = survivors(kept)
    once = {(d, t or "") for d, t in kept if d is not None and (d, t or "") in alive}
    kept = sorted(once) + [(d, t) for d, t in kept if d is None]
    kept = [(d, secrets.redact(t or "", secrets.scan(t or ""))) for d, t in kept]
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = Counter()
    for d, t in kept:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[(d, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and not any("abcdefgh12345" in t for _, t in kept)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        df = step(spark, df, str(tmp_path))
        assert df.columns == docs.columns
