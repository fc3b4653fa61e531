"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding. It is found among the vocabulary
tokens that are suffixes of the prefix (read off a suffix automaton of the vocabulary as the word is fed through
it): the one that can follow the last token of the shorter prefix, i.e. whose border no merge would cross. The
encoding follows the back-pointers of the whole word. Encodings are memoised by word in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts, tune, wide

#: Fixed values of the vocabulary file's format: how its pre-tokenizer splits, and the mark of a word's end.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+"
WORD_END = "</w>"
#: Characters at which str.split() breaks a text but the vocabulary's white space does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: White space as the vocabulary has it.
WHITE = regex.compile(r"[^\S\x1c-\x1f]+")
LAST = 256  # added to a byte that ends its word
#: In Latin-1 texts without these, which are numbers but no digits, Python's classes are the vocabulary's.
ODD = "\u00b2\u00b3\u00b9\u00bc\u00bd\u00be" + NOT_SPACE
LATIN_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: A word's first bytes, whose table of prefixes is kept for other words that begin alike.
HEAD = 7


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, out = set(plain), []
    extra = 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class SuffixAutomaton:
    """Generalised suffix automaton of the vocabulary; each state lists the tokens whose whole string it holds."""

    def __init__(self, strings: list[tuple[tuple[int, ...], int]]) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def extend(p: int, c: int) -> int:
            q = nxt[p].get(c)
            if q is not None:
                if length[q] == length[p] + 1:
                    return q
                return split(p, c, q)
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else split(p, c, q)
            return cur

        def split(p: int, c: int, q: int) -> int:
            new = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = new
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        ends = []
        for s, token in strings:
            p = 0
            for c in s:
                p = extend(p, c)
            ends.append((s, token))
        own: dict[int, list[tuple[int, int]]] = {}
        for s, token in ends:
            p = 0
            for c in s:
                p = nxt[p][c]
            own.setdefault(p, []).append((len(s), token))
        self.next, self.link, self.length = nxt, link, length
        # The tokens of a state and of its suffix links, longest first; shared tuples where a state has none.
        order = sorted(range(len(nxt)), key=length.__getitem__)
        tokens: list[tuple] = [()] * len(nxt)
        for v in order:
            inherited = tokens[link[v]] if link[v] >= 0 else ()
            tokens[v] = (*sorted(own[v], reverse=True), *inherited) if v in own else inherited
        self.tokens = tokens


class Vocabulary:
    """A BPE vocabulary with word ends, read from the text of a tokenizer file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.name_of = {str(i): t for i, t in self.names.items()}
        chars = byte_chars()
        self.char_byte = {c: b for b, c in enumerate(chars)}
        #: rank of the merge of two tokens, and for each merged token its parts and rank
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x << 20 | y] = r
            self.parts[z] = (x, y, r)
        made = [(self.symbols(t), i) for t, i in ids.items() if i in self.parts or len(self.symbols(t)) == 1]
        # Every byte that UTF-8 has, within a word or at its end, needs a token, or a prefix could be without one.
        lacking = {b for b in range(0xF5) if b not in (0xC0, 0xC1)} | {b + LAST for b in range(0xC0)}
        lacking -= {s[0] for s, _ in made if len(s) == 1}
        if lacking:
            raise ValueError(f"the vocabulary has no token for {len(lacking)} bytes, such as {min(lacking) % LAST:#04x}")
        self.automaton = SuffixAutomaton(made)
        self.fits: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[int, int, list[int], list[int]]] = {}
        self.find = regex.compile(PIECE).findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def symbols(self, token: str) -> tuple[int, ...]:
        end = token.endswith(WORD_END) and len(token) > len(WORD_END)
        s = [self.char_byte[c] for c in (token[: -len(WORD_END)] if end else token)]
        if end:
            s[-1] += LAST
        return tuple(s)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of token while it is made, each with the rank at which it goes."""
        out, until = [(token, float("inf"))], self.parts.get(token)
        while until:
            token, rank = until[side], until[2]
            out.append((token, rank))
            until = self.parts.get(token)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b is left as it is, no merge crossing the border before both are made."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            left, right, rank = self.spine(a, 1), self.spine(b, 0), self.rank
            known = True
            for x, gone_x in left:
                for y, gone_y in right:
                    r = rank.get(x << 20 | y)
                    if r is not None and r < gone_x and r <= gone_y:  # of equal merges the leftmost comes first
                        known = False
                        break
                if not known:
                    break
            self.fits[key] = known
        return known

    def prefixes(self, word: list[int], state: int, matched: int, last: list[int], size: list[int]) -> tuple[int, int]:
        """Go on with the table of prefixes: append the unique last token, and its length, of each longer prefix."""
        auto = self.automaton
        nxt, link, length, tokens = auto.next, auto.link, auto.length, auto.tokens
        fits, compatible = self.fits.get, self.compatible
        for i, c in enumerate(word, len(last)):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                matched += 1
            token = n = 0
            for n, t in tokens[state]:
                if n > matched:
                    continue
                if i == n:
                    token = t
                    break
                before = last[i - n]
                ok = fits(before << 20 | t)
                if ok is None:
                    ok = compatible(before, t)
                if ok:
                    token = t
                    break
            last.append(token)
            size.append(n)
        return state, matched

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer: the table of its prefixes, then the back-pointers."""
        data = word.encode()
        s = list(data)
        s[-1] += LAST
        if len(s) > HEAD + 1:
            head = self.heads.get(data[:HEAD])
            if head is None:
                last, size = [0], [0]
                head = (*self.prefixes(s[:HEAD], 0, 0, last, size), last, size)
                if len(self.heads) > 100_000:
                    self.heads.clear()
                self.heads[data[:HEAD]] = head
            state, matched, last, size = head
            last, size = last.copy(), size.copy()
            self.prefixes(s[HEAD:], state, matched, last, size)
        else:
            last, size = [0], [0]
            self.prefixes(s, 0, 0, last, size)
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def normalise(self, text: str) -> str:
        """Normal form, white space as a space, lower case one by one."""
        text = WHITE.sub(" ", unicodedata.normalize("NFC", text))
        return text.lower() if text.isascii() else "".join(c.lower() for c in text)

    def pieces(self, text: str) -> list[str]:
        return self.find(self.normalise(text))


def latin_pieces(text: str) -> list[str] | None:
    """The pieces of a Latin-1 text, by Python's faster patterns; None for other texts."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if any(c in text for c in ODD) else LATIN_PIECE.findall(text.lower())


class Memo(dict):
    """A bounded memo of two generations: what was not used lately goes first."""

    def __init__(self, make, cap: int, longest: int = 64) -> None:
        self.make, self.cap, self.longest, self.old = make, cap, longest, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.cap:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


class Encoder:
    """Encodes texts to space-joined decimal ids, with a memo of words."""

    def __init__(self, text: str, cap: int = 600_000) -> None:
        self.v = Vocabulary(text)
        self.words = Memo(lambda w: " ".join(map(str, self.v.encode_word(w))), cap)

    def plain(self, text: str) -> str:
        pieces = latin_pieces(text)
        return " ".join(map(self.words.__getitem__, self.v.pieces(text) if pieces is None else pieces))

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space; strings of special tokens in the text become those tokens."""
        specials = self.v.specials
        if specials is None or not any(s in text for s in self.v.special):
            return self.plain(text)
        out, at = [], 0
        for m in specials.finditer(text):
            out += [self.plain(text[at : m.start()]), str(self.v.special[m[0]])]
            at = m.end()
        return " ".join(filter(None, [*out, self.plain(text[at:])]))

    def decode(self, ids: str) -> str:
        """The tokens' strings joined by one space, as a vocabulary file without a decoder has it."""
        return " ".join(map(self.v.name_of.__getitem__, ids.split(" "))) if ids else ""


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(text)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode whole texts and decode the ids again.

    docs: doc_id, text; other columns are ignored. Returns doc_id, ids (decimal ids joined by one space) and
    decoded. A null text is empty; an empty text has no ids and decodes to the empty string; repeated rows give
    repeated rows; a null doc_id stays null. Texts are handled one by one, so the length of one is the bound on
    memory besides the memos. The vocabulary file is read by the driver and broadcast (its size is fixed).
    """
    return _encode(docs, tokenizer_path, digests=False)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_decode() followed, in the same pass, by the digests of what it returns."""
    return _encode(docs, tokenizer_path, digests=True)


def _encode(docs: DataFrame, tokenizer_path: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = map(enc.encode, texts(b))
            if not digests:
                ids = list(ids)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.string()), "decoded": pa.array(map(enc.decode, ids), pa.string())})
                continue
            n, a, d = [], [], []
            for x in ids:
                n.append(x.count(" ") + 1 if x else 0)
                a.append(hashlib.sha256(x.encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode(x).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())})

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids string, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, out)
