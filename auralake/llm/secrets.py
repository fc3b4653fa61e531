"""Secret scans: base patterns, and a randomness test battery for other tokens."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tune

#: The base patterns, their kinds in order.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Runs that may be an encoded secret: long enough for the tests to have power.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: Parts of a candidate that no alphabet holds: runs of base64url, of base64, and of neither's signs.
PARTS = tuple(re.compile(f"[A-Za-z0-9{signs}]{{24,}}=*") for signs in ("_-", "+/", ""))
SHORTEST = 24

HEX_DIGITS = "0123456789abcdef"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from the smallest; a token's encoding is the first that holds all of it.
ALPHABETS = (
    ("hex", HEX_DIGITS),
    ("HEX", HEX_DIGITS.upper()),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
#: False discovery rate among a text's candidates; level, at SHORTEST characters, at which a token is found unlike random.
RATE, LEVEL = 0.001, 0.01
#: Tokens that are simulated for an alphabet and a length, and the length beyond which only the deviations shrink.
SIMULATED, LONGEST = 1_500, 256
#: Common words, of which the null model makes identifiers, paths and sentences without spaces.
WORDS = """
the and for you not with this that have from are was all can her one out day get has him his how man new now old see two way who
account action address after again allow amount answer append array assert async author backup balance before begin below between
block board border branch bridge buffer build button bytes cache call cancel capture center change channel check child class clear
client close cluster code collect color column command common compare complete config connect content context control convert copy
count country create current custom daily data database date decode default delete delivery design detail device dialog different
display document domain download driver during dynamic edit element email enable encode engine entry error event every example
execute export extra factor failure feature field file filter final first folder format forward frame function general global
""".split()


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_tail(z: float, df: int = 30) -> float:
    """Upper tail of a t distribution, by a normal approximation."""
    w = math.sqrt(df * math.log1p(z * z / df)) * (1 - 3 / (4 * df))
    return normal_tail(math.copysign(w, z))


def infer(token: str) -> str | None:
    """The alphabet of a token's encoding, without padding; None if none holds it all."""
    seen = set(token)
    return next((a for _, a in ALPHABETS if seen <= set(a)), None)


def _classes(alphabet: str) -> np.ndarray:
    return np.array([0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3 for c in alphabet])


def _vowels(alphabet: str) -> np.ndarray:
    """1 for vowels, -1 for consonants, 0 for what is no letter."""
    return np.array([0.0 if not c.isalpha() else 1.0 if c.lower() in "aeiouy" else -1.0 for c in alphabet])


def _correlation(x: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Serial correlation of the rows of x over the neighbours that both are in use."""
    n = np.maximum(use.sum(1, keepdims=True), 1)
    d = np.where(use, x - np.where(use, x, 0).sum(1, keepdims=True) / n, 0.0)
    pairs = (use[:, 1:] & use[:, :-1]).sum(1)
    var = (d**2).sum(1) / n[:, 0]
    return np.where((pairs > 0) & (var > 0), (d[:, 1:] * d[:, :-1]).sum(1) / np.maximum(pairs, 1) / np.maximum(var, 1e-12), 0.0)


def statistics(codes: np.ndarray, alphabet: str) -> np.ndarray:
    """The battery on tokens of one length (a row of symbol numbers each): chi-squared of the symbols against uniform
    ones, per character and without its mean; changes of character class per character, i.e. runs; serial correlation
    of the symbols' order; serial correlation of vowels and consonants."""
    rows, n = codes.shape
    k = len(alphabet)
    counts = np.bincount((codes + np.arange(rows)[:, None] * k).ravel(), minlength=rows * k).reshape(rows, k).astype(float)
    chi2 = (counts**2).sum(1) * k / n - n
    classes, vowels = _classes(alphabet)[codes], _vowels(alphabet)[codes]
    runs = (classes[:, 1:] != classes[:, :-1]).sum(1)
    every = np.ones(codes.shape, bool)
    return np.stack([(chi2 - (k - 1)) / n, runs / max(1, n - 1), _correlation(codes.astype(float), every), _correlation(vowels, vowels != 0)], 1)


def plain_token(r: random.Random, alphabet: str, n: int) -> str:
    """A token of the null model: words, years and counters, written as identifiers in the alphabet are."""
    if len(alphabet) == 16:
        out = ""
        while len(out) < n:
            date = f"20{r.randrange(100):02d}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"
            word = r.choice(("abc", "add", "bad", "cafe", "dead", "beef", "face", "fade", "feed"))
            out += r.choice([date, f"{r.randrange(10**6):06d}", str(r.randrange(10**9)), str(r.randrange(10)) * r.randrange(2, 9), f"{r.randrange(100):08d}", word])
        return (out if "a" in alphabet else out.upper())[:n]
    signs = [c for c in alphabet if not c.isalnum()]
    both = UPPER[0] in alphabet and LOWER[0] in alphabet
    sign = r.choice(signs) if signs else ""
    style = r.choice((str.lower, str.upper, str.title) if signs else (str.title,)) if both else str.upper if UPPER[0] in alphabet else str.lower
    numbers = r.choice((0.0, 0.1, 0.3) if both else (0.1, 0.3))
    digits = [c for c in DIGITS if c in alphabet]
    out: list[str] = []
    size = 0
    while size <= n:
        out.append("".join(r.choices(digits, k=r.choice((1, 2, 4, 4)))) if r.random() < numbers else style(r.choice(WORDS)))
        size += len(out[-1]) + len(sign)
    return sign.join(out)[:n]


@lru_cache(4096)
def _models(alphabet: str, n: int) -> tuple[np.ndarray, ...]:
    """For tokens of n characters: means and covariance of the battery over the null model's tokens, the weights that
    tell them best from random ones (a linear discriminant), means and deviations over random ones, and the sorted
    sums of squares of these, all by simulation from fixed seeds."""
    at = {c: i for i, c in enumerate(alphabet)}
    r = random.Random(f"{alphabet}:{n}")
    plain = statistics(np.array([[at[c] for c in plain_token(r, alphabet, n)] for _ in range(SIMULATED)]), alphabet)
    chance = statistics(np.random.default_rng([len(alphabet), n]).integers(0, len(alphabet), (SIMULATED, n)), alphabet)
    cov = np.cov(plain.T) + np.diag([1e-6] * 4)
    weights = np.linalg.solve(cov + np.cov(chance.T), chance.mean(0) - plain.mean(0))
    mean, sd = chance.mean(0), chance.std(0) + 1e-9
    return plain.mean(0), cov, weights, mean, sd, np.sort(_unlike((chance - mean) / sd))


def _unlike(z: np.ndarray) -> np.ndarray:
    """Sum of squares; too few repeats of symbols and too many runs are no sign of order."""
    return np.maximum(z[..., 0], 0) ** 2 + np.maximum(-z[..., 1], 0) ** 2 + (z[..., 2:] ** 2).sum(-1)


def battery(token: str, alphabet: str) -> tuple[float, float]:
    """p of the token's battery if it were of the null model's words and counters, and if it were random.

    The first is one-sided towards random: the weighted sum of the statistics is about normal under the null model;
    a t distribution's heavier tail is used. The second is the share of simulated random tokens that are as unlike
    the mean; as dependence of the tests is in both simulations, no independence is assumed.
    """
    n = len(token)
    mean, cov, weights, centre, sd, sums = _models(alphabet, n if n <= 64 else min(LONGEST, n // 16 * 16))
    at = {c: i for i, c in enumerate(alphabet)}
    x = statistics(np.array([[at[c] for c in token]]), alphabet)[0]
    shrink = math.sqrt(max(1.0, n / LONGEST))
    z = float(weights @ (x - mean)) / math.sqrt(float(weights @ cov @ weights)) * shrink
    like = 1 - np.searchsorted(sums, _unlike((x - centre) / sd * shrink)) / len(sums)
    return t_tail(z), float(like)


def discoveries(tokens: list[str]) -> list[bool]:
    """Which tokens are secrets: the battery tells them from words and counters by a Benjamini-Hochberg procedure at
    RATE over the tokens of a text, in which a token's weight is its length, and does not find them unlike random
    at a level that shrinks with length, as power grows."""
    if not tokens:
        return []
    mean = sum(map(len, tokens)) / len(tokens)
    ps: list[tuple[float, float]] = []
    for t in tokens:
        core = t.rstrip("=")
        alphabet = infer(core)
        ps.append((1.0, 0.0) if alphabet is None or len(core) < SHORTEST else battery(core, alphabet))
    weighted = [p * mean / len(t) for (p, _), t in zip(ps, tokens)]
    order = sorted(range(len(ps)), key=weighted.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if weighted[i] <= RATE * k / len(ps)), default=0)
    out = [False] * len(tokens)
    for i in order[:last]:
        out[i] = ps[i][1] >= LEVEL * SHORTEST / len(tokens[i].rstrip("="))
    return out


def parts(start: int, token: str) -> list[tuple[int, str]]:
    """A candidate as (start, token), or its parts where no alphabet holds all of it; parts may overlap."""
    if infer(token.rstrip("=")) is not None:
        return [(start, token)]
    return sorted({(start + m.start(), m[0]) for p in PARTS for m in p.finditer(token)})


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, sorted by start, then kind as in KINDS. Base kinds are always kept; added
    ones don't overlap them."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted(found)
    maybe = []
    for m in CANDIDATE.finditer(text):
        if any(s < m.end() and m.start() < e for s, e, _ in base):
            continue
        for at, t in parts(m.start(), m[0]):
            if not (t.isalpha() and (t.islower() or t[1:].islower())):  # a long word: one class of characters
                maybe.append((at, t))
    spans = {(at, at + len(t)) for (at, t), yes in zip(maybe, discoveries([t for _, t in maybe])) if yes}
    found += [(s, e, "random") for s, e in spans if not any(x <= s and e <= y and (x, y) != (s, e) for x, y in spans)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Scan every whole text of docs (doc_id, text; other columns are ignored), one row for each row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points, joined by
    commas). A null text is empty and has no spans; ids may be null or repeat. No shuffle.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in texts(b):
                spans = scan(text)
                base = [s for s in spans if s[2] != "random"]
                for c, k in zip(cols, KINDS[:3]):
                    c.append(sum(s[2] == k for s in base))
                cols[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols[4].append(listed(spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {n: pa.array(c, t) for n, c, t in zip(names, cols, kinds)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced by marks such as [hex]; null texts stay null; all columns are kept,
    whatever their names and types."""
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else redact(t, s) if (s := scan(t)) else t for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_row": b.column("_row"), "_text": pa.array(new, pa.string())})

    return rows.mapInArrow(run, rows.schema).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
