"""Codes of streams and masters: variable-length integers, gain words, half-decibel codes, times, checksums."""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

#: Largest sample position or nanosecond count that a time saturates at.
LONG_MAX = 9223372036854775807
NANOS = 1_000_000_000


def zigzag(r: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(r, 1).bitwiseXOR(F.shiftright(r, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def leb128(value: Column) -> Column:
    """Hex digits of a non-negative long in seven-bit groups, lowest first, the top bit saying that more follow."""
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7).cast("int"))

    def byte(i: Column) -> Column:
        seven = F.call_function("shiftright", value, i * 7).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(seven + F.when(i < groups - 1, 128).otherwise(0)), 2, "0")

    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), byte), ""))


def gain_word(gain: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    """The word of a float-like format that is nearest to a linear gain: a signed exponent over a mantissa whose top
    bit is implied. Gains that aren't above 0, NaN included, take the lowest word; null stays null."""
    one = 1 << (mantissa_bits + 1)
    low, high = -(1 << (exponent_bits - 1)), (1 << (exponent_bits - 1)) - 1
    floor = -low << mantissa_bits
    ceiling = (high << mantissa_bits) | (one // 2 - 1)
    e = F.floor(F.log2(gain))
    m = F.round(gain / F.pow(F.lit(2.0), e + 1) * one)
    carried = m >= one
    e = e + carried.cast("int")
    m = F.when(carried, one // 2).otherwise(m) - one // 2
    code = F.pmod(e, F.lit(1 << exponent_bits)) * (1 << mantissa_bits) + m
    return F.when(F.isnan(gain) | (gain <= 0), floor).when(e > high, ceiling).when(e < low, floor).otherwise(code).cast("int")


def gain_of_word(word: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    """The linear gain that a word means."""
    half = 1 << mantissa_bits
    e = F.floor(word / half)
    e = F.when(e >= 1 << (exponent_bits - 1), e - (1 << exponent_bits)).otherwise(e)
    return F.pow(F.lit(2.0), e + 1) * (F.pmod(word, F.lit(half)) + half) / (2 * half)


def compression_db(level: Column, cut_over: float, cut_ratio: float, boost_under: float, boost_ratio: float, max_cut: float, max_boost: float) -> Column:
    """Gain of a compressor at a level: nothing between the thresholds, limited ramps outside."""
    cut = -F.least((level - cut_over) * cut_ratio, F.lit(max_cut))
    boost = F.least((boost_under - level) * boost_ratio, F.lit(max_boost))
    return F.when(level > cut_over, cut).when(level < boost_under, boost).otherwise(0.0)


def half_db_code(db: Column, lowest: float) -> Column:
    """Half decibels over lowest in a byte; NaN is 0."""
    return F.when(F.isnan(db), 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((db - lowest) * 2)))).cast("int")


def whole_db_code(amplitude: Column) -> Column:
    """Whole decibels, at most 15; null for silence, which is 0 and all under -49 dB. Negative or non-finite amplitudes fail."""
    bad = F.isnan(amplitude) | (amplitude < 0) | (amplitude == float("inf"))
    db = F.round(20 * F.log10(F.when(amplitude > 0, amplitude)))
    return F.when(bad, F.raise_error(F.concat(F.lit("a gain of "), amplitude.cast("string")))).when(db >= -49, F.least(db, F.lit(15.0))).cast("int")


def clock(seconds: Column) -> Column:
    """h:mm:ss.t, from 0."""
    t = F.round(F.greatest(seconds, F.lit(0.0)) * 10).cast("long")
    return F.format_string("%d:%02d:%02d.%d", F.floor(t / 36000), F.pmod(F.floor(t / 600), F.lit(60)), F.pmod(F.floor(t / 10), F.lit(60)), F.pmod(t, F.lit(10)))


def time_to_samples(text: Column, rate: int) -> Column:
    """Sample position of hh:mm:ss.fraction or hh:mm:ss.<n>S<d>: round half up, in wide decimals; null if it isn't a time."""
    wide = "decimal(38,0)"
    clock_part = r"^\d{1,9}:\d{2}:\d{2}"
    parts = F.split(text, "[:.S]")
    fraction = text.rlike(clock_part + r"\.\d{1,18}S\d{1,18}$")
    nanos = F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(3)), F.lit("")), 1, 9), 9, "0")
    read = F.struct(
        *[F.get(parts, F.lit(i)).try_cast("decimal(9,0)").alias(c) for i, c in enumerate("hms")],
        F.when(fraction, F.get(parts, F.lit(3))).otherwise(nanos).try_cast("decimal(18,0)").alias("n"),
        F.when(fraction, F.get(parts, F.lit(4))).otherwise(F.lit(str(NANOS))).try_cast("decimal(18,0)").alias("d"),
    )

    def samples(t: Column) -> Column:
        whole = (t["h"] * 3600 + t["m"] * 60 + t["s"]).cast(wide) * rate
        scaled = t["n"] * F.lit(rate).cast("decimal(10,0)")
        fits = scaled.cast("double") < t["d"].cast("double") * 9e18
        part = F.when(t["d"] == 0, F.lit(0).cast(wide)).when(fits, F.call_function("div", scaled * 2 + t["d"], t["d"] * 2).cast(wide)).otherwise(F.lit(LONG_MAX).cast(wide))
        return F.least(whole + part, F.lit(LONG_MAX).cast(wide)).cast("long")

    # The parts are bound to a lambda's variable, so that each is read from the text once.
    is_time = fraction | text.rlike(clock_part + r"(\.\d+)?$")
    return F.when(is_time, F.transform(F.array(read), samples)[0])


@F.pandas_udf(IntegerType())
def crc16(data: pd.Series) -> pd.Series:
    """CRC-16 with polynomial 0x1021 from 0xffff of binary values; null stays null."""
    return data.map(lambda b: None if b is None else binascii.crc_hqx(b, 0xFFFF)).astype("Int32")


@F.pandas_udf(StringType())
def fnv1a(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of binary values as 16 hex digits, 1 in place of 0; rows go along together, byte by byte."""
    known = data.notna().to_numpy()
    rows = data[known]
    sizes = np.array([len(b) for b in rows], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    h = np.full(len(rows), 0xCBF29CE484222325, dtype=np.uint64)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -i, side="left"))
        h[:live] = (h[:live] ^ flat[starts[:live] + i]) * np.uint64(0x100000001B3)
    h[h == 0] = 1
    hexes = np.empty(len(rows), dtype=object)
    hexes[order] = [f"{v:016x}" for v in h.tolist()]
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[known] = hexes
    return out


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest (RFC 2104) of binary values as lower-case hex, by two built-in digests. The key comes from a secret
    of the session's configuration and stands in the plan, so don't explain such a plan in public."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def crc(width: int, polynomial: int, start: int = 0, final: int = 0):
    """A function of binary columns: the CRC of that width, most significant bit first, for widths from 8 to 32."""
    mask, top = (1 << width) - 1, 1 << (width - 1)
    table = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        table.append(c)

    @F.pandas_udf(LongType())
    def run(data: pd.Series) -> pd.Series:
        def one(b: bytes | None):
            if b is None:
                return None
            c = start
            for x in b:
                c = (c << 8 & mask) ^ table[(c >> (width - 8)) ^ x]
            return c ^ final

        return data.map(one).astype("Int64")

    return run


@F.pandas_udf(IntegerType())
def parity(data: pd.Series) -> pd.Series:
    """All bytes of a binary value combined by exclusive or, 0 for an empty one; null stays null."""
    return data.map(lambda b: None if b is None else int(np.bitwise_xor.reduce(np.frombuffer(b, np.uint8), initial=0))).astype("Int32")


def leb128_bits(value: Column) -> Column:
    """Bits that leb128() takes, without writing them."""
    digits = F.length(F.bin(value))
    return (F.greatest(F.lit(1), F.ceil(digits / 7)) * 8).cast("int")


def rice_bits(residual: Column, k: int) -> Column:
    """Bits that a residual takes in a Rice code of parameter k, without writing it."""
    return F.shiftright(zigzag(residual), k) + 1 + k
