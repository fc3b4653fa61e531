"""Structured Streaming versions of the batch operators: the same results on ordered input."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sub_block_energy(samples: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Mean square of each channel and tumbling sub-block; a block closes when the watermark passes it.

    samples: ts (timestamp), channel, x. Late rows are dropped by the watermark.
    """
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "channel")
    return w.agg((F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("ms"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "channel", "ms", "n")


def change_or_due(updates: DataFrame, every: int = 128) -> DataFrame:
    """Emit an update when its state differs from the last one that was emitted, or `every` units after that.

    updates: stream (key), unit, state. The last emission of each stream is the state that is kept, so it is bounded by
    the number of streams. Rows of a trigger are taken in order of unit.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, value = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["unit", "state"])
        out = []
        for u, s in zip(rows["unit"], rows["state"]):
            if unit is None or s != value or u - unit >= every:
                unit, value = int(u), s
                out.append((key[0], unit, s))
        state.update((unit, value))
        yield pd.DataFrame(out, columns=["stream", "unit", "state"])

    return updates.groupBy("stream").applyInPandasWithState(step, "stream long, unit long, state string", "unit long, state string", "append", GroupStateTimeout.NoTimeout)


SHORT, LONG = 4, 30  # sub-blocks of a momentary and of a short-term window


def loudness_meter(energies: DataFrame) -> DataFrame:
    """A meter that is read after every sub-block: programme, sub, momentary, short_term (null until full) and integrated.

    energies: programme, sub, e (weighted mean square of a sub-block), in order within a trigger or not. Sub-blocks that
    are left out are silent; one that comes again, or after a later one, is dropped, so that a stream that is read
    twice gives the same. The state of a programme is its last 30 sub-blocks and the energies of its blocks, 8 bytes
    for each sub-block it had.
    """

    def level(e: float) -> float:
        return -0.691 + 10 * math.log10(e) if e > 0 else -math.inf

    def integrated(blocks: np.ndarray) -> float:
        loud = blocks[blocks > 10 ** ((-70 + 0.691) / 10)]
        if not len(loud):
            return -math.inf
        return level(float(np.mean(loud[loud > loud.mean() / 10])))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, recent, blocks = state.get if state.exists else (None, b"", b"")
        ring, past = list(np.frombuffer(recent)), list(np.frombuffer(blocks))
        out = []
        for sub, e in pd.concat(list(frames)).sort_values("sub")[["sub", "e"]].itertuples(index=False):
            if last is not None and sub <= last:
                continue
            for at in range(int(sub) if last is None else last + 1, int(sub) + 1):
                ring = [*ring, float(e) if at == sub and e == e else 0.0][-LONG:]
                if len(ring) >= SHORT:
                    past.append(float(np.mean(ring[-SHORT:])))
                if at == sub:
                    momentary = level(past[-1]) if len(ring) >= SHORT else None
                    out.append((key[0], at, momentary, level(float(np.mean(ring))) if len(ring) == LONG else None, integrated(np.array(past))))
            last = int(sub)
        state.update((last, np.array(ring).tobytes(), np.array(past).tobytes()))
        yield pd.DataFrame(out, columns=["programme", "sub", "momentary", "short_term", "integrated"])

    schema = "programme long, sub long, momentary double, short_term double, integrated double"
    return energies.groupBy("programme").applyInPandasWithState(step, schema, "sub long, recent binary, blocks binary", "append", GroupStateTimeout.NoTimeout)


def smoother(energies: DataFrame, behind: int = 0, ahead: int = 2, arriving: float = 2.0) -> DataFrame:
    """A bounded delay line: object, block and energy, the largest of an object's own energy, those of `behind` blocks
    before, and those of `ahead` blocks after that are `arriving` times its own or more.

    energies: object, block (without gaps), energy. A block comes out when the last one that it looks at came in; a row
    without an energy ends its object, and lets the blocks that wait come out with what there is. The state of an
    object is behind + ahead + 1 blocks.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, due, held = state.get if state.exists else (None, None, b"")
        line, out = list(np.frombuffer(held)), []

        def place(upto: int) -> None:
            nonlocal first, due, line
            while due is not None and due <= upto:
                i = due - first
                own = line[i]
                later = [v for v in line[i + 1 : i + 1 + ahead] if v >= own * arriving]
                out.append((key[0], due, max([own, *line[max(0, i - behind) : i], *later])))
                due += 1
            if due is not None and due - behind > first:
                line, first = line[due - behind - first :], due - behind

        for block, e in pd.concat(list(frames)).sort_values("block")[["block", "energy"]].itertuples(index=False):
            if e != e:
                if due is not None:
                    place(first + len(line) - 1)
                first, due, line = None, None, []
                continue
            if first is None:
                first = due = int(block)
            elif block < first + len(line):
                continue  # came already
            line.append(float(e))
            place(int(block) - ahead)
        state.update((first, due, np.array(line).tobytes()))
        yield pd.DataFrame(out, columns=["object", "block", "energy"])

    return energies.groupBy("object").applyInPandasWithState(step, "object long, block long, energy double", "first long, due long, held binary", "append", GroupStateTimeout.NoTimeout)
