"""Solvers of one block of a scene, in numpy, and their application to each group of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by Lawson and Hanson's active sets."""
    gram, right = a.T @ a, a.T @ b
    n = len(right)
    x = np.zeros(n)
    free = np.zeros(n, dtype=bool)
    tol = 1e-12 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for _ in range(10 * n + 10):
        slope = np.where(free, -np.inf, right - gram @ x)
        if free.all() or slope.max(initial=-np.inf) <= tol:
            break
        free[int(slope.argmax())] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            under = free & (trial <= 0)
            if not under.any():
                x = trial
                break
            step = float((x[under] / np.maximum(x[under] - trial[under], 1e-300)).min())
            x = np.maximum(0.0, x + step * (trial - x))
            free &= x > 1e-15
            x[~free] = 0.0
    return x


def capped(a: np.ndarray, b: np.ndarray, paths: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """nnls() with at most `paths` active at any time: the steepest comes in while there is room, then the exchange of one
    for another that lowers the residual most, as long as one does. Not the strongest of a free solution, which is
    another and a worse one."""
    n = a.shape[1]
    may = np.ones(n, bool) if allowed is None else np.asarray(allowed, bool)
    active: list[int] = []
    x = np.zeros(n)

    def solved(some: list[int]) -> tuple[np.ndarray, float]:
        out = np.zeros(n)
        if some:
            out[some] = nnls(a[:, some], b)
        return out, float(np.linalg.norm(a @ out - b))

    residual = float(np.linalg.norm(b))
    for _ in range(4 * n + 4):
        slope = a.T @ (b - a @ x)
        slope[~may] = -np.inf
        slope[active] = -np.inf
        at = int(slope.argmax()) if n else 0
        if not n or slope[at] <= 1e-12 * max(1.0, float(np.abs(b).max(initial=0.0))):
            break
        if len(active) < paths:
            tries = [[*active, at]]
        else:
            tries = [[*(c for c in active if c != out), into] for out in active for into in np.argsort(-slope, kind="stable")[:4].tolist() if slope[into] > 0]
        best = min(((*solved(t), t) for t in tries), key=lambda r: r[1])
        if best[1] >= residual - 1e-12:
            break
        x, residual = best[0], best[1]
        active = [c for c in best[2] if x[c] > 0]
    return x


#: How much larger the residual of the set that a block had before may be, to keep it.
HELD = 1.5


def sparse_fit(a: np.ndarray, b: np.ndarray, paths: int = 3, held: np.ndarray | None = None, allowed: np.ndarray | None = None, bounds: np.ndarray | None = None) -> np.ndarray:
    """Non-negative weights, at most `paths` of them, that keep the length of b.

    held: the weights before; their set is kept where a solution confined to it has a residual of at most HELD times the
    free one's. allowed: which columns may be used. bounds: upper bounds; weights over theirs are pinned there and the
    others solved again. The final scaling to the length of b stays under the bounds.
    """
    n = a.shape[1]
    x = capped(a, b, paths, allowed)
    if held is not None and len(held) == n:
        before = np.flatnonzero((np.asarray(held) > 0) & (np.ones(n, bool) if allowed is None else np.asarray(allowed, bool)))
        if len(before) and set(before) != set(np.flatnonzero(x > 0)):
            kept = np.zeros(n)
            kept[before] = nnls(a[:, before], b)
            if np.linalg.norm(a @ kept - b) <= HELD * np.linalg.norm(a @ x - b) + 1e-15:
                x = kept
    if bounds is not None:
        pinned = np.zeros(n, bool)
        while (over := (x > bounds + 1e-12) & ~pinned).any():
            pinned |= over
            rest = np.flatnonzero((x > 0) & ~pinned)
            x = np.where(pinned, bounds, 0.0)
            if len(rest):
                x[rest] = nnls(a[:, rest], b - a[:, pinned] @ bounds[pinned])
    radiated = float(np.linalg.norm(a @ x))
    if radiated <= 1e-12:
        return x
    scale = float(np.linalg.norm(b)) / radiated
    if bounds is not None and (x > 0).any():
        scale = min(scale, max(1.0, float(np.min(bounds[x > 0] / x[x > 0]))))
    return x * scale


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of a square matrix, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reach = np.full(n, np.inf)
        via = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        row, column = start, -1
        base = 0.0
        while True:
            d = base + cost[row] - u[row] - v
            better = ~done & (d < reach)
            reach[better], via[better] = d[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            done[column] = True
            base = reach[column]
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[start] += base
        for c in np.flatnonzero(done):
            if row_of[c] >= 0:
                u[row_of[c]] += base - reach[c]
            v[c] -= base - reach[c]
        while column >= 0:
            before = via[column]
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    out = np.empty(n, dtype=np.int64)
    out[row_of] = np.arange(n)
    return out


def _last_max(values: np.ndarray) -> int:
    return len(values) - 1 - int(values[::-1].argmax())


def seed(directions: np.ndarray, energies: np.ndarray, count: int) -> np.ndarray:
    """Indices of the loudest direction, then always the one with the largest energy times distance (1 - cosine) to its
    nearest seed, the last one on ties; fewer where nothing is left to serve."""
    if not len(directions) or count < 1:
        return np.empty(0, dtype=np.int64)
    chosen = [_last_max(energies)]
    nearest = directions @ directions[chosen[0]]
    while len(chosen) < count:
        need = energies * (1 - nearest)
        need[chosen] = 0.0  # exactly, whatever rounding left of it
        at = _last_max(need)
        if need[at] <= 0:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, directions @ directions[at])
    return np.array(chosen)


def spherical_kmeans(directions: np.ndarray, energies: np.ndarray, centres: np.ndarray, previous: np.ndarray | None = None, hold: float = 5.0, passes: int = 32):
    """(owner, centres): energy-weighted k-means of unit vectors. An object leaves the centre it had before only for
    one that is nearer by more than hold degrees. Centres without energy stay where they are."""
    owner = previous
    for _ in range(passes):
        angles = np.degrees(np.arccos(np.clip(directions @ centres.T, -1, 1)))
        best = angles.argmin(axis=1)
        if owner is not None:
            rows = np.arange(len(best))
            best = np.where(angles[rows, owner] - angles[rows, best] > hold, best, owner)
        moved = owner is None or bool((best != owner).any())
        owner = best
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, directions * energies[:, None])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-300), centres)
        if not moved:
            break
    return owner, centres


def limiter(peaks: np.ndarray, ceiling: float, ahead: int = 96, release: float = 1 / 2400, carried: float = 1.0) -> np.ndarray:
    """Gain at each sample of a block that keeps peaks under the ceiling: falls at least ahead samples early, rises by
    at most release a sample, and goes on from the gain carried in."""
    need = np.minimum(1.0, ceiling / np.maximum(peaks, 1e-300))
    if carried >= 1 and need.min(initial=1.0) >= 1:
        return np.ones(len(peaks))
    early = np.empty(len(need))
    low, age = np.inf, 0
    for i in range(len(need) - 1, -1, -1):
        age += 1
        if need[i] <= low:
            low, age = need[i], 0
        elif age > ahead:
            low, age = need[i : i + ahead + 1].min(), 0
        early[i] = low
    out = np.empty(len(need))
    gain = carried
    for i, e in enumerate(early):
        gain = min(e, gain + release)
        out[i] = gain
    return out


def by_block(df: DataFrame, keys: list[str], schema: str, solve: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """solve applied to each block of a scene: a block holds the objects of one moment, a bounded number."""
    return df.groupBy(*keys).applyInPandas(solve, schema)


def seed_blocks(df: DataFrame, key: str, index: str, direction: str, energy: str, count: int) -> DataFrame:
    """(key, place, index): the seeds of each block in the order chosen. Rows with null parts can't be seeds."""

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.dropna().sort_values(index)
        at = seed(np.stack(block[direction].to_list()) if len(block) else np.empty((0, 3)), block[energy].to_numpy(float), count)
        chosen = block.iloc[at]
        return pd.DataFrame({key: chosen[key], "place": np.arange(len(at), dtype=np.int32), index: chosen[index]})

    types = dict(df.dtypes)
    return by_block(df.select(key, index, direction, energy), [key], f"{key} {types[key]}, place int, {index} {types[index]}", solve)


def capture(energies: np.ndarray, targets: np.ndarray, limit: int) -> list[int]:
    """Members that serve the others best, chosen greedily: the gain of a candidate is the energy of each member times
    how much nearer than any seed so far it is, by the cosine of the gain vectors; the first of equal ones. Ends where
    a seed would bring no more than 1e-9 of the energy."""
    n = np.linalg.norm(targets, axis=1)
    lengths = np.outer(n, n)
    kernel = np.where(lengths > 1e-12, np.clip(targets @ targets.T / np.maximum(lengths, 1e-300), 0, 1), 0.0)
    np.fill_diagonal(kernel, 1.0)
    served, chosen = np.zeros(len(energies)), []
    free = np.ones(len(energies), bool)
    while len(chosen) < min(limit, len(energies)):
        gains = np.where(free, np.maximum(kernel - served, 0.0) @ energies, -np.inf)
        at = int(gains.argmax())
        if not gains[at] > 1e-9 * energies.sum():
            break
        free[at] = False
        chosen.append(at)
        served = np.maximum(served, kernel[at])
    return chosen


def capture_blocks(df: DataFrame, key: str, index: str, target: str, energy: str, limit: int) -> DataFrame:
    """(key, place, index): capture() of each block. Rows with null parts can't be seeds."""

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.dropna().sort_values(index)
        at = capture(np.maximum(block[energy].to_numpy(float), 0), np.stack([np.asarray(t, float) for t in block[target]]), limit) if len(block) else []
        chosen = block.iloc[at]
        return pd.DataFrame({key: chosen[key], "place": np.arange(len(at), dtype=np.int32), index: chosen[index]})

    types = dict(df.dtypes)
    return by_block(df.select(key, index, target, energy), [key], f"{key} {types[key]}, place int, {index} {types[index]}", solve)


def allocate(curves: list[np.ndarray], present: list[bool], elements: int, previous: list[int] | None = None, worth: float = 0.05) -> list[int] | None:
    """Elements of each class. curves: of each class the cost with 0, 1, 2 ... elements, falling. A class that is present
    has one at least; the rest go one by one where they save most, the first of equal ones; elements beyond what any
    class can use go to the first present class. A previous share is kept, and an element moves only where the taker
    saves more by a share of worth than the giver loses. None if there are more classes than elements."""
    if sum(present) > elements:
        return None
    if not any(present):
        return [elements, *[0] * (len(curves) - 1)] if curves else []
    held = previous is not None and len(previous) == len(curves) and sum(previous) == elements and all(n > 0 for n, p in zip(previous, present) if p)
    most = [max(len(c) - 1, 1) if p else 0 for c, p in zip(curves, present)]
    share = [min(n, m) for n, m in zip(previous if held else map(int, present), most)]

    def saving(c: int, n: int) -> float:
        return float(curves[c][n] - curves[c][n + 1]) if n + 1 < len(curves[c]) else 0.0

    def taker() -> int | None:
        able = [c for c in range(len(curves)) if present[c] and share[c] < most[c]]
        return max(able, key=lambda c: (saving(c, share[c]), -c), default=None)

    for left in range(elements - sum(share), 0, -1):
        to = taker()
        if to is None:
            share[present.index(True)] += left
            break
        share[to] += 1
    if held:
        for _ in range(elements):
            to = taker()
            givers = [c for c in range(len(curves)) if present[c] and share[c] > 1]
            if to is None or not givers:
                break
            by = min(givers, key=lambda c: (saving(c, share[c] - 1), c))
            if to == by or saving(to, share[to]) <= saving(by, share[by] - 1) * (1 + worth):
                break
            share[by] -= 1
            share[to] += 1
    return share


#: Cost of renumbering: of a degree between directions, and of a change of class.
DEGREE, CLASS_CHANGE = 1e-3, 4.0


def renumber(before: np.ndarray, after: np.ndarray, directions_before: np.ndarray, directions_after: np.ndarray, class_before: np.ndarray | None = None, class_after: np.ndarray | None = None) -> np.ndarray:
    """New number of each element of a block, so that elements go on as what they were: the cheapest assignment by 1 -
    cosine of the columns of weights, the angle between directions, and a change of class."""
    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=0, keepdims=True)
        return np.where(n > 1e-12, m / np.maximum(n, 1e-300), 0.0)

    same = unit(after).T @ unit(before)
    angle = np.degrees(np.arccos(np.clip(directions_after @ directions_before.T, -1, 1)))
    cost = 1 - same + DEGREE * angle
    if class_before is not None and class_after is not None:
        cost = cost + CLASS_CHANGE * (np.asarray(class_after)[:, None] != np.asarray(class_before)[None, :])
    return assign(cost)
