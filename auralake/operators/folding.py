"""Many objects folded onto few elements, block by block, with a warm start from the block before.

A programme's blocks depend on each other, so one task folds a programme in order and holds a block at a time; blocks
of other programmes are folded beside it. A block has a bounded number of objects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from auralake.operators import clustering as K
from auralake.operators.panning import Hull, directions_of, speaker_directions

# Degrees by which another centre must be nearer, and within which two are one; steps of the search and
# their first size; shares by which a place, an exchange and a cold start must be better, and of the scene's energy.
HOLD, COINCIDENT, PASSES, REACH = 5.0, 2.0, 4, 0.1
PLACE_WORTH, EXCHANGE_WORTH, LEAST, EVERY = 0.25, 0.05, 1e-4, 8


@dataclass
class Objects:
    """The objects of a block: position (n, 3), energy (n), mode (n, any integers), pinned (n)."""

    position: np.ndarray
    energy: np.ndarray
    mode: np.ndarray
    pinned: np.ndarray


@dataclass
class Fold:
    """The elements of a block: position (e, 3) and mode (e); weight (n, e) of each object in them."""

    position: np.ndarray
    mode: np.ndarray
    weight: np.ndarray

    def carried(self, energy: np.ndarray) -> np.ndarray:
        return (energy[:, None] * self.weight**2).sum(0)


class Folder:
    """Folds the blocks of a programme in order onto `elements`; gains turns places (n, 3) into gain vectors (n, c)."""

    def __init__(self, elements: int, gains: Callable[[np.ndarray], np.ndarray], paths: int = 3) -> None:
        self.elements, self.gains, self.paths = elements, gains, paths
        self.before: Fold | None = None
        self.block = 0

    def step(self, objects: Objects) -> Fold:
        """The next block's fold. Every EVERY blocks one from scratch is tried and taken where it is worth the change."""
        targets = self.gains(objects.position)
        warm = self.settle(objects, targets, self.before)
        self.block += 1
        if self.before is not None and self.block % EVERY == 0:
            cold = renumbered(self.settle(objects, targets, None), warm)
            a, b, energy = self.cost(warm, objects, targets), self.cost(cold, objects, targets), float(objects.energy.sum())
            apart = 1 - np.clip((directions_of(warm.position) * directions_of(cold.position)).sum(1), -1, 1)
            moved = float((warm.carried(objects.energy) * apart).sum())
            if b < a * (1 - EXCHANGE_WORTH) and a - b > LEAST * energy and b + moved / EVERY < a:
                warm = cold
        self.before = warm
        return warm

    def cost(self, fold: Fold, objects: Objects, targets: np.ndarray) -> float:
        """Energy times squared relative error, over the objects."""
        return float(errors(fold.weight, self.gains(fold.position), objects.energy, targets).sum())

    def settle(self, objects: Objects, targets: np.ndarray, before: Fold | None) -> Fold:
        """Places from the objects, weights onto them, places by the metric, an exchange in its turn, and the numbers
        that the elements had before."""
        pins = np.flatnonzero(objects.pinned)
        if len(pins) > self.elements:
            raise ValueError(f"{len(pins)} pinned objects on {self.elements} elements")
        position, mode = self.places(objects, targets, pins, before)
        fold = Fold(position, mode, np.zeros((len(objects.energy), self.elements)))
        if before is not None and len(before.weight) == len(objects.energy):
            # Numbers first: what an object was spread over before is only known by them.
            fold = renumbered(Fold(position, mode, _nearest(objects, position, mode)), before)
        fixed = {int(np.argmin(((fold.position - objects.position[p]) ** 2).sum(1) + 1e6 * (fold.mode != objects.mode[p]))) for p in pins}
        self.weigh(fold, objects, targets, before)
        self.search(fold, objects, targets, before, fixed)
        if self.block % EVERY == EVERY - 1:
            fold = self.exchange(fold, objects, targets, fixed)
        return fold

    def places(self, objects: Objects, targets: np.ndarray, pins: np.ndarray, before: Fold | None) -> tuple[np.ndarray, np.ndarray]:
        """Pinned objects have an element each, at their place; the others are shared between modes by what they save,
        and spread over the objects of a mode by spherical k-means, from where they were or from the seeds."""
        free = ~objects.pinned
        modes = list(dict.fromkeys(objects.mode[free].tolist())) or list(dict.fromkeys(objects.mode.tolist())) or [0]
        members = [np.flatnonzero(free & (objects.mode == m)) for m in modes]
        spots, kinds = [objects.position[pins]], [objects.mode[pins]]
        rest = self.elements - len(pins)
        seeds = [K.capture(objects.energy[i], targets[i], rest) if len(i) else [] for i in members]
        curves = [_curve(objects.energy[i], targets[i], s) for i, s in zip(members, seeds)]
        held = None
        if before is not None:
            held = [int((before.mode == m).sum()) for m in modes]
        share = K.allocate(curves, [bool(len(i)) and objects.energy[i].sum() > 0 for i in members], rest, held, EXCHANGE_WORTH)
        if share is None:  # more modes than elements: the loudest have one each
            loud = np.argsort([-objects.energy[i].sum() for i in members], kind="stable")[:rest]
            share = [int(k in loud) for k in range(len(modes))]
        for m, i, s, n in zip(modes, members, seeds, share):
            if not n:
                continue
            start = objects.position[i[s[:n]]] if len(i) else np.empty((0, 3))
            if before is not None and (was := before.position[before.mode == m][:n]).size:
                start = np.vstack([was, start[len(was) :]]) if len(was) < n else was
            if len(start) < n:  # more elements than the mode can use: spares in front
                start = np.vstack([start, np.tile([0.0, 1.0, 0.0], (n - len(start), 1))])
            if len(i):
                d, c = directions_of(objects.position[i]), directions_of(start)
                owner = (d @ c.T).argmax(1)
                owner, _ = K.spherical_kmeans(d, objects.energy[i], c, owner, HOLD)
                for k in range(n):
                    mine = owner == k
                    if objects.energy[i[mine]].sum() > 0:
                        start[k] = np.average(objects.position[i[mine]], axis=0, weights=objects.energy[i[mine]])
            spots.append(apart(start))
            kinds.append(np.full(n, m))
        position, mode = np.vstack(spots), np.concatenate(kinds)
        if len(position) < self.elements:
            lack = self.elements - len(position)
            position, mode = np.vstack([position, np.tile([0.0, 1.0, 0.0], (lack, 1))]), np.concatenate([mode, np.full(lack, modes[0])])
        return position.astype(float), mode

    def weigh(self, fold: Fold, objects: Objects, targets: np.ndarray, before: Fold | None) -> None:
        """Weights of each object over the elements of its mode, at most `paths`, holding the set that it had."""
        radiated = self.gains(fold.position).T
        for i, target in enumerate(targets):
            held = before.weight[i] if before is not None and len(before.weight) == len(targets) else None
            allowed = fold.mode == objects.mode[i]
            fold.weight[i] = K.sparse_fit(radiated, target, self.paths, held, allowed if allowed.any() else None)

    def search(self, fold: Fold, objects: Objects, targets: np.ndarray, before: Fold | None, fixed: set[int]) -> None:
        """Steps along the axes, halved in each pass, to where the objects of an element are served best; one leaves the
        place it had in the block before only for one that is better by a share."""
        radiated = self.gains(fold.position)
        for step in REACH * 0.5 ** np.arange(PASSES):
            for e in range(self.elements):
                on = np.flatnonzero(fold.weight[:, e])
                if e in fixed or not len(on):
                    continue
                rest = fold.weight[on] @ radiated - np.outer(fold.weight[on, e], radiated[e])
                tries = np.clip(np.vstack([fold.position[e], fold.position[e] + step * np.vstack([np.eye(3), -np.eye(3)])]), -1, 1)
                tries[:, 2] = np.maximum(tries[:, 2], min(0.0, fold.position[e, 2]))
                made = self.gains(tries)
                costs = np.array([_relative(rest + np.outer(fold.weight[on, e], g), objects.energy[on], targets[on]).sum() for g in made])
                best = int(costs.argmin())
                if best and before is not None and np.array_equal(fold.position[e], before.position[e]):
                    carried = float((objects.energy[on] * fold.weight[on, e] ** 2).sum())
                    if costs[0] - costs[best] <= max(PLACE_WORTH * costs[0], LEAST * carried):
                        best = 0
                fold.position[e], radiated[e] = tries[best], made[best]

    def exchange(self, fold: Fold, objects: Objects, targets: np.ndarray, fixed: set[int]) -> Fold:
        """Move the element that carries least to the object that is served worst, if all of it is better then."""
        cost = errors(fold.weight, self.gains(fold.position), objects.energy, targets) * ~objects.pinned
        worst = int(cost.argmax())
        some = [e for e in range(self.elements) if e not in fixed and ((fold.mode == fold.mode[e]).sum() > 1 or not (objects.energy[objects.mode == fold.mode[e]] > 0).any())]
        if not some or cost[worst] <= 0:
            return fold
        carried = fold.carried(objects.energy)
        spare = min(some, key=lambda e: carried[e])
        moved = Fold(fold.position.copy(), fold.mode.copy(), fold.weight.copy())
        moved.position[spare], moved.mode[spare] = objects.position[worst], objects.mode[worst]
        self.weigh(moved, objects, targets, None)
        was, now = self.cost(fold, objects, targets), self.cost(moved, objects, targets)
        better = now < was * (1 - EXCHANGE_WORTH) and was - now > LEAST * float(objects.energy.sum())
        return moved if better else fold


def _relative(got: np.ndarray, energy: np.ndarray, targets: np.ndarray) -> np.ndarray:
    asked = (targets**2).sum(1)
    return np.where(asked > 1e-12, energy * ((got - targets) ** 2).sum(1) / np.maximum(asked, 1e-12), 0.0)


def errors(weight: np.ndarray, radiated: np.ndarray, energy: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Of each object its energy times the squared relative error of what it reaches."""
    return _relative(weight @ radiated, energy, targets)


def _curve(energy: np.ndarray, targets: np.ndarray, seeds: list[int]) -> np.ndarray:
    """What is unserved with 0, 1, 2 ... of the seeds."""
    if not len(energy):
        return np.zeros(1)
    u = targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-300)
    best, out = np.zeros(len(energy)), [float(energy.sum())]
    for s in seeds:
        best = np.maximum(best, np.clip(u @ u[s], 0, 1))
        out.append(float((energy * (1 - best)).sum()))
    return np.array(out)


def _nearest(objects: Objects, position: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Each object wholly on the nearest element of its mode: enough to tell which element is which."""
    cos = directions_of(objects.position) @ directions_of(position).T - 4.0 * (objects.mode[:, None] != mode[None, :])
    out = np.zeros(cos.shape)
    out[np.arange(len(out)), cos.argmax(1)] = np.sqrt(objects.energy)
    return out


def apart(places: np.ndarray) -> np.ndarray:
    """Places whose directions coincide are turned away from each other about the vertical."""
    out = places.astype(float).copy()
    for j in range(1, len(out)):
        for _ in range(len(out)):
            near = directions_of(out[:j]) @ directions_of(out[j : j + 1])[0]
            if near.max() <= np.cos(np.radians(COINCIDENT)):
                break
            t = np.radians(COINCIDENT)
            base = directions_of(out[j : j + 1])[0] if np.linalg.norm(out[j]) < 1e-12 else out[j]
            turned = np.array([np.cos(t) * base[0] + np.sin(t) * base[1], np.cos(t) * base[1] - np.sin(t) * base[0], base[2]])
            if np.allclose(turned, out[j]):  # straight up or down
                turned = out[j] + [0.0, np.tan(t) * max(abs(out[j, 2]), 1e-3), 0.0]
            out[j] = turned
    return out


def renumbered(fold: Fold, before: Fold) -> Fold:
    """fold with its elements in the places of those that they go on from."""
    if len(fold.position) != len(before.position) or len(fold.weight) != len(before.weight):
        return fold
    to = K.renumber(before.weight, fold.weight, directions_of(before.position), directions_of(fold.position), before.mode, fold.mode)
    order = np.empty(len(to), int)
    order[to] = np.arange(len(to))
    return Fold(fold.position[order], fold.mode[order], fold.weight[:, order])


def fold_programmes(scene: DataFrame, programme: str, block: str, elements: int, speakers: list[str], paths: int = 3) -> DataFrame:
    """programme, block, object, element, weight (not zero), and the element's place: every block of every programme.

    scene: programme, block, object, position (array of three), energy, mode (integer), pinned. Gains are those of hull
    panning over the named speakers. Rows with a null position or energy take no part; blocks of one programme are
    folded in order by one task, each from the fold before.
    """
    hull = Hull(speaker_directions(speakers))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        folder, out = Folder(elements, hull.gains, paths), []
        for b, g in rows.sort_values([block, "object"]).groupby(block, sort=True):
            o = Objects(np.stack([np.asarray(p, float) for p in g["position"]]), np.maximum(g["energy"].to_numpy(float), 0), g["mode"].to_numpy(int), g["pinned"].to_numpy(bool))
            f = folder.step(o)
            i, e = np.nonzero(f.weight)
            out.append(pd.DataFrame({programme: rows[programme].iloc[0], block: b, "object": g["object"].to_numpy()[i], "element": e.astype(np.int32), "weight": f.weight[i, e], **{c: f.position[e, k] for k, c in enumerate("xyz")}}))
        return pd.concat(out)

    types = dict(scene.dtypes)
    schema = f"{programme} {types[programme]}, {block} {types[block]}, object {types['object']}, element int, weight double, x double, y double, z double"
    known = scene.where("position is not null and energy is not null").select(programme, block, "object", "position", "energy", "mode", "pinned").fillna({"mode": 0, "pinned": False})
    return known.groupBy(programme).applyInPandas(run, schema)
