"""The warm-started fold of blocks, by its properties."""

import numpy as np

from auralake.operators import folding as D
from auralake.operators.panning import Hull, directions_of, speaker_directions

BEDS = ["L", "R", "C", "Lss", "Rss", "Lrs", "Rrs", "Lfh", "Rfh", "Lrh", "Rrh"]
HULL = Hull(speaker_directions(BEDS))


def scene(r, n, base=None, jitter=3.0, modes=1, pinned=0):
    base = directions_of(r.normal(size=(n, 3)) * [1, 1, 0.4] + [0, 0, 0.4]) if base is None else base
    place = directions_of(base + np.tan(np.radians(jitter)) * r.normal(size=base.shape) / 3)
    place[:pinned] = base[:pinned]
    return D.Objects(place, r.random(n) + 0.1, np.arange(n) % modes, np.arange(n) < pinned), base


def test_jitter_does_not_move_the_elements():
    r = np.random.default_rng(1)
    first, base = scene(r, 24)
    energy = first.energy
    folder, travel, costs, steps = D.Folder(8, HULL.gains), 0.0, [], 12
    before = folder.step(first)
    for _ in range(steps):
        o, _ = scene(r, 24, base)
        o.energy = energy
        f = folder.step(o)
        assert (np.count_nonzero(f.weight, axis=1) <= 3).all() and (f.weight >= 0).all()
        targets = HULL.gains(o.position)
        assert np.allclose(np.linalg.norm(f.weight @ HULL.gains(f.position), axis=1), np.linalg.norm(targets, axis=1), atol=0.35)
        travel += np.degrees(np.arccos(np.clip((directions_of(f.position) * directions_of(before.position)).sum(1), -1, 1))).mean()
        costs.append(folder.cost(f, o, targets) / energy.sum())
        before = f
    assert travel / steps < 6 and np.mean(costs) < 0.35


def test_as_many_elements_as_objects_lose_nothing():
    r = np.random.default_rng(2)
    o, _ = scene(r, 6)
    f = D.Folder(6, HULL.gains).step(o)
    assert D.Folder(6, HULL.gains).cost(f, o, HULL.gains(o.position)) < 0.02 * o.energy.sum()


def test_modes_and_pins_are_kept_apart():
    r = np.random.default_rng(3)
    o, _ = scene(r, 14, modes=2, pinned=2)
    folder = D.Folder(7, HULL.gains)
    for _ in range(3):
        f = folder.step(o)
        for p in range(2):
            assert (np.abs(f.position - o.position[p]).sum(1) < 1e-9).any()
        i, e = np.nonzero(f.weight)
        assert (o.mode[i] == f.mode[e]).all() and set(f.mode) == {0, 1}


def test_programmes(spark):
    r = np.random.default_rng(4)
    rows = []
    for p in range(2):
        o, base = scene(r, 8)
        for b in range(3):
            o, _ = scene(r, 8, base)
            rows += [(p, b, i, o.position[i].tolist(), float(o.energy[i]), 0, False) for i in range(8)]
    rows.append((0, 0, 99, None, 1.0, 0, False))
    df = spark.createDataFrame(rows, "programme int, block long, object int, position array<double>, energy double, mode int, pinned boolean")
    got = D.fold_programmes(df, "programme", "block", 4, BEDS).collect()
    assert {(g.programme, g.block, g.object) for g in got} == {r_[:3] for r_ in rows if r_[3]} and {g.element for g in got} <= set(range(4))
    assert D.fold_programmes(df.limit(0), "programme", "block", 4, BEDS).count() == 0


def test_apart():
    d = directions_of(D.apart(np.array([[0.0, 1.0, 0.0]] * 4 + [[0.0, 0.0, 1.0]] * 2)))
    near = d @ d.T - 2 * np.eye(6)
    assert near.max() <= np.cos(np.radians(1.9))
