"""Quantiles by selection against sorting, and octree streams against a walk through the whole tree."""

import math
import random

import duckdb
import numpy as np
import pytest

from scenarium.operators import octree, quantiles
from scenarium.operators.frames import proportional_depth
from scenarium.operators.quantiles import quantiles as select_quantiles
from scenarium.plans.catalog import ORACLES
from scenarium.plans.derived import OBSERVATIONS
from scenarium.plans import scene_catalog  # noqa: F401  registers its queries

PROBS = [0.0, 0.01, 0.4, 0.5, 0.95, 1.0]


def groups():
    rng = random.Random(4)
    out = {
        1: [rng.random() for _ in range(5000)],
        2: [float(rng.randrange(5)) for _ in range(3000)],
        3: [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(500)],
        4: [7.0] * 400,
        5: [3.5],
        6: [1e308, -1e308, 0.0, 5e-324, -5e-324, 0.0],
        7: [math.nan, math.inf, -math.inf, 2.0, 4.0],
        None: [float(i) for i in range(10)],
    }
    return out


@pytest.mark.parametrize(("bins", "only"), [(1024, [1, 2, 3, 4, 5, 6, 7, None]), (16, [2, 5, 7, None])])
def test_quantiles_equal_sorting(spark, monkeypatch, bins, only):
    monkeypatch.setattr(quantiles, "BINS", bins)
    given = {k: v for k, v in groups().items() if k in only}
    rows = [(k, v, -v) for k, own in given.items() for v in own] + [(8, None, None), (2, None, 1.0)]
    frame = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    got = {r["g"]: r for r in select_quantiles(frame, ["g"], {"x": "a", "y": frame["b"]}, PROBS).collect()}
    assert set(got) == {*given, 8} and got[8]["x"] is None
    for k, own in given.items():
        finite = [v for v in own if math.isfinite(v)]
        assert np.allclose(got[k]["x"], np.quantile(finite, PROBS), rtol=1e-12, atol=1e-300), k
        other = [-v for v in finite] + ([1.0] if k == 2 else [])
        assert np.allclose(got[k]["y"], np.quantile(other, PROBS), rtol=1e-12, atol=1e-300), k
    assert select_quantiles(frame.limit(0), ["g"], {"x": "a"}, [0.5]).collect() == []


def plain_stream(codes, levels):
    """Child masks by walking down."""

    def walk(own, level):
        if level == levels:
            return []
        slots = sorted({c >> 3 * (levels - 1 - level) & 7 for c in own})
        out = [sum(1 << s for s in slots)]
        for s in slots:
            out += walk([c for c in own if c >> 3 * (levels - 1 - level) & 7 == s], level + 1)
        return out

    return bytes(walk(codes, 0))


def plain_deltas(leaves, levels):
    out, first = [], leaves[min(leaves)]

    def walk(own, level):
        if level == levels:
            return own[min(own)]
        parts = {}
        for c, v in own.items():
            parts.setdefault(c >> 3 * (levels - 1 - level) & 7, {})[c] = v
        at = len(out)
        out.extend([None] * (len(parts) - 1))
        values = [walk(parts[s], level + 1) for s in sorted(parts)]
        for n, (a, b) in enumerate(zip(values[:-1], values[1:], strict=True)):
            out[at + n] = (b - a) % 256
        return values[0]

    walk(leaves, 0)
    return [first, *out]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_octree_streams(spark, block):
    rng, levels = random.Random(block), 4
    scenes = {0: {rng.randrange(4096): rng.randrange(256) for _ in range(150)}, 1: {4095: 9}, 2: {0: 255, 4095: 0}, 3: {c: c % 256 for c in range(64)}}
    frame = spark.createDataFrame([(s, c, v) for s, own in scenes.items() for c, v in own.items()], "s int, code long, w long").repartition(3)
    blocks = octree.stream(octree.tree(frame, ["s"], "code", levels), ["s"], levels, block)
    held = sorted((r["s"], r["block"], bytes(r["bytes"])) for r in blocks.collect())
    for s, own in scenes.items():
        assert b"".join(b for k, _, b in held if k == s) == plain_stream(sorted(own), levels)
    assert sorted(map(tuple, octree.decoded(blocks, ["s"], levels).collect())) == sorted((s, c) for s, own in scenes.items() for c in own)
    deltas = octree.parent_deltas(frame, ["s"], "code", "w", levels)
    got = sorted(map(tuple, deltas.collect()))
    assert got == [(s, n, d) for s in scenes for n, d in enumerate(plain_deltas(scenes[s], levels))]
    back = octree.from_parent_deltas(deltas, frame, ["s"], "code", levels).collect()
    assert sorted(map(tuple, back)) == sorted((s, c, v) for s, own in scenes.items() for c, v in own.items())


def test_depth_of_zero_is_infinite_and_counts(spark):
    duck, inf = duckdb.connect(), math.inf
    views = {0: [0.0, 2.0, 4.0], 1: [0.0, 0.0, 5.0], 2: [1.0, 0.0], 3: [inf, inf, 2.0], 4: [inf, 3.0, None, 0.0, 7.0], 5: [math.nan, 1.0, 2.0, 4.0], 6: [0.0], 7: [-2.0, 8.0, 0.0, 3.0]}
    rows = [(g, 10 * g + i, v) for g, own in views.items() for i, v in enumerate(own)]
    duck.execute("create table obs (view int, row_id int, depth double)")
    duck.executemany("insert into obs values (?, ?, ?)", rows)
    sql = ORACLES["p05_proportional_depth"].replace(f"WITH {OBSERVATIONS}, i AS", "WITH i AS")
    want = {r: d for r, d in duck.execute(sql).fetchall()}
    got = proportional_depth(spark.createDataFrame(rows, "view int, row_id int, depth double").repartition(3), ["view"], "depth", infinite=True)
    same = {r["row_id"]: r["depth"] for r in got.collect()}
    assert set(same) == set(want)
    for k, v in want.items():
        assert (same[k] is None and v is None) or np.isclose(same[k], v, rtol=1e-5, equal_nan=True), (k, same[k], v)
