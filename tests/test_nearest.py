"""Nearest neighbours in crowds and far away, and overlaps of boxes of all sizes, against all pairs."""

import numpy as np

from scenarium.operators.spatial import nearest, overlaps


def plain(left, right):
    out = {}
    for i, x, y, z in left:
        best = min((round(float(np.sqrt(((x - a) ** 2 + (y - b) ** 2) + (z - c) ** 2)), 9), j) for j, a, b, c in right)
        out[i] = best[::-1]
    return out


def test_crowds_and_outliers(spark):
    rng = np.random.default_rng(5)
    right = [(i, *map(float, rng.random(3) * 1e-3)) for i in range(1500)]  # one cell of the first grid
    right += [(2000 + i, *map(float, rng.random(3) * 100)) for i in range(200)] + [(3000, 1e5, -1e5, 5.0), (3001, 1e5, -1e5, 5.0)]
    left = [(i, *map(float, rng.random(3) * 1.2e-3)) for i in range(60)] + [(100 + i, *map(float, rng.random(3) * 120 - 10)) for i in range(60)]
    left += [(500, -3e8, 2e8, 1.0), (501, 1e5, -1e5, 0.0), (502, 5e11, 0.0, 0.0), (503, *right[0][1:])]
    schema = "s int, point_id int, x double, y double, z double"
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], schema)
    odd = spark.createDataFrame([(1, 900, None, 0.0, 0.0), (1, 901, float("nan"), 0.0, 0.0), (2, 902, 0.0, 0.0, 0.0)], schema)
    got = {r["point_id"]: (r["nearest_id"], r["distance"]) for r in nearest(frame(left).union(odd), frame(right), ["s"], 1.0).collect()}
    for i, (j, d) in plain(left, right).items():
        assert got[i][0] == j and np.isclose(got[i][1], d, rtol=1e-9, atol=1e-9), i
    assert all(got[i] == (None, None) for i in (900, 901, 902)) and len(got) == len(left) + 3
    assert nearest(frame(left), frame(right).limit(0), ["s"], 1.0).where("nearest_id is not null").isEmpty()


def test_overlaps_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    boxes = [(1, i, *map(float, rng.random(3) * 40), *map(float, 10.0 ** rng.uniform(-2, 1.5, 3))) for i in range(120)] + [(1, 999, 0.0, 0.0, 0.0, 1e6, 1e6, 1e6), (2, 1000, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0)]
    frame = spark.createDataFrame(boxes, "s int, box_id int, cx double, cy double, cz double, sx double, sy double, sz double")
    got = {(r["a"], r["b"]): r["iou"] for r in overlaps(frame, frame, ["s"], 2.0).collect()}
    want = {}
    for p in boxes:
        for q in boxes:
            sides = [min(p[2 + k] + p[5 + k] / 2, q[2 + k] + q[5 + k] / 2) - max(p[2 + k] - p[5 + k] / 2, q[2 + k] - q[5 + k] / 2) for k in range(3)]
            if p[0] == q[0] and min(sides) > 0:
                both = float(np.prod(sides))
                want[p[1], q[1]] = both / (np.prod(p[5:]) + np.prod(q[5:]) - both)
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
