"""Many boxes and points at one place: operators compare places and kinds of boxes, not all copies with all copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenarium.operators import spatial
from scenarium.plans import pose_catalog, region_catalog

SIDES = "cx double, cy double, cz double, sx double, sy double, sz double"


@pytest.fixture
def met(monkeypatch):
    """How many pairs of points and boxes each call of near_boxes gave."""
    seen, real = [], spatial.near_boxes

    def near_boxes(*given):
        pairs = real(*given)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "near_boxes", near_boxes)
    return seen


def cloud(spark):
    """1,000 points at two places, labels 1 and 2, and 900 boxes of three kinds around the first."""
    points = spark.range(1000).select((F.col("id") % 8 * 0).alias("s"), F.col("id").alias("point_id"), (1 + F.col("id") % 4 % 3 % 2).alias("label"), *((F.when(F.col("id") % 2 == 0, 1.0).otherwise(50.0)).alias(a) for a in "xyz"))
    side = lambda k: 2.0 + F.col("id") % 3 + k
    boxes = spark.range(900).select(F.lit(0).cast("long").alias("s"), F.col("id").alias("box_id"), *(F.lit(1.2).alias(f"c{a}") for a in "xyz"), *(side(k).cast("double").alias(f"s{a}") for k, a in enumerate("xyz")), (F.col("id") % 7 / 7.0).alias("confidence"))
    return points, boxes


@pytest.mark.parametrize("by_depth", [False, True])
def test_equal_boxes_are_looked_at_once(spark, met, by_depth):
    points, boxes = cloud(spark)
    points = points.unionByName(spark.createDataFrame([(0, 1, 1, 1.0, 1.0, 1.0)], points.schema))  # point 1 again, elsewhere: its rows have one box
    got = {(r["point_id"], r["box_id"]) for r in spatial.points_in_boxes(points, boxes, ["s"], 1.0, by_depth, -1).collect()}
    held = [(max(abs(1.0 - r["cx"]) / (r[f"s{a}"] / 2) for a in "xyz"), -r["confidence"], r["box_id"]) for r in boxes.collect()]
    best = min(held if by_depth else ((d, r, b) for r, d, b in held))[2]
    assert got == {(i, best if i % 2 == 0 or i == 1 else -1) for i in range(1000)}
    assert max(met) <= 2 * 3 * 27  # 450,000 before


def test_coverage_counts_each_kind_of_box_once(spark, met):
    points, boxes = cloud(spark)
    row = spatial.box_coverage(points, boxes, ["s"], "label", 1.0, 20).first()
    labels = {}
    for r in points.collect():
        labels.setdefault(r["label"], []).append(r["x"] == 1.0)
    share = [sum(v) / len(v) for v in labels.values()]
    inside = sum(labels.values(), [])
    assert row["best"] == pytest.approx(np.mean(share)) and row["recall50"] == np.mean([s >= 0.5 for s in share])
    assert row["purity"] == pytest.approx(max(map(sum, labels.values())) / sum(inside))
    assert max(met) <= 2 * 3 * 27


def test_overlaps_of_many_boxes_at_once(spark):
    rng = np.random.default_rng(5)
    n, eye = 400, np.eye(3).ravel()
    spun = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
    turn = rng.uniform(0, 7, n)
    flat = np.stack([np.cos(turn), -np.sin(turn), 0 * turn, np.sin(turn), np.cos(turn), *[0 * turn] * 4], 1) + np.eye(1, 9, 8)
    c, s = rng.uniform(0, 2, (n, 3)), rng.uniform(0.5, 3, (n, 3))
    for r in (spun.reshape(n, 9), flat):
        # the share of fine points of a unit cube that lie in the other box
        grid = (np.stack(np.meshgrid(*[np.arange(30)] * 3), -1).reshape(-1, 3) + 0.5) / 30
        local = np.einsum("npk,nkj->npj", grid[None] - c[:40, None], r[:40].reshape(-1, 3, 3))
        shared = (np.abs(local) <= s[:40, None] / 2).all(2).mean(1)
        rows = [(i, (c[i].tolist(), s[i].tolist(), r[i].tolist()), ([0.5] * 3, [1.0] * 3, eye.tolist())) for i in range(n)]
        box = "struct<c: array<double>, s: array<double>, r: array<double>>"
        got = dict(spatial.oriented_iou(spark.createDataFrame(rows, f"i int, a {box}, b {box}")).select("i", "iou").collect())
        want = shared / (1 + s[:40].prod(1) - shared)
        assert np.abs(np.array([got[i] for i in range(40)]) - want).max() < 0.02
        mirrored = spatial.box_ious(np.full((n, 3), 0.5), np.ones((n, 3)), np.tile(eye, (n, 1)), c, s, r)
        assert np.allclose([got[i] for i in range(n)], mirrored, atol=1e-8)
        assert spatial.box_ious(*(x[:0] for x in (c, s, r, c, s, r))).shape == (0,)


def test_of_equal_boxes_the_best_suppresses(spark):
    rng = np.random.default_rng(6)
    spots = [(*map(float, rng.integers(0, 4, 3)), 1.0 + int(rng.integers(0, 2)), 2.0, float(rng.integers(1, 3))) for _ in range(12)] + [(1.0, 1.0, 1.0, 0.0, 1.0, 1.0)]
    rows = [(0, i, *spots[int(rng.integers(0, 13))], float(rng.integers(0, 5))) for i in range(200)]
    boxes = spark.createDataFrame(rows, f"s long, box_id long, {SIDES}, confidence double")
    once = spatial.best_of_equal(boxes, ["s"])
    find = lambda b: {r["box_id"] for r in spatial.suppress(b, spatial.overlaps(b, b, ["s"], 3.0).where("a <> b"), ["s"], 0.25).collect()}
    assert find(once) == find(boxes)
    assert once.count() == len({r[2:8] for r in rows if r[5] > 0}) + sum(r[5] == 0 for r in rows)


def joined(df):
    """The rows of ``df``, and the most rows that a join of its plan gave."""
    rows, most = df.collect(), [0]

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if "Join" in name:
            most[0] = max(most[0], plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, most[0]


def test_replacements_of_equal_boxes_are_found_once(spark, tmp_path):
    spark.range(400).select((F.col("id") * 792).alias("p_partkey"), F.lit(5).alias("p_size"), F.lit(950.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    rows, most = joined(region_catalog.j23_replacement(spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == [(792 * k, 792) for k in range(0, 400, 2)]
    assert most <= 400


def test_scales_of_equal_boxes_are_found_once(spark, tmp_path):
    spark.range(100).select((F.col("id") * 3168).alias("p_partkey"), F.lit(5).alias("p_size"), F.lit(950.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    quantity = F.when(F.col("id") % 2 == 0, 5.0).otherwise(25.0).alias("l_quantity")
    zero = [F.lit(0).cast("long").alias(c) for c in ("l_partkey", "l_suppkey")] + [F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax")]
    spark.range(300).select(F.col("id").alias("l_orderkey"), quantity, *zero).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows, most = joined(pose_catalog.f12_scale_prune(spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == [(3168 * k, 300, 150) for k in range(100)]
    assert most <= 400
