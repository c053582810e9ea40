"""Operators that work in parts: places in an order, grids of boxes, temporary tables."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scenarium.operators import graph, images, mesh, ranking, spatial
from scenarium.plans import materialize as tables


def test_numbers_in_parts_are_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 20), i) for i in range(500)] + [(None, 1, 1000), (None, 0, 1001)]
    got = {(r.k, r.v, r.i): (r["_n"], r["_of"]) for r in ranking.numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(7), ["k"], ["v", "i"]).collect()}
    for k in ("a", "b", None):
        own = sorted((v, i) for x, v, i in rows if x == k)
        assert [got[k, v, i] for v, i in own] == [(n, len(own)) for n in range(len(own))]
    every = ranking.numbered(spark.createDataFrame(rows, "k string, v int, i int"), [], ["i"]).orderBy("i").collect()
    assert [r["_n"] for r in every] == list(range(len(rows)))
    assert ranking.numbered(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]).collect() == []


def test_boxes_of_any_size_meet_their_points(spark):
    rng = random.Random(2)
    points = [(0, i, *(rng.uniform(-500, 500) for _ in range(3))) for i in range(400)]
    boxes = [(0, i, *(rng.uniform(-400, 400) for _ in range(3)), *(10 ** rng.uniform(-1, 3) for _ in range(3)), rng.choice([0.5, 0.9])) for i in range(60)]
    p = spark.createDataFrame(points, "s long, point_id long, x double, y double, z double")
    b = spark.createDataFrame(boxes, "s long, box_id long, cx double, cy double, cz double, sx double, sy double, sz double, confidence double")
    got = {r.point_id: r.box_id for r in spatial.points_in_boxes(p, b, ["s"], 1.0, background=-1).collect()}
    for _, i, *at in points:
        inside = []
        for _, j, *rest in boxes:
            radius = max(abs(a - c) / (s / 2) for a, c, s in zip(at, rest[:3], rest[3:6], strict=True))
            if radius <= 1 + 1e-8:
                inside.append((-rest[6], radius, j))
        assert got[i] == (min(inside)[2] if inside else -1)


def test_sampler_plan_pads_drops_and_resumes(spark):
    items = spark.createDataFrame([(i,) for i in range(10)], "item long")
    rows = ranking.sampler_plan(items, "item", 4, "s").collect()
    assert len(rows) == 12 and len({(r["rank"], r.step) for r in rows}) == 12 and {r.item for r in rows} == set(range(10))
    kept = ranking.sampler_plan(items, "item", 4, "s", drop_last=True).collect()
    assert len(kept) == 8 and len({r.item for r in kept}) == 8
    later = {(r["rank"], r.step): r.item for r in ranking.sampler_plan(items, "item", 4, "s", resume=1).collect()}
    assert later == {(r["rank"], r.step): r.item for r in rows if r.step >= 1}
    assert len(ranking.sampler_plan(items.limit(1), "item", 4, "s").collect()) == 4


def test_equal_images_are_alike(spark):
    rng = random.Random(3)
    rows = [(0, v, u, x := rng.random(), x if u else x / 2, u < 3, u < 4) for v in range(12) for u in range(12)]
    im = spark.createDataFrame(rows, "frame long, v long, u long, truth double, pred double, truth_mask boolean, pred_mask boolean")
    assert images.structural_similarity(im.withColumn("pred", F.col("truth")), ["frame"], 12, 12).first().ssim == pytest.approx(1)
    assert images.structural_similarity(im, ["frame"], 12, 12).first().ssim < 1
    m = images.image_metrics(im.withColumn("pred", F.col("truth")), ["frame"]).first()
    assert m.full_psnr == pytest.approx(120) and m.mask_iou == pytest.approx(0.75)


def test_split_vertices_part_surfaces_that_touch(spark):
    # two triangles that share one vertex, and three at one edge
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 2, 3, 4), (1, 2, 0, 1, 2), (1, 3, 0, 1, 3), (1, 4, 0, 1, 4)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    rows = mesh.split_vertices(f).collect()
    assert len({r.part for r in rows}) == 15 and len(rows) == 15
    two = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 2, 1, 3)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    assert len({r.part for r in mesh.split_vertices(two).collect()}) == 4


def test_hub_and_long_paths_are_components(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(61)) and got[5000] == 5000


def test_tables_go_with_their_owner(spark):
    root = tables.checkpoint_root(spark)
    before = set(os.listdir(root))
    with tables.temporary_tables():
        df = tables.materialize(spark.range(5), "mine")
        assert df.count() == 5 and set(os.listdir(root)) - before
    assert set(os.listdir(root)) == before


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = {"spark.master": "spark://host:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.checkpoint_root(session)
    session.sparkContext.getCheckpointDir = lambda: "hdfs://shared/"
    assert tables.checkpoint_root(session) == "hdfs://shared"
