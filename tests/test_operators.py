"""Golden vectors, and brute-force versions on small random inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenarium.functions import semantics as S
from scenarium.operators import graph, lineage, mesh, ranking, rollups, spatial, voxels


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_vote_golden(spark):
    p = spark.createDataFrame([(7, 3), (7, 3), (7, 8), (9, 4), (2, 5), (2, 6)], "key long, label int")
    assert rows(voxels.vote(p, ["key"]), "key", "label", "n_labels", "minority", "tie") == [(2, -1, 2, 1, True), (7, 3, 2, 1, False), (9, 4, 1, 0, False)]


def test_transfer_golden(spark):
    points = lambda r: voxels.with_voxels(spark.createDataFrame(r, "x double, y double, z double, label int"), 2.0, 2)
    source = points([(0.1,) * 3 + (4,), (0.2,) * 3 + (4,), (0.3,) * 3 + (9,)])
    dense = points([(0.15,) * 3 + (0,), (1.5,) * 3 + (0,)])
    assert rows(voxels.transfer_labels(dense, source, ["key"]), "x", "label") == [(0.15, 4), (1.5, -1)]


def test_truncation_is_not_floor(spark):
    p = spark.createDataFrame([(-0.4,), (-1.6,), (1.6,), (99.0,)], "x double")
    assert [r[0] for r in p.select(S.trunc_int(F.col("x"))).collect()] == [0, -1, 1, 99]
    assert [r[0] for r in p.select(S.voxel_index(F.col("x"), 4.0, 4)).collect()] == [0, 0, 1, 3]


def test_quantize_edges_and_round_trip(spark):
    values = [-5.0, 0.0, 11.9999, 12.0, 24.0, 99.0]
    q = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.quantize(F.col("x"), 0.0, 24.0).alias("b"))
    q = q.withColumn("back", S.dequantize(F.col("b"), 0.0, 24.0)).collect()
    assert [r.b for r in q] == [0, 0, 511, 511, 1023, 1023]
    assert all(abs(r.x - r.back) <= 24 / 1023 for r in q if 0 <= r.x <= 24)


def test_morton_and_murmur(spark):
    code = lambda x, y, z: sum((x >> i & 1) << 3 * i + 2 | (y >> i & 1) << 3 * i + 1 | (z >> i & 1) << 3 * i for i in range(10))
    at = [(0, 0, 0), (1, 2, 3), (1023, 0, 512), (1023, 1023, 1023)]
    got = spark.createDataFrame(at, "x long, y long, z long").select(S.morton(F.col("x"), F.col("y"), F.col("z")).alias("c")).collect()
    assert [r.c for r in got] == [code(*a) for a in at]

    def mixed(x):
        x ^= x >> 16
        x = x * 0x85EBCA6B & 0xFFFFFFFF
        x ^= x >> 13
        x = x * 0xC2B2AE35 & 0xFFFFFFFF
        return x ^ x >> 16

    numbers = [0, 1, 12345, 2**32 - 1, 2**31]
    got = spark.createDataFrame([(n,) for n in numbers], "x long").select(S.murmur_mix(F.col("x")).alias("h")).collect()
    assert [r.h for r in got] == [mixed(n) for n in numbers]


def test_rotations_agree(spark):
    one = spark.range(1)
    q = S.rotation_from_quaternion(*(F.lit(v) for v in (math.cos(0.3), 0.0, 0.0, math.sin(0.3))))
    e = S.rotation_from_euler(F.lit(0.0), F.lit(0.0), F.lit(0.6))
    assert one.select(S.geodesic(q, e).alias("a")).first().a < 1e-6
    zero = S.rotation_from_quaternion(*(F.lit(0.0),) * 4)
    assert [one.select(zero[i][i].alias("d")).first().d for i in range(3)] == [1.0] * 3


def test_downsample_and_upsample_are_inverse(spark):
    random.seed(1)
    cells = {tuple(random.randrange(8) for _ in range(3)) for _ in range(60)}
    v = spark.createDataFrame([(0, *c, 1.0) for c in cells], "g int, vx long, vy long, vz long, w double")
    assert rows(voxels.upsample(voxels.downsample(v, ["g"], "w"), ["g"]), "vx", "vy", "vz") == sorted(cells, key=str)


def test_closing_fills_a_hole(spark):
    cube = [c for c in itertools.product(range(2, 5), repeat=3) if c != (3, 3, 3)]
    v = spark.createDataFrame([(0, *c) for c in cube], "g int, vx long, vy long, vz long")
    assert rows(voxels.close_voxels(v, ["g"], 8), "vx", "vy", "vz") == sorted(itertools.product(range(2, 5), repeat=3), key=str)


def test_z_buffer_ties_and_invalid(spark):
    o = spark.createDataFrame([(0, 1, 2.0, 5), (0, 1, 2.0, 4), (0, 1, float("nan"), 1), (0, 1, -1.0, 2), (0, None, 1.0, 3), (0, 2, float("inf"), 6)], "view int, cell int, depth double, row int")
    assert rows(ranking.z_buffer(o, "view", "cell", "depth", "row"), "cell", "row") == [(1, 4)]


@pytest.mark.parametrize("hits,want", [([1, 1, 1], 1.0), ([0, 0], 0.0), ([1, 0, 1, 0], (1 + 2 / 3) / 3)])
def test_average_precision(spark, hits, want):
    d = spark.createDataFrame([(0, float(-i), h, 3) for i, h in enumerate(hits)], "k int, s double, hit int, n int")
    got = ranking.average_precision(d, "k", [F.desc("s")], "hit", "n").first().ap
    assert got == pytest.approx(want)


def test_balanced_selection_needs_enough_names(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, n long")
    assert [r[0] for r in ranking.balanced_selection(d, "g", "n", 3).orderBy("g", "rank").select("g").collect()] == ["a", "a", "b"]
    with pytest.raises(Exception, match="fewer names"):
        ranking.balanced_selection(d, "g", "n", 4).collect()


def test_rollup_of_empty_and_incomplete_scenes(spark):
    expected = spark.createDataFrame([(1,), (2,)], "s long")
    r = spark.createDataFrame([(1, "evaluated", 0.5), (1, "failed", 9.0)], "s long, status string, value double")
    got = rollups.coverage_rollup(expected, r, "s", "status", "value")
    assert rows(got, "s", "n", "n_done", "coverage", "mean", "zero_mean") == [(1, 2, 1, 0.5, 0.5, 0.25), (2, 0, 0, 1.0, None, None)]
    assert rollups.benchmark_summary(got).first()["primary"] is None


def test_iou_ignores_no_label(spark):
    p = spark.createDataFrame([(0, 1, 1), (0, 1, -1), (0, -1, 2), (0, 1, 2)], "g int, p int, t int")
    assert rows(rollups.class_iou(p, ["g"], "p", "t"), "class", "intersection", "union") == [(1, 1, 3), (2, 0, 2)]


def test_components_of_a_path_and_self_pair(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)]
    got = rows(graph.connected_components(spark.createDataFrame(path, "src long, dst long")), "node", "component")
    assert dict(got) == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}


TETRA = [(0, 1, 0, 1, 2), (0, 2, 0, 2, 3), (0, 3, 0, 3, 1), (0, 4, 1, 3, 2)]


def test_closed_and_open_meshes(spark):
    schema = "mesh_id int, fid long, v0 long, v1 long, v2 long"
    tetra = spark.createDataFrame(TETRA, schema)
    assert mesh.boundary_edges(tetra).count() == 0 and mesh.edges(tetra).count() == 6
    quad = spark.createDataFrame([(0, 1, 0, 1, 2), (0, 2, 0, 2, 3)], schema)
    assert rows(mesh.boundary_edges(quad), "e0", "e1") == [(0, 1), (0, 3), (1, 2), (2, 3)]
    assert rows(mesh.boundary_loops(quad), "n_edges", "closed") == [(4, True)]
    flipped = spark.createDataFrame([(0, 1, 0, 1, 2), (0, 5, 2, 1, 0)], schema)
    assert rows(mesh.without_duplicates(flipped), "fid", "v0", "v1", "v2") == [(1, 0, 1, 2)]
    fan = spark.createDataFrame([(0, i, 0, 1, i + 2) for i in range(3)], schema)
    assert rows(mesh.without_overfull_edges(fan), "fid") == [(0,), (1,)]
    two = spark.createDataFrame([*TETRA, (0, 9, 10, 11, 12)], schema)
    assert rows(mesh.face_components(two), "fid", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)]


def test_lineage(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(lineage.reconcile(a, b, ["k"]), "k", "side") == [(1, "missing"), (3, "extra")]
    parts = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k long, v string, part int")
    assert rows(lineage.merge_parts(parts, "k", "part", b), "k", "v") == [(1, "y"), (2, None), (3, None)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(0, 5, (80, 3)), np.concatenate([rng.normal(0, 1, (40, 3)), [[90.0, 0, 0]]])
    df = lambda a: spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(a)], "g int, point_id long, x double, y double, z double")
    got = rows(spatial.nearest(df(left), df(right), ["g"], 0.5), "point_id", "nearest_id")
    assert dict(got) == {i: int(((right - p) ** 2).sum(1).argmin()) for i, p in enumerate(left)}
    assert rows(spatial.nearest(df(left[:1]), df(right[:0]), ["g"], 0.5), "point_id", "nearest_id") == [(0, None)]


def test_matchings_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(g, a, b, round(rng.random(), 1)) for g in range(3) for a in range(6) for b in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "g long, a long, b long, iou double")
    want = []
    for g in range(3):
        ua, ub = set(), set()
        for iou, a, b in sorted(((i, a, b) for q, a, b, i in pairs if q == g and i >= 0.2), reverse=True):
            if a not in ua and b not in ub:
                ua.add(a)
                ub.add(b)
                want.append((g, a, b))
    assert rows(spatial.greedy_matches(df, ["g"], 0.2), "g", "a", "b") == sorted(want, key=str)
    boxes = [(g, i, round(rng.random(), 1)) for g in range(3) for i in range(8)]
    links = [(g, a, b, 0.9) for g in range(3) for a in range(8) for b in range(8) if a < b and rng.random() < 0.4]
    kept = []
    for g in range(3):
        own: list[int] = []
        for _, i in sorted((-c, i) for q, i, c in boxes if q == g):
            if not any((g, min(i, k), max(i, k), 0.9) in links for k in own):
                own.append(i)
        kept += [(g, i) for i in own]
    both = spark.createDataFrame([*links, *((g, b, a, i) for g, a, b, i in links)], "g long, a long, b long, iou double")
    got = spatial.suppress(spark.createDataFrame(boxes, "g long, box_id long, confidence double"), both, ["g"], 0.5)
    assert rows(got, "g", "box_id") == sorted(kept, key=str)


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        c = rng.integers(0, 9, (4, 5)).astype(float)
        best = min(sum(c[i, p] for i, p in enumerate(q)) for q in itertools.permutations(range(5), 4))
        found = spatial.hungarian(c)
        assert len({j for _, j in found}) == 4 and sum(c[i, j] for i, j in found) == best


def test_oriented_overlap():
    eye = np.eye(3).ravel()
    c, one = np.zeros(3), np.ones(3)
    assert spatial.box_iou(c, one, eye, c, one, eye) == pytest.approx(1, abs=1e-6)
    assert spatial.box_iou(c, one, eye, c + 5, one, eye) == 0
    assert spatial.box_iou(c, one, eye, c + [0.5, 0, 0], one, eye) == pytest.approx(1 / 3, abs=1e-6)
    r = math.sqrt(0.5)
    turned = np.array([r, -r, 0, r, r, 0, 0, 0, 1.0])
    octagon = 2 * (math.sqrt(2) - 1)
    assert spatial.box_iou(c, one, eye, c, one, turned) == pytest.approx(octagon / (2 - octagon), abs=1e-6)
    assert spatial.box_iou(c, one * 0, eye, c, one, eye) == 0


def test_hilbert_steps_to_neighbours(spark):
    from scenarium.operators import grouped

    cells = list(itertools.product(range(4), repeat=3))
    got = spark.createDataFrame(cells, "x long, y long, z long").withColumn("h", grouped.hilbert("x", "y", "z")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(64))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in itertools.pairwise(got))


def test_tour_segments_and_alignment(spark):
    from scenarium.operators import grouped

    stops = spark.createDataFrame([(0, i, float(x), 0.0, 0.0, 1.0, 0.0, 0.0) for i, x in enumerate((0, 9, 2, 5))], "g long, item long, x double, y double, z double, fx double, fy double, fz double")
    assert [r["item"] for r in grouped.greedy_tour(stops, "g").orderBy("rank").collect()] == [0, 2, 3, 1]
    lines = spark.createDataFrame([(0, 1, 0.0, 0.0, 9.0, 0.0), (0, 2, 1.0, 0.2, 4.0, 0.2), (0, 3, 1.0, 3.0, 4.0, 3.0), (0, 4, 0.0, 0.0, 0.0, 5.0)], "g long, item long, x0 double, y0 double, x1 double, y1 double")
    assert rows(grouped.distinct_segments(lines, "g"), "item") == [(1,), (3,), (4,)]
    a = np.random.default_rng(6).normal(size=(30, 3))
    turned = 1.3 * a @ np.array([[0.995, -0.0998, 0], [0.0998, 0.995, 0], [0, 0, 1.0]]).T + 0.05
    p = spark.createDataFrame([(0, s, *map(float, q)) for s, side in enumerate((a, turned)) for q in side], "g long, side int, x double, y double, z double")
    assert grouped.trimmed_alignment(p, "g", keep=1.0).first().scale == pytest.approx(1.3, abs=0.2)


def test_mesh_repairs(spark):
    schema = "mesh_id int, fid long, v0 long, v1 long, v2 long"
    f = spark.createDataFrame(TETRA[:3], schema)
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 0.0, 0.0)], "mesh_id int, vid long, x double, y double, z double")
    new, fan = mesh.filled_holes(f, v, 100.0)
    assert rows(fan, "v0", "v1", "v2") == [(1, 2, -1), (1, 3, -1), (2, 3, -1)]
    assert new.first().x == pytest.approx(1 / 3)
    assert mesh.filled_holes(f, v, 1.0)[1].count() == 0
    turned = spark.createDataFrame([TETRA[0], (0, 2, 0, 3, 2), *TETRA[2:]], schema)
    assert rows(mesh.oriented(turned), "fid", "v0", "v1", "v2") == [(f_, a, b, c) for _, f_, a, b, c in TETRA]
