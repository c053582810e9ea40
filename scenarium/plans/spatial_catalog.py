"""Registered queries of the spatial joins and matchings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import spatial
from scenarium.plans.catalog import query, rounded
from scenarium.plans.derived import BOXES, POINTS, VOXELS, boxes, points, table, voxel_points

SMALL = """small AS (SELECT vec_id AS point_id, vec_id % 4 AS scene_id, (CAST(embedding[1] AS DOUBLE) + 1) * 12 AS x, (CAST(embedding[2] AS DOUBLE) + 1) * 12 AS y, (CAST(embedding[3] AS DOUBLE) + 1) * 12 AS z, label FROM embeddings)"""
NEAREST = f"""{SMALL}, d AS (SELECT a.scene_id, a.point_id, b.point_id AS nearest_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS distance
FROM small a JOIN small b ON a.scene_id = b.scene_id AND a.point_id % 3 <> 0 AND b.point_id % 3 = 0),
nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY distance, nearest_id) = 1)"""


def small_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 4).alias("scene_id"), *(((F.col("embedding")[i].cast("double") + 1) * 12).alias(a) for i, a in enumerate("xyz")), "label")


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    p = small_points(spark, sf)
    return spatial.nearest(p.where("point_id % 3 <> 0"), p.where("point_id % 3 = 0"), ["scene_id"], 1.0)


@query(f"WITH {NEAREST} SELECT scene_id, point_id, nearest_id, round(distance, 6) AS distance FROM nn")
def j02_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_nearest(spark, sf), "distance")


@query(f"WITH {NEAREST} SELECT nn.point_id, round(distance, 6) AS distance, CASE WHEN distance <= 1.0 THEN s.label ELSE -1 END AS label FROM nn JOIN small s ON s.point_id = nearest_id")
def j03_radius_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.label_within(_nearest(spark, sf), small_points(spark, sf), 1.0), "distance")


@query(f"WITH {NEAREST} SELECT nn.point_id, round(CASE WHEN distance <= 1.5 THEN a.x + 0.5::DOUBLE * (b.x - a.x) ELSE a.x END, 6) AS x, distance <= 1.5 AS moved FROM nn JOIN small a USING (point_id) JOIN small b ON b.point_id = nearest_id")
def j04_snap(spark: SparkSession, sf: str) -> DataFrame:
    p = small_points(spark, sf)
    to = p.select(F.col("point_id").alias("nearest_id"), F.col("x").alias("to_x"))
    rows = _nearest(spark, sf).join(p.select("point_id", "x"), "point_id").join(to, "nearest_id")
    moved = F.col("distance") <= 1.5
    return rows.select("point_id", F.round(F.when(moved, F.col("x") + 0.5 * (F.col("to_x") - F.col("x"))).otherwise(F.col("x")), 6).alias("x"), moved.alias("moved"))


INSIDE = f"""{POINTS}, {BOXES}, r AS (SELECT point_id, box_id, confidence, greatest(abs(x - cx) / (sx / 2), abs(y - cy) / (sy / 2), abs(z - cz) / (sz / 2)) AS radius FROM pts JOIN boxes USING (scene_id)
WHERE abs(x - cx) <= sx AND abs(y - cy) <= sy AND abs(z - cz) <= sz)"""


@query(f"WITH {INSIDE}, w AS (SELECT * FROM r WHERE radius <= 1 + 1e-8 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY confidence DESC, radius, box_id) = 1) SELECT point_id, coalesce(box_id, 0) AS box_id FROM pts LEFT JOIN w USING (point_id)")
def j05_points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.points_in_boxes(points(spark, sf), boxes(spark, sf), ["scene_id"], 3.0)


@query(f"WITH {INSIDE}, w AS (SELECT * FROM r WHERE radius <= 1 + 1e-8 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY radius, confidence DESC, box_id) = 1) SELECT point_id, coalesce(box_id, 0) AS box_id FROM pts LEFT JOIN w USING (point_id)")
def j05b_points_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.points_in_boxes(points(spark, sf), boxes(spark, sf), ["scene_id"], 3.0, by_depth=True)


SHARED = f"""{BOXES}, o AS (SELECT a.scene_id, a.box_id AS a, b.box_id AS b, least(a.cx + a.sx / 2, b.cx + b.sx / 2) - greatest(a.cx - a.sx / 2, b.cx - b.sx / 2) AS dx,
least(a.cy + a.sy / 2, b.cy + b.sy / 2) - greatest(a.cy - a.sy / 2, b.cy - b.sy / 2) AS dy, least(a.cz + a.sz / 2, b.cz + b.sz / 2) - greatest(a.cz - a.sz / 2, b.cz - b.sz / 2) AS dz,
a.sx * a.sy * a.sz AS va, b.sx * b.sy * b.sz AS vb FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND a.box_id // 8 % 2 = 0 AND b.box_id // 8 % 2 = 1)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("half", F.floor(F.col("box_id") / 8) % 2)
    return spatial.overlaps(b.where("half = 0"), b.where("half = 1"), ["scene_id"], 3.0)


@query(f"WITH {SHARED} SELECT scene_id, a, b, round(dx * dy * dz / (va + vb - dx * dy * dz), 6) AS iou FROM o WHERE dx > 0 AND dy > 0 AND dz > 0")
def j06_box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pairs(spark, sf), "iou")


@query()
def j06b_oriented_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose circumscribed cuboids share volume, each box turned about z by its own angle."""
    b = boxes(spark, sf)
    turn = F.col("box_id") % 7 / 7.0
    r = F.array(F.cos(turn), -F.sin(turn), F.lit(0.0), F.sin(turn), F.cos(turn), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    turned = b.select("box_id", F.struct(F.array("cx", "cy", "cz").alias("c"), F.array("sx", "sy", "sz").alias("s"), r.alias("r")).alias("box"))
    side = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    round_ = b.withColumns({"sx": side, "sy": side}).withColumn("half", F.floor(F.col("box_id") / 8) % 2)
    near = spatial.overlaps(round_.where("half = 0"), round_.where("half = 1"), ["scene_id"], 4.0).drop("iou")
    pairs = near.join(turned.select(F.col("box_id").alias("a"), F.col("box").alias("_a")), "a").join(turned.select(F.col("box_id").alias("b"), F.col("box").alias("_b")), "b")
    out = spatial.oriented_iou(pairs.select("scene_id", F.col("a").alias("pred"), F.col("b").alias("truth"), F.col("_a").alias("a"), F.col("_b").alias("b")))
    return out.select("scene_id", "pred", "truth", F.round("iou", 6).alias("iou"))


PAIRS = f"{SHARED}, pairs AS (SELECT scene_id, a, b, dx * dy * dz / (va + vb - dx * dy * dz) AS iou FROM o WHERE dx > 0 AND dy > 0 AND dz > 0)"


@query(f"""WITH RECURSIVE {PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY iou DESC, a DESC, b DESC) AS n FROM pairs WHERE iou >= 0.1),
g AS (SELECT scene_id, 0::BIGINT AS n, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS iou FROM q WHERE n = 1
UNION ALL SELECT g.scene_id, q.n, CASE WHEN free THEN list_append(used_a, q.a) ELSE used_a END, CASE WHEN free THEN list_append(used_b, q.b) ELSE used_b END, CASE WHEN free THEN q.a END, CASE WHEN free THEN q.b END, q.iou
FROM g JOIN q ON q.scene_id = g.scene_id AND q.n = g.n + 1, LATERAL (SELECT NOT list_contains(used_a, q.a) AND NOT list_contains(used_b, q.b) AS free))
SELECT scene_id, a, b, round(iou, 6) AS iou FROM g WHERE a IS NOT NULL""")
def j07_greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.greedy_matches(_pairs(spark, sf), ["scene_id"], 0.1), "iou")


@query(f"""WITH RECURSIVE {PAIRS}, c AS (SELECT scene_id, a AS box_id, list({{'b': b, 'iou': iou}} ORDER BY iou DESC, b) AS options FROM pairs WHERE iou >= 0.1 GROUP BY ALL),
q AS (SELECT scene_id, box_id AS pred, coalesce(options, []) AS options, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, box_id) AS n FROM boxes LEFT JOIN c USING (scene_id, box_id) WHERE box_id // 8 % 2 = 0),
g AS (SELECT scene_id, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS pred, NULL::STRUCT(b BIGINT, iou DOUBLE) AS best FROM q WHERE n = 1
UNION ALL SELECT g.scene_id, q.n, CASE WHEN t IS NULL THEN used ELSE list_append(used, t.b) END, q.pred, t FROM g JOIN q ON q.scene_id = g.scene_id AND q.n = g.n + 1,
LATERAL (SELECT list_filter(q.options, lambda x: NOT list_contains(used, x.b))[1] AS t))
SELECT scene_id, pred, best.b AS truth, round(best.iou, 6) AS iou FROM g WHERE pred IS NOT NULL""")
def j08_confident_match(spark: SparkSession, sf: str) -> DataFrame:
    half = boxes(spark, sf).where(F.floor(F.col("box_id") / 8) % 2 == 0)
    return rounded(spatial.confident_matches(_pairs(spark, sf), half, "scene_id", 0.1), "iou")


@query()
def j09_optimal_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the plane are the groups, so that each stays small however many boxes there are."""
    pairs = _pairs(spark, sf).withColumn("cost", 1 - F.col("iou"))
    b = boxes(spark, sf).select(F.col("box_id").alias("a"), (F.floor(F.col("cx") / 6) * 1000 + F.floor(F.col("cy") / 6) * 10 + F.col("scene_id")).cast("long").alias("cell"))
    return spatial.optimal_assignment(pairs.join(b, "a").select("cell", "a", "b", "cost"), "cell").withColumn("cost", F.round("cost", 6))


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, box_id) AS n FROM boxes),
o AS (SELECT a.scene_id, b.n, list(a.box_id) AS better FROM r a JOIN r b ON a.scene_id = b.scene_id AND a.n < b.n,
LATERAL (SELECT greatest(0, least(a.cx + a.sx / 2, b.cx + b.sx / 2) - greatest(a.cx - a.sx / 2, b.cx - b.sx / 2)) * greatest(0, least(a.cy + a.sy / 2, b.cy + b.sy / 2) - greatest(a.cy - a.sy / 2, b.cy - b.sy / 2))
* greatest(0, least(a.cz + a.sz / 2, b.cz + b.sz / 2) - greatest(a.cz - a.sz / 2, b.cz - b.sz / 2)) AS v) WHERE v / (a.sx * a.sy * a.sz + b.sx * b.sy * b.sz - v) > 0.25 GROUP BY ALL),
q AS (SELECT r.scene_id, r.n, box_id, coalesce(better, []) AS better FROM r LEFT JOIN o USING (scene_id, n)),
k AS (SELECT scene_id, n, [box_id] AS kept, TRUE AS stays, box_id FROM q WHERE n = 1 UNION ALL
SELECT k.scene_id, q.n, CASE WHEN list_has_any(kept, better) THEN kept ELSE list_append(kept, q.box_id) END, NOT list_has_any(kept, better), q.box_id FROM k JOIN q ON q.scene_id = k.scene_id AND q.n = k.n + 1)
SELECT scene_id, box_id FROM k WHERE stays""")
def j10_suppression(spark: SparkSession, sf: str) -> DataFrame:
    b = spatial.best_of_equal(boxes(spark, sf), ["scene_id"])
    pairs = spatial.overlaps(b, b, ["scene_id"], 3.0).where("a <> b")
    return spatial.suppress(b, pairs, ["scene_id"], 0.25)


@query(f"""WITH RECURSIVE {VOXELS}, p AS (SELECT scene_id, label, arg_min({{'i': point_id, 'x': x, 'y': y, 'z': z}}, point_id) AS p FROM vox GROUP BY scene_id, label, key),
f AS (SELECT scene_id, label, p, 0::BIGINT AS step, first_value(p) OVER (PARTITION BY scene_id, label ORDER BY p.i) AS pick, count(*) OVER (PARTITION BY scene_id, label) AS n, 'inf'::DOUBLE AS far FROM p
UNION ALL SELECT scene_id, label, p, step + 1, first_value(p) OVER (PARTITION BY scene_id, label ORDER BY near DESC, p.i), n, near
FROM (SELECT *, least(far, (p.x - pick.x) * (p.x - pick.x) + (p.y - pick.y) * (p.y - pick.y) + (p.z - pick.z) * (p.z - pick.z)) AS near FROM f WHERE step < 7))
SELECT DISTINCT scene_id, label, pick.i AS point_id, step AS rank FROM f WHERE step < n""")
def w02_farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point a voxel, then the farthest ones of each scene and label."""
    v = voxel_points(spark, sf)
    first = v.groupBy("scene_id", "label", "key").agg(F.min_by(F.struct("point_id", "x", "y", "z"), "point_id").alias("p")).select("scene_id", "label", "p.*")
    return spatial.farthest_points(first, ["scene_id", "label"], 8)


@query("""WITH RECURSIVE q AS (SELECT source, doc_id AS item, n_chars AS w, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
s AS (SELECT source, 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS item, NULL::BIGINT AS worker FROM q WHERE n = 1
UNION ALL SELECT s.source, q.n, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + q.w ELSE x END), q.item, list_position(load, list_min(load)) - 1 FROM s JOIN q ON s.source = q.source AND q.n = s.n + 1)
SELECT source, item, worker FROM s WHERE item IS NOT NULL""")
def w11b_least_loaded(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("item"), F.col("n_chars").alias("weight"))
    return spatial.least_loaded(d, "source", 4)
