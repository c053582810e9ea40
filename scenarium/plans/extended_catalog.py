"""Registered queries over images, samplers, manifests and fitted boxes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.functions import semantics as S
from scenarium.operators import lineage, frames, images, mesh, ranking, regions, rollups, spatial, voxels
from scenarium.plans.catalog import query, rounded
from scenarium.plans.derived import BOXES, FACES, POINTS, VOXELS, boxes, faces, points, table, voxel_points
from scenarium.plans.materialize import checkpoint_root
from scenarium.plans.pose_catalog import LATTICE
from scenarium.plans.scene_catalog import OK, PIXELS, pixels
from scenarium.sources import readers

# Two images for each frame: depths over 50, and their negative or a shifted copy, with masks; complete grids.
GRIDS = f"""{PIXELS}, grid AS (SELECT frame, v, u FROM (SELECT DISTINCT frame FROM px), range(48) a(v), range(64) b(u)), im AS (SELECT frame, v, u, round(d / 50, 6) AS truth, round(least(1.0, d / 50 + ((v * 7 + u * 3) % 11) / 50.0::DOUBLE), 6) AS pred,
d > 10 AND v BETWEEN 8 AND 30 AS truth_mask, d > 12 AND v BETWEEN 10 AND 34 AS pred_mask FROM (SELECT grid.*, CASE WHEN {OK.format(50)} THEN depth ELSE 0 END AS d FROM grid LEFT JOIN px USING (frame, v, u)))"""


def image_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    grid = p.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(47)).cast("array<bigint>")).alias("v")).select("*", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")).alias("u"))
    d = F.when(frames.valid_depth(F.col("depth")), F.col("depth")).otherwise(0.0)
    rows = grid.join(p, ["frame", "v", "u"], "left").withColumn("d", d)
    noise = ((F.col("v") * 7 + F.col("u") * 3) % 11) / 50.0
    return rows.select("frame", "v", "u", F.round(F.col("d") / 50, 6).alias("truth"), F.round(F.least(F.lit(1.0), F.col("d") / 50 + noise), 6).alias("pred"), ((F.col("d") > 10) & F.col("v").between(8, 30)).alias("truth_mask"), ((F.col("d") > 12) & F.col("v").between(10, 34)).alias("pred_mask"))


@query(f"""WITH {GRIDS}, b AS (SELECT frame, min(v) FILTER (o) AS v0, max(v) FILTER (o) AS v1, min(u) FILTER (o) AS u0, max(u) FILTER (o) AS u1 FROM (SELECT *, truth_mask OR pred_mask AS o FROM im) GROUP BY frame),
e AS (SELECT *, (pred - truth) * (pred - truth) AS d2, v0 IS NULL OR (v BETWEEN v0 - 4 AND v1 + 4 AND u BETWEEN u0 - 4 AND u1 + 4) AS crop FROM im JOIN b USING (frame))
SELECT frame, round(avg(abs(pred - truth)), 6) AS l1, round(sqrt(avg(d2)), 6) AS rmse, round(-10 * log10(greatest(avg(d2), 1e-12)), 4) AS full_psnr, round(-10 * log10(greatest(avg(d2) FILTER (crop), 1e-12)), 4) AS crop_psnr,
CASE WHEN count(*) FILTER (truth_mask AND pred_mask) > 0 THEN round(-10 * log10(greatest(avg(d2) FILTER (truth_mask AND pred_mask), 1e-12)), 4) END AS intersection_psnr, CASE WHEN count(*) FILTER (truth_mask) > 0 THEN round(-10 * log10(greatest(avg(d2) FILTER (truth_mask), 1e-12)), 4) END AS foreground_psnr,
round(count(*) FILTER (truth_mask AND pred_mask) / greatest(count(*) FILTER (truth_mask OR pred_mask), 1), 6) AS mask_iou, round(avg(CAST(truth_mask AS INTEGER)), 6) AS truth_coverage, round(avg(CAST(pred_mask AS INTEGER)), 6) AS pred_coverage FROM e GROUP BY frame""")
def a16b_masked_image_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = rounded(images.image_metrics(image_pairs(spark, sf), ["frame"]), "l1", "rmse", "mask_iou", "truth_coverage", "pred_coverage")
    return rounded(m, "full_psnr", "crop_psnr", "intersection_psnr", "foreground_psnr", digits=4)


@query(f"""WITH {GRIDS}, m AS (SELECT a.frame, a.v, a.u, avg(b.pred) AS p, avg(b.truth) AS t, avg(b.pred * b.pred) AS pp, avg(b.truth * b.truth) AS tt, avg(b.pred * b.truth) AS pt
FROM im a JOIN im b ON a.frame = b.frame AND b.v BETWEEN a.v - 3 AND a.v + 3 AND b.u BETWEEN a.u - 3 AND a.u + 3 WHERE a.v BETWEEN 3 AND 44 AND a.u BETWEEN 3 AND 60 GROUP BY ALL),
s AS (SELECT frame, (2 * p * t + 0.0001::DOUBLE) * (2 * 49 / 48.0::DOUBLE * (pt - p * t) + 0.0009::DOUBLE) / ((p * p + t * t + 0.0001::DOUBLE) * (49 / 48.0::DOUBLE * (pp - p * p + tt - t * t) + 0.0009::DOUBLE)) AS s FROM m)
SELECT frame, round(avg(s), 5) AS ssim FROM s GROUP BY frame""")
def a16c_structural_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(images.structural_similarity(image_pairs(spark, sf), ["frame"], 48, 64), "ssim", digits=5)


@query(f"""WITH {PIXELS}, c AS (SELECT frame, v, u, depth AS d, (u - 32) * depth / 50.0::DOUBLE AS a, -(v - 24) * depth / 50.0::DOUBLE AS b, sqrt((frame - 12) ** 2 + 144 + 9) AS n FROM px WHERE v % 3 > 0 AND NOT isnan(depth) AND depth > 0),
f AS (SELECT *, (12 - frame) / n AS fx, 12 / n AS fy, -3 / n AS fz FROM c), r AS (SELECT *, fy / sqrt(fx * fx + fy * fy) AS rx, -fx / sqrt(fx * fx + fy * fy) AS ry FROM f)
SELECT frame, v, u, round(frame + a * rx + b * ry * fz + d * fx, 4) AS x, round(a * ry - b * rx * fz + d * fy, 4) AS y, round(5 + b * (rx * fy - ry * fx) + d * fz, 4) AS z FROM r""")
def p03_masked_unprojection(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras at (frame, 0, 5) look at (12, 12, 2)."""
    p = pixels(spark, sf).withColumn("mask", F.col("v") % 3 > 0)
    eye = [F.col("frame").cast("double"), F.lit(0.0), F.lit(5.0)]
    w = images.world_points(p, eye, [F.lit(12.0), F.lit(12.0), F.lit(2.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], 50.0, 50.0, 32.0, 24.0)
    return rounded(w, "x", "y", "z", digits=4).select("frame", "v", "u", "x", "y", "z")


@query(f"""WITH {PIXELS}, p AS (SELECT frame, v, u, CASE WHEN isnan(depth) THEN 0 ELSE depth END AS d FROM px)
SELECT frame, v // 4 AS v, u // 4 AS u, round(avg(d) FILTER (v % 4 IN (1, 2) AND u % 4 IN (1, 2)), 6) AS rgb, max(d) FILTER (v % 4 = 0 AND u % 4 = 0) AS depth FROM p GROUP BY frame, v // 4, u // 4""")
def p30_downsampled(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("depth", F.when(F.isnan("depth"), 0.0).otherwise(F.col("depth"))).withColumn("rgb", F.col("depth"))
    return rounded(images.downsampled(p, ["frame"], 4, 48, 64, ["rgb"], ["depth"]), "rgb")


@query(f"""WITH {POINTS}, p AS (SELECT scene_id, label % 6 - 1 AS a, (label + point_id % 2) % 6 - 1 AS b FROM pts), c AS (SELECT scene_id, k AS class, count(*) FILTER (a = k AND b = k) AS i, count(*) FILTER (a = k OR b = k) AS n, count(*) FILTER (b = k) AS t FROM p, range(5) r(k) GROUP BY ALL)
SELECT scene_id, round(avg(i / n) FILTER (n > 0), 6) AS mean_iou, round(avg(i / n) FILTER (i > 0), 6) AS matched_iou, round(avg(i / n) FILTER (t > 0), 6) AS all_true_iou, count(*) FILTER (n > 0) AS classes FROM c GROUP BY scene_id""")
def a13b_mean_iou(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("scene_id", (F.col("label") % 6 - 1).cast("long").alias("a"), ((F.col("label") + F.col("point_id") % 2) % 6 - 1).cast("long").alias("b"))
    return rounded(rollups.mean_iou(p, ["scene_id"], "a", "b"), "mean_iou", "matched_iou", "all_true_iou")


@query(f"""WITH {LATTICE}, n AS (SELECT frame, v, u, z, -az * by_ AS nx, -ax * bz AS ny, ax * by_ AS nz FROM d), k AS (SELECT frame, v, u, z, nz / sqrt(nx * nx + ny * ny + nz * nz) AS c FROM n), h AS (SELECT frame, quantile_cont(z, 0.01) AS f, quantile_cont(z, 0.99) AS g FROM l GROUP BY frame)
SELECT frame, v, u, coalesce(abs(c) <= 0.3, FALSE) AS is_vertical, coalesce(abs(c) >= 0.8, FALSE) AS is_horizontal, coalesce(abs(c) >= 0.8, FALSE) AND z <= f + 0.1 AS is_floor, coalesce(abs(c) >= 0.8, FALSE) AND z >= g - 0.1 AS is_ceiling FROM k JOIN h USING (frame)""")
def a21b_surface_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).where(frames.valid_depth(F.col("depth"), 1000.0))
    n = frames.lattice_normals(p.withColumns({"x": F.col("u") * 0.1, "y": F.col("v") * 0.1, "z": F.col("depth")}), ["frame"])
    return rollups.surface_classes(n, ["frame"], 0.3, 0.8).select("frame", "v", "u", "is_vertical", "is_horizontal", "is_floor", "is_ceiling")


@query(f"""WITH {POINTS}, {BOXES}, n AS (SELECT scene_id, label, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE label > 0 GROUP BY ALL HAVING count(*) >= 20),
h AS (SELECT p.scene_id, label, box_id, count(*) AS k FROM pts p JOIN boxes b ON p.scene_id = b.scene_id AND label > 0 AND abs(x - cx) <= sx / 2 AND abs(y - cy) <= sy / 2 AND abs(z - cz) <= sz / 2 GROUP BY ALL),
m AS (SELECT scene_id, label, max(k) AS k FROM h GROUP BY ALL), c AS (SELECT scene_id, label, EXISTS (SELECT 1 FROM boxes b WHERE b.scene_id = n.scene_id AND abs(x - cx) <= sx / 2 AND abs(y - cy) <= sy / 2 AND abs(z - cz) <= sz / 2) AS hit FROM n),
u AS (SELECT b.scene_id, b.box_id, coalesce(max(k) / sum(k), 0) AS purity FROM boxes b LEFT JOIN h ON h.box_id = b.box_id GROUP BY ALL), g AS (SELECT scene_id, avg(purity) AS purity FROM u GROUP BY scene_id)
SELECT scene_id, round(avg(CAST(hit AS INTEGER)), 6) AS centre_recall, round(avg(CAST(coalesce(k, 0) >= 0.1::DOUBLE * n AS INTEGER)), 6) AS recall10, round(avg(CAST(coalesce(k, 0) >= 0.5::DOUBLE * n AS INTEGER)), 6) AS recall50, round(avg(coalesce(k, 0) / n), 6) AS best, round(any_value(purity), 6) AS purity
FROM n JOIN c USING (scene_id, label) LEFT JOIN m USING (scene_id, label) JOIN g USING (scene_id) GROUP BY scene_id""")
def a22b_full_box_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = spatial.box_coverage(points(spark, sf).where("label > 0"), boxes(spark, sf), ["scene_id"], "label", 3.0, 20)
    return rounded(c, "centre_recall", "recall10", "recall50", "best", "purity")


@query(f"""WITH {POINTS}, m AS (SELECT scene_id, median(x) AS mx, median(y) AS my FROM pts GROUP BY scene_id), d AS (SELECT *, x - mx AS dx, y - my AS dy FROM pts JOIN m USING (scene_id)),
w AS (SELECT scene_id, 0.5::DOUBLE * atan2(2 * avg(dx * dy), avg(dx * dx) - avg(dy * dy)) AS yaw FROM d GROUP BY scene_id), t AS (SELECT *, cos(yaw) * dx + sin(yaw) * dy AS s, cos(yaw) * dy - sin(yaw) * dx AS r FROM d JOIN w USING (scene_id)),
q AS (SELECT scene_id, mx, my, yaw, quantile_cont(s, 0.02) AS s0, quantile_cont(s, 0.98) AS s1, quantile_cont(r, 0.02) AS r0, quantile_cont(r, 0.98) AS r1, quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1 FROM t GROUP BY ALL)
SELECT scene_id, round(mx + cos(yaw) * (s0 + s1) / 2 - sin(yaw) * (r0 + r1) / 2, 4) AS cx, round(my + sin(yaw) * (s0 + s1) / 2 + cos(yaw) * (r0 + r1) / 2, 4) AS cy, round((z0 + z1) / 2, 4) AS cz, round(yaw, 4) AS yaw, round(greatest(greatest(s1 - s0, r1 - r0, z1 - z0) * 1.05::DOUBLE, 1e-4), 4) AS scale FROM q""")
def a24b_oriented_box(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.oriented_box(points(spark, sf), ["scene_id"], 0.02, 1.05), "cx", "cy", "cz", "yaw", "scale", digits=4)


SEGMENTS = f"""{POINTS}, s AS (SELECT scene_id, degrees(atan2(max(y) - min(y) + label % 5, max(x) - min(x))) AS angle, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y) + label % 5) ** 2) AS length FROM pts GROUP BY scene_id, label)"""


@query(f"""WITH {SEGMENTS}, t AS (SELECT scene_id, k, length, ((angle + k * 0.05::DOUBLE) % 90 + 90) % 90 AS a FROM s, range(1800) r(k) WHERE length >= 0.3), v AS (SELECT scene_id, k, count(*) FILTER (least(a, 90 - a) <= 5) AS n, round(coalesce(sum(length) FILTER (least(a, 90 - a) <= 5), 0), 6) AS len FROM t GROUP BY ALL),
b AS (SELECT scene_id, arg_max(k, (n, len, -k)) AS k FROM v GROUP BY scene_id), o AS (SELECT scene_id, k, sum(CASE WHEN a > 45 THEN a - 90 ELSE a END * length) / sum(length) AS off, count(*) AS aligned FROM t JOIN b USING (scene_id, k) WHERE least(a, 90 - a) <= 5 GROUP BY ALL)
SELECT scene_id, round(((k * 0.05::DOUBLE - off + 45) % 90 + 90) % 90 - 45, 4) AS turn, aligned FROM o""")
def a27b_refined_alignment(spark: SparkSession, sf: str) -> DataFrame:
    s = points(spark, sf).groupBy("scene_id", "label").agg((F.max("y") - F.min("y") + F.col("label") % 5).alias("dy"), (F.max("x") - F.min("x")).alias("dx"))
    s = s.select("scene_id", F.degrees(F.atan2("dy", "dx")).alias("angle"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("length"))
    return rounded(rollups.alignment_vote(s, ["scene_id"]), "turn", digits=4)


PLAN = """o AS (SELECT doc_id AS item, row_number() OVER (ORDER BY sha256('3:' || doc_id), doc_id) - 1 AS n, count(*) OVER () AS m FROM documents), p AS (SELECT item, unnest(range(n, CAST(ceil(m / 6) * 6 AS BIGINT), m)) AS n FROM o),
plan AS (SELECT n % 6 AS rank, n // 6 AS step, item FROM p)"""


@query(f"WITH {PLAN} SELECT rank, step, item FROM plan WHERE step >= 10")
def w22_sampler_plan(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sampler_plan(table(spark, sf, "documents"), "doc_id", 6, "3", resume=10)


@query(f"""WITH RECURSIVE {PLAN}, q AS (SELECT item, n_chars AS load, step // 4 AS batch, row_number() OVER (PARTITION BY step // 4 ORDER BY n_chars DESC, item) AS i, count(*) OVER (PARTITION BY step // 4) AS n FROM plan JOIN documents ON doc_id = item),
g AS (SELECT batch, 0::BIGINT AS i, [0, 0, 0, 0, 0, 0]::BIGINT[] AS sums, [4, 4, 4, 4, 4, 4]::BIGINT[] AS room, NULL::BIGINT AS item, NULL::BIGINT AS rank FROM q WHERE i = 1 AND n = 24
UNION ALL SELECT batch, i + 1, list_transform(sums, lambda x, k: CASE WHEN k = slot THEN x + load ELSE x END), list_transform(room, lambda x, k: CASE WHEN k = slot THEN x - 1 ELSE x END), next, slot - 1 FROM
(SELECT g.batch, g.i, g.sums, g.room, q.load, q.item AS next, list_position(list_transform(sums, lambda x, k: CASE WHEN room[k] > 0 THEN x ELSE 9000000000000 END), list_min(list_transform(sums, lambda x, k: CASE WHEN room[k] > 0 THEN x ELSE 9000000000000 END))) AS slot FROM g JOIN q ON q.batch = g.batch AND q.i = g.i + 1))
SELECT batch, item, rank FROM g WHERE item IS NOT NULL""")
def w22b_balanced_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    plan = ranking.sampler_plan(d, "doc_id", 6, "3").join(d.select(F.col("doc_id").alias("item"), F.col("n_chars").alias("load")), "item")
    return ranking.balanced_batches(plan, "load", 6, 4).select("batch", "item", "rank")


@query(f"""WITH RECURSIVE {VOXELS}, p AS (SELECT scene_id, label, arg_min({{'i': point_id, 'x': x, 'y': y, 'z': z}}, point_id) AS p FROM vox GROUP BY scene_id, label, key),
f AS (SELECT scene_id, label, p, 0::BIGINT AS step, first_value(p) OVER (PARTITION BY scene_id, label ORDER BY p.i) AS pick, count(*) OVER (PARTITION BY scene_id, label) AS n, 'inf'::DOUBLE AS far FROM p
UNION ALL SELECT scene_id, label, p, step + 1, first_value(p) OVER (PARTITION BY scene_id, label ORDER BY near DESC, p.i), n, near
FROM (SELECT *, least(far, (p.x - pick.x) * (p.x - pick.x) + (p.y - pick.y) * (p.y - pick.y) + (p.z - pick.z) * (p.z - pick.z)) AS near FROM f WHERE step < 5))
SELECT DISTINCT scene_id, label, CAST(step AS INTEGER) AS slot, CASE WHEN step < n THEN pick.i END AS point_id, step < n AS filled FROM f""")
def w08b_padded_farthest(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf)
    first = v.groupBy("scene_id", "label", "key").agg(F.min_by(F.struct("point_id", "x", "y", "z"), "point_id").alias("p")).select("scene_id", "label", "p.*")
    far = spatial.farthest_points(first, ["scene_id", "label"], 6)
    return ranking.padded_samples(far, v.select("scene_id", "label").distinct(), ["scene_id", "label"], "point_id", 6)


FIRST_POINTS = f"""{VOXELS},
p AS (SELECT scene_id, label, p.i AS point_id, p.x AS x, p.y AS y, p.z AS z FROM (SELECT scene_id, label, arg_min({{'i': point_id, 'x': x, 'y': y, 'z': z}}, point_id) AS p FROM vox GROUP BY scene_id, label, key))"""


def _farthest_sql(source: str, most: int) -> str:
    return f"""f AS (
  SELECT *, 0::BIGINT AS step, first_value({{'i': point_id, 'x': x, 'y': y, 'z': z}}) OVER (PARTITION BY scene_id, label ORDER BY point_id) AS pick, count(*) OVER (PARTITION BY scene_id, label) AS n, 'inf'::DOUBLE AS far FROM {source}
  UNION ALL
  SELECT scene_id, label, point_id, x, y, z, step + 1, first_value({{'i': point_id, 'x': x, 'y': y, 'z': z}}) OVER (PARTITION BY scene_id, label ORDER BY near DESC, point_id), n, near
  FROM (SELECT *, least(far, (x - pick.x) * (x - pick.x) + (y - pick.y) * (y - pick.y) + (z - pick.z) * (z - pick.z)) AS near FROM f WHERE step < {most - 1})
),
chosen AS (SELECT DISTINCT scene_id, label, pick.i AS point_id, step AS rank FROM f WHERE step < n)"""


def _first_points(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf)
    return v.groupBy("scene_id", "label", "key").agg(F.min_by(F.struct("point_id", "x", "y", "z"), "point_id").alias("p")).select("scene_id", "label", "p.*")


@query(f"""WITH RECURSIVE {FIRST_POINTS},
e AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, min(z) OVER w AS lz, max(z) OVER w AS hz, count(*) OVER w AS m FROM p WINDOW w AS (PARTITION BY scene_id, label)),
b AS (
  SELECT *, CAST(least(floor((x - lx) / greatest(hx - lx, 1e-6) * 8), 7) AS BIGINT) AS gx, CAST(least(floor((y - ly) / greatest(hy - ly, 1e-6) * 8), 7) AS BIGINT) AS gy,
    CAST(least(floor((z - lz) / greatest(hz - lz, 1e-6) * 8), 7) AS BIGINT) AS gz FROM e
),
near AS (SELECT a.scene_id, a.label, a.point_id, count(*) > 1 AS kept FROM b a JOIN b o ON o.scene_id = a.scene_id AND o.label = a.label AND abs(o.gx - a.gx) <= 1 AND abs(o.gy - a.gy) <= 1 AND abs(o.gz - a.gz) <= 1 GROUP BY ALL),
stay AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY scene_id, label) AS s, count(*) OVER (PARTITION BY scene_id, label) AS m FROM near),
sound AS (SELECT p.* FROM p JOIN stay USING (scene_id, label, point_id) WHERE kept OR s < least(m, 6)),
{_farthest_sql("sound", 6)}
SELECT scene_id, label, point_id, rank FROM chosen""")
def w08c_robust_farthest(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.farthest_points(spatial.supported_points(_first_points(spark, sf), ["scene_id", "label"], 6), ["scene_id", "label"], 6)


@query(f"""WITH RECURSIVE {FIRST_POINTS}, {_farthest_sql("p", 4)},
half AS (SELECT scene_id, label, point_id, min(rank) AS rank FROM chosen GROUP BY ALL),
rest AS (
  SELECT scene_id, label, point_id, row_number() OVER (PARTITION BY scene_id, label ORDER BY sha256('5:' || point_id), point_id) AS place FROM p ANTI JOIN half USING (scene_id, label, point_id)
),
have AS (SELECT scene_id, label, count(*) AS have FROM half GROUP BY ALL)
SELECT * FROM half UNION ALL SELECT scene_id, label, point_id, have + place - 1 FROM rest JOIN have USING (scene_id, label) WHERE place <= 8 - have""")
def w08d_hybrid_sample(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.hybrid_points(_first_points(spark, sf), ["scene_id", "label"], 8, "5")


@query("""WITH s AS (SELECT vec_id, vec_id % 4 AS scene_id, unnest(range(1, 9)) AS mask, unnest(embedding[1:8]) AS score FROM embeddings), l AS (SELECT scene_id, mask, sum(CAST(score AS DOUBLE)) AS logit FROM s GROUP BY ALL),
r AS (SELECT vec_id, mask FROM s JOIN l USING (scene_id, mask) WHERE 1 / (1 + exp(-logit)) > 0.5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, mask) = 1) SELECT vec_id, mask FROM r""")
def f03_valid_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Masks are the first eight components; a mask's validity is the sum of its scores over the scene. Masks that own no point don't appear."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("scene_id"), F.posexplode(F.slice("embedding", 1, 8)).alias("mask", "score")).withColumn("mask", (F.col("mask") + 1).cast("long"))
    logit = e.groupBy("scene_id", "mask").agg(F.sum(F.col("score").cast("double")).alias("logit"))
    return frames.instance_of_scores(e.join(logit, ["scene_id", "mask"]), ["vec_id"], 0.5)


@query(f"""WITH RECURSIVE {FACES}, c AS (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([v0, v1, v2]) AS vid FROM faces),
x AS (SELECT mesh_id, fid, unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b, unnest([fid * 3, fid * 3 + 1, fid * 3 + 2]) AS na, unnest([fid * 3 + 1, fid * 3 + 2, fid * 3]) AS nb FROM faces),
e AS (SELECT mesh_id, least(a, b) AS e0, greatest(a, b) AS e1, fid, CASE WHEN a < b THEN na ELSE nb END AS n0, CASE WHEN a < b THEN nb ELSE na END AS n1 FROM x), t AS (SELECT min(n0) AS p0, max(n0) AS q0, min(n1) AS p1, max(n1) AS q1 FROM e GROUP BY mesh_id, e0, e1 HAVING count(*) = 2),
l AS (SELECT p0 AS a, q0 AS b FROM t UNION SELECT q0, p0 FROM t UNION SELECT p1, q1 FROM t UNION SELECT q1, p1 FROM t), r AS (SELECT fid * 3 + corner AS node, fid * 3 + corner AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
m AS (SELECT node, min(root) AS part FROM r GROUP BY node) SELECT mesh_id, fid, CAST(corner AS INTEGER) AS corner, vid, part FROM c JOIN m ON node = fid * 3 + corner""")
def g18b_split_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.split_vertices(faces(spark, sf))


@query("SELECT conv_id, turn, role, text FROM conversations")
def s11_manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as tagged JSON lines, blank ones among them, and read as a manifest."""
    path = f"{checkpoint_root(spark)}/manifest-{uuid.uuid4().hex}"
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    readers.write_lines(c.withColumn("schema", F.lit("turns-1")), path, blank_every=5)
    return readers.read_manifest(spark, path, c.schema, "turns-1")


@query("""WITH docs AS (SELECT DISTINCT source AS artifact, sha256(source) AS sha FROM documents WHERE source IS NOT NULL),
l AS (
  SELECT e.vec_id, len(embedding) AS n, len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) AS bad, CASE WHEN vec_id % 11 = 3 THEN 16 ELSE 8 END AS ir, CASE WHEN vec_id % 13 = 5 THEN 4 ELSE 2 END AS lr,
    CASE WHEN vec_id % 17 = 1 THEN 4 ELSE 8 END AS ch, vec_id * 37 % 600 AS occ, d.source AS artifact, CASE WHEN vec_id % 7 = 2 THEN 'beef' ELSE upper(sha256(d.source)) END AS enc
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
)
SELECT vec_id, CASE WHEN n IS NULL OR n <> 64 THEN 'values' WHEN ir <> 8 THEN 'input_resolution' WHEN lr <> 2 THEN 'latent_resolution' WHEN ch <> 8 THEN 'latent_channels' WHEN occ NOT BETWEEN 0 AND 512 THEN 'occupied_count'
  WHEN bad > 0 THEN 'not finite' WHEN sha IS NULL THEN 'artifact' WHEN enc IS NULL OR lower(enc) <> sha THEN 'encoder' END AS fault
FROM l LEFT JOIN docs USING (artifact)""")
def s22_latent_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as latents of 8 channels and 2 cells a side; their documents' sources are the artifacts."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    digests = d.select(F.col("source").alias("artifact")).where("artifact is not null").distinct().withColumn("sha256", F.sha2("artifact", 256))
    odd = lambda by, at, value, usual: F.when(F.col("vec_id") % by == at, value).otherwise(usual)
    e = table(spark, sf, "embeddings").join(d, F.col("vec_id") == F.col("doc_id"), "left")
    rows = e.select("vec_id", "embedding", odd(11, 3, 16, 8).alias("input_resolution"), odd(13, 5, 4, 2).alias("latent_resolution"), odd(17, 1, 4, 8).alias("latent_channels"), (F.col("vec_id") * 37 % 600).alias("occupied_count"), F.col("source").alias("artifact"), odd(7, 2, "beef", F.upper(F.sha2("source", 256))).alias("encoder_sha256"))
    return lineage.contract_faults(rows, "embedding", 8, 2, 8, digests).select("vec_id", "fault")


@query(f"SELECT p_partkey AS part, p_brand AS brand, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) END AS size, NULL::VARCHAR AS absent FROM part")
def s18_metric_file(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics written as CSV in a fixed column order, one column never there, and read back (S10)."""
    path = f"{checkpoint_root(spark)}/metrics-{uuid.uuid4().hex}.csv"
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"))
    readers.write_metrics(p, path, ["part", "brand", "size", "absent"])
    return readers.read(spark, path).withColumn("part", F.col("part").cast("long"))


@query(f"""WITH {POINTS}, {BOXES}, r AS (SELECT scene_id, CAST(label % 6 AS BIGINT) AS room, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts WHERE x < 4 * (1 + label % 6) AND x >= 4 * (label % 6) - 0.2 GROUP BY ALL),
d AS (SELECT scene_id, box_id AS wall, room, greatest(x0 - cx, cx - x1) AS dx, greatest(y0 - cy, cy - y1) AS dy FROM boxes JOIN r USING (scene_id)),
e AS (SELECT scene_id, wall, room, round(CASE WHEN dx <= 0 AND dy <= 0 THEN least(-dx, -dy) ELSE sqrt(greatest(dx, 0) ** 2 + greatest(dy, 0) ** 2) END, 9) AS d FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY scene_id, wall ORDER BY d, room) AS n FROM e) SELECT scene_id, wall, room FROM n WHERE n = 1 OR (n = 2 AND d <= 0.05)""")
def j24_walls_to_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms are six strips of each scene, as far as points lie in them; walls stand at the boxes."""
    room = F.col("label") % 6
    p = points(spark, sf).where((F.col("x") < 4 * (1 + room)) & (F.col("x") >= 4 * room - 0.2))
    rooms = p.groupBy("scene_id", room.cast("long").alias("room")).agg(*(f(a).alias(f"{a}{n}") for n, f in ((0, F.min), (1, F.max)) for a in "xy"))
    walls = boxes(spark, sf).select("scene_id", F.col("box_id").alias("wall"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return regions.walls_to_rooms(walls, rooms, "scene_id")


@query(f"""WITH {VOXELS}, occ AS (SELECT DISTINCT scene_id, vx, vy, vz FROM vox WHERE label % 2 = 0), o AS (SELECT DISTINCT (scene_id + 1) % 8 AS scene_id, CAST(label AS BIGINT) AS object, vx, vy, vz FROM vox WHERE label % 8 = 5),
m AS (SELECT o.scene_id, object, k AS candidate, vx + (k * 5) % 13 - 6 AS vx, vy + (k * 7) % 11 - 5 AS vy, vz + (k * 3) % 7 - 3 AS vz FROM o, range(12) c(k)),
t AS (SELECT m.scene_id, object, candidate, count(*) AS n, count(occ.vx) AS hits, bool_and(least(m.vx, m.vy, m.vz) >= 0 AND greatest(m.vx, m.vy, m.vz) < 40) AS inside FROM m LEFT JOIN occ ON occ.scene_id = m.scene_id AND occ.vx = m.vx AND occ.vy = m.vy AND occ.vz = m.vz GROUP BY m.scene_id, object, candidate),
b AS (SELECT scene_id, object, arg_min(candidate, (hits, candidate)) AS candidate FROM t WHERE inside AND hits <= 0.8 * n GROUP BY ALL) SELECT scene_id, object, CAST(candidate AS BIGINT) AS candidate, vx, vy, vz FROM m SEMI JOIN b USING (scene_id, object, candidate)""")
def x02_pasted_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of one scene are pasted into the next, at one of twelve shifts."""
    v = voxel_points(spark, sf)
    at = ["vx", "vy", "vz"]
    objects = v.where("label % 8 = 5").select(((F.col("scene_id") + 1) % 8).alias("scene_id"), F.col("label").cast("long").alias("object"), *at).distinct()
    k = F.col("candidate")
    shifts = v.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")).alias("candidate"))
    shifts = shifts.withColumns({"dx": (k * 5) % 13 - 6, "dy": (k * 7) % 11 - 5, "dz": (k * 3) % 7 - 3})
    return voxels.pasted(v.where("label % 2 = 0").select("scene_id", *at), objects, shifts, ["scene_id"], 40, 0.8)


@query(f"WITH {POINTS} SELECT scene_id, 1.25::DOUBLE AS scale, round(cos(0.3), 5) AS r00, round(sin(0.3), 5) AS r10, 1.0::DOUBLE AS r22, 1.0::DOUBLE AS tx, 2.0::DOUBLE AS ty, 3.0::DOUBLE AS tz, 0.0::DOUBLE AS residual FROM pts GROUP BY scene_id")
def a23b_similarity_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The points onto themselves, turned by 0.3 about z, enlarged and moved: the fit must give that back."""
    x, y, z, c, s = F.col("x"), F.col("y"), F.col("z"), F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    p = points(spark, sf).withColumns({"u": 1.25 * (c * x - s * y) + 1, "v": 1.25 * (s * x + c * y) + 2, "w": 1.25 * z + 3})
    fit = rounded(rollups.similarity_fits(p.select("scene_id", *"xyzuvw"), ["scene_id"]), "scale", "r00", "r10", "r22", "tx", "ty", "tz", "residual", digits=5)
    return fit.select("scene_id", "scale", "r00", "r10", "r22", "tx", "ty", "tz", "residual")


@query(f"""WITH {BOXES}, p AS (SELECT a.scene_id, (abs(a.cx - b.cx) + abs(a.cy - b.cy) + abs(a.cz - b.cz)) / 3 AS t, abs(a.sx - b.sx) AS s, a.cx - b.cx AS d FROM boxes a JOIN boxes b ON b.box_id = a.box_id + 8)
SELECT scene_id, round(avg(t), 6) AS translation, round(avg(s), 6) AS scale, round(avg(degrees(least(acos(cos(d)), acos(cos(d + pi() / 2)), acos(cos(d + pi())), acos(cos(d - pi() / 2))))), 4) AS rotation, round(avg(degrees(acos(cos(d)))), 4) AS raw_rotation FROM p GROUP BY scene_id""")
def a30b_full_pose_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each box as a prediction of the next of its scene: mean absolute shift and scale, rotation up to quarter turns about its own axis, and as it is."""
    b = boxes(spark, sf)
    o = b.select((F.col("box_id") - 8).alias("box_id"), *(F.col(c).alias(f"o{c}") for c in ("cx", "cy", "cz", "sx")))
    turn = lambda a: S.rotation_from_euler(F.lit(0.0), F.lit(0.0), a)
    angle = [S.geodesic(turn(F.col("cx") + k * math.pi / 2), turn(F.col("ocx"))) for k in range(4)]
    shift = sum((F.abs(F.col(c) - F.col(f"o{c}")) for c in ("cx", "cy", "cz")), F.lit(0.0)) / 3
    mean = {"translation": (shift, 6), "scale": (F.abs(F.col("sx") - F.col("osx")), 6), "rotation": (F.degrees(F.least(*angle)), 4), "raw_rotation": (F.degrees(angle[0]), 4)}
    return b.join(o, "box_id").groupBy("scene_id").agg(*(F.round(F.avg(v), n).alias(c) for c, (v, n) in mean.items()))


@query("""WITH w AS (SELECT user_id % 16 AS frame, power(count(DISTINCT event_type), 0.5::DOUBLE) AS weight FROM events GROUP BY 1), c AS (SELECT frame, sum(weight) OVER (ORDER BY frame) AS upto, sum(weight) OVER () AS total FROM w),
h AS (SELECT conv_id, sha256('5:' || conv_id) AS h FROM (SELECT DISTINCT conv_id FROM conversations)), u AS (SELECT conv_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM h)
SELECT conv_id, min(frame) AS frame FROM u JOIN c ON upto > u * total GROUP BY conv_id""")
def w19b_weighted_frame(spark: SparkSession, sf: str) -> DataFrame:
    """One frame for each conversation, drawn by its weight; the frames are a list of sixteen."""
    weights = table(spark, sf, "events").groupBy((F.col("user_id") % 16).alias("frame")).agg(F.pow(F.countDistinct("event_type"), F.lit(0.5)).alias("weight"))
    draws = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("u", S.sha_seed(F.concat_ws(":", F.lit("5"), F.col("conv_id").cast("string"))) / F.lit(2.0**32))
    return ranking.weighted_choice(draws, weights, "frame", "weight", "u").select("conv_id", "frame")


@query(f"""WITH {POINTS}, c AS (SELECT scene_id, label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts GROUP BY ALL), l AS (SELECT scene_id, avg(p) AS pull FROM (SELECT scene_id, label, avg(greatest(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) - 0.5, 0)) AS p FROM pts JOIN c USING (scene_id, label) GROUP BY ALL) GROUP BY scene_id),
h AS (SELECT a.scene_id, avg(greatest(3.0 - sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 + (a.mz - b.mz) ** 2), 0)) AS push FROM c a JOIN c b ON a.scene_id = b.scene_id AND a.label < b.label GROUP BY a.scene_id) SELECT scene_id, round(pull, 5) AS pull, round(push, 5) AS push FROM l JOIN h USING (scene_id)""")
def a28b_pull_and_push(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.pull_and_push(points(spark, sf), "scene_id", "label", 0.5, 1.5), "pull", "push", digits=5)


@query(f"""WITH {POINTS},
mask AS (SELECT scene_id, point_id, k AS mask, 1 / (1 + (x / 6 - k) ** 2) AS p FROM pts, range(4) t(k)),
area AS (SELECT scene_id, mask, sum(p) AS a FROM mask GROUP BY ALL),
truth AS (SELECT scene_id, point_id, CASE WHEN label < 4 THEN -1 ELSE label % 8 END AS label FROM pts),
size AS (SELECT scene_id, label, count(*) AS n FROM truth WHERE label <> -1 GROUP BY ALL),
both_ AS (SELECT m.scene_id, mask, label, sum(p) AS shared FROM mask m JOIN truth t ON t.scene_id = m.scene_id AND t.point_id = m.point_id AND label <> -1 GROUP BY ALL)
SELECT scene_id, mask, label, round(shared, 5) AS shared, round(1 - (2 * shared + 1) / (a + n + 1), 6) AS cost FROM both_ JOIN area USING (scene_id, mask) JOIN size USING (scene_id, label)""")
def a28c_dice_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Four soft masks over each scene's points, by x, against the labels."""
    p = points(spark, sf)
    masks = p.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    masks = masks.select("scene_id", "point_id", "mask", (1 / (1 + F.pow(F.col("x") / 6 - F.col("mask"), F.lit(2)))).alias("p"))
    truth = p.select("scene_id", "point_id", F.when(F.col("label") < 4, -1).otherwise(F.col("label") % 8).alias("label"))
    return rounded(rounded(rollups.dice_costs(masks, truth, ["scene_id"], "point_id", "mask", "label", "p"), "shared", digits=5), "cost")


@query(f"""WITH {POINTS}, o AS (SELECT scene_id, label, avg(x) AS loss, count(*) % 3 <> 0 AS valid FROM pts GROUP BY ALL), s AS (SELECT scene_id, avg(loss) AS m FROM o WHERE valid GROUP BY scene_id)
SELECT round(coalesce(avg(m), 0), 6) AS mean, count(*) AS scenes FROM s""")
def a28d_scene_balanced_mean(spark: SparkSession, sf: str) -> DataFrame:
    objects = points(spark, sf).groupBy("scene_id", "label").agg(F.avg("x").alias("loss"), (F.count("*") % 3 != 0).alias("valid"))
    return rounded(rollups.scene_balanced_mean(objects, "scene_id", "loss", "valid"), "mean")


@query(f"WITH {BOXES} SELECT box_id, round(cos(cx), 5) AS r00, round(sin(cx), 5) AS r10, greatest(sx, sy) AS scale FROM boxes")
def s07b_wrapped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes wrapped as obb_world, as world or not at all, with rotations in either order of a quaternion or as a matrix, one scale or three."""
    b, half = boxes(spark, sf), F.col("cx") / 2
    n = F.lit(0.0)
    wxyz = F.struct(F.array(F.cos(half), n, n, F.sin(half)).alias("rotation_quat_wxyz"), F.array("sx", "sy").alias("scale"))
    xyzw = F.struct(F.array(n, n, F.sin(half), F.cos(half)).alias("rotation_xyzw"), F.greatest("sx", "sy").alias("largest_scale"))
    matrix = F.struct(F.array(F.cos("cx"), -F.sin("cx"), n, F.sin("cx"), F.cos("cx"), n, n, n, F.lit(1.0)).alias("rotation"), F.array("sx", "sy").alias("scale"))
    kind = F.col("box_id") % 3
    text = F.when(kind == 0, F.to_json(F.struct(wxyz.alias("obb_world")))).when(kind == 1, F.to_json(F.struct(xyzw.alias("world")))).otherwise(F.to_json(matrix))
    out = readers.unwrapped_boxes(b.select("box_id", text.alias("text")), "text")
    return out.select("box_id", F.round(F.col("rotation")[0], 5).alias("r00"), F.round(F.col("rotation")[3], 5).alias("r10"), "scale")
