"""Registered queries: each operator applied to whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.functions import semantics as S
from scenarium.operators import lineage, mesh, ranking, rollups, voxels
from scenarium.operators.quantiles import quantiles
from scenarium.plans.derived import BOXES, FACES, OBSERVATIONS, POINTS, RECORDS, VERTICES, VOXELS, boxes, faces, observations, points, records, table, vertices, voxel_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS, SITE = ["scene_id", "key"], ["scene_id"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- voxels -----------------------------------------------------------------------------------------


@query(f"WITH {VOXELS} SELECT point_id, scene_id, key FROM vox")
def p14_voxel_key(spark: SparkSession, sf: str) -> DataFrame:
    return voxel_points(spark, sf).select("point_id", "scene_id", "key")


@query(f"WITH {VOXELS} SELECT scene_id, key, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM vox GROUP BY ALL")
def a01_voxel_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voxels.pool_mean(voxel_points(spark, sf), KEYS, ["x", "y", "z"]), "x", "y", "z")


@query(f"WITH {VOXELS} SELECT scene_id, key, arg_min(label, point_id) AS label FROM vox GROUP BY ALL")
def a02_voxel_first(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.pool_first(voxel_points(spark, sf), KEYS, "label", "point_id")


@query(f"WITH {VOXELS} SELECT scene_id, key, arg_max(label, point_id) AS label FROM vox GROUP BY ALL")
def a03_instance_voxel(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.pool_last(voxel_points(spark, sf), KEYS, "label", "point_id")


VOTE = """c AS (SELECT scene_id, key, label, count(*) AS c FROM {0} GROUP BY ALL), b AS (SELECT *, max(c) OVER (PARTITION BY scene_id, key) AS m FROM c),
votes AS (SELECT scene_id, key, CASE WHEN count(*) FILTER (c = m) > 1 THEN -1 ELSE max(label) FILTER (c = m) END AS label,
 CAST(sum(c) AS BIGINT) AS n, count(*) AS n_labels, CAST(sum(c) - max(m) AS BIGINT) AS minority, count(*) FILTER (c = m) > 1 AS tie FROM b GROUP BY scene_id, key)"""


@query(f"WITH {VOXELS}, {VOTE.format('vox')} SELECT * FROM votes")
def a04_majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.vote(voxel_points(spark, sf), KEYS)


@query(f"WITH {VOXELS}, src AS (SELECT * FROM vox WHERE point_id % 2 = 1), {VOTE.format('src')} SELECT d.point_id, coalesce(v.label, -1) AS label FROM vox d LEFT JOIN votes v USING (scene_id, key) WHERE d.point_id % 2 = 0")
def j01_label_transfer(spark: SparkSession, sf: str) -> DataFrame:
    p = voxel_points(spark, sf)
    return voxels.transfer_labels(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), KEYS).select("point_id", "label")


FINE = "v AS (SELECT scene_id, vx, vy, vz, CAST(count(*) AS BIGINT) AS w FROM vox GROUP BY ALL)"


def _fine(spark: SparkSession, sf: str) -> DataFrame:
    return voxel_points(spark, sf).groupBy(*SITE, *voxels.XYZ).agg(F.count("*").alias("w"))


COARSE = "SELECT scene_id, vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, avg(w) AS mean, max(w) AS max, bit_or(CAST(1 << CAST((vx % 2) * 4 + (vy % 2) * 2 + vz % 2 AS INTEGER) AS BIGINT)) AS children FROM v GROUP BY scene_id, vx // 2, vy // 2, vz // 2"


@query(f"WITH {VOXELS}, {FINE} SELECT scene_id, vx, vy, vz, round(mean, 6) AS mean, max, children FROM ({COARSE})")
def a05_sparse_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(voxels.downsample(_fine(spark, sf), SITE, "w"), "mean")


@query(f"WITH {VOXELS}, {FINE}, c AS ({COARSE}), s AS (SELECT *, unnest(range(8)) AS slot FROM c) SELECT scene_id, CAST(vx * 2 + slot // 4 AS BIGINT) AS vx, CAST(vy * 2 + (slot // 2) % 2 AS BIGINT) AS vy, CAST(vz * 2 + slot % 2 AS BIGINT) AS vz FROM s WHERE (children >> CAST(slot AS INTEGER)) % 2 = 1")
def a05b_sparse_upsample(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.upsample(voxels.downsample(_fine(spark, sf), SITE, "w"), SITE)


@query(f"WITH {VOXELS}, {FINE} SELECT scene_id, vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, {', '.join(f'max(w) FILTER ((vx % 2) * 4 + (vy % 2) * 2 + vz % 2 = {i}) AS c{i}' for i in range(8))} FROM v GROUP BY scene_id, vx // 2, vy // 2, vz // 2")
def a06_space_to_channel(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.space_to_channel(_fine(spark, sf), SITE, "w")


@query(f"WITH {POINTS} SELECT scene_id, round(avg(x), 6) AS mean, round(sum(x), 3) AS total, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 6) AS std FROM pts GROUP BY ALL")
def a07_segment_reduce(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return points(spark, sf).groupBy("scene_id").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.sum(x), 3).alias("total"), F.round(F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))), 6).alias("std"))


SPREAD = " + ".join(f"(((vx >> {i}) & 1) << {3 * i + 2}) + (((vy >> {i}) & 1) << {3 * i + 1}) + (((vz >> {i}) & 1) << {3 * i})" for i in range(10))


@query(f"WITH {VOXELS} SELECT DISTINCT vx, vy, vz, CAST({SPREAD} AS BIGINT) AS code FROM vox")
def p13_morton(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf).select(*voxels.XYZ).distinct()
    return v.withColumn("code", S.morton(*map(F.col, voxels.XYZ)))


@query(f"WITH {VOXELS}, {FINE} SELECT scene_id, vx, vy, vz, 0 AS degrees, vx AS rx, vy AS ry FROM v UNION ALL SELECT scene_id, vx, vy, vz, 90, 31 - vy, vx FROM v UNION ALL SELECT scene_id, vx, vy, vz, 180, 31 - vx, 31 - vy FROM v UNION ALL SELECT scene_id, vx, vy, vz, 270, vy, 31 - vx FROM v")
def p15_quarter_yaw(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.quarter_yaw(_fine(spark, sf).drop("w"), 32)


FLAGS = "f AS (SELECT scene_id, vx, vy, vz, CAST(w % 2 + 2 * (w // 2 % 2) + 4 * (w // 4 % 2) AS INTEGER) AS flags FROM v)"


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    bit = lambda n: F.floor(F.col("w") / n) % 2
    return _fine(spark, sf).select(*SITE, *voxels.XYZ, voxels.pack_flags(bit(1), bit(2), bit(4)).alias("flags"))


@query(f"WITH {VOXELS}, {FINE}, {FLAGS} SELECT *, flags % 2 = 1 AS b0, flags // 2 % 2 = 1 AS b1, flags // 4 % 2 = 1 AS b2 FROM f")
def p16_flag_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).withColumns({f"b{i}": voxels.unpack_flag(F.col("flags"), i) for i in range(3)})


@query(f"WITH {VOXELS}, {FINE}, {FLAGS} SELECT a.scene_id, a.vx, a.vy, a.vz, b.flags // 2 % 2 = 1 AS moved FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.vx + 1 = b.vx AND a.vy = b.vy AND a.vz = b.vz")
def j18_shifted_flags(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.shifted_flags(_flags(spark, sf), SITE, "flags", (1, 0, 0), 1)


@query(f"""WITH {VOXELS}, p AS (SELECT DISTINCT scene_id, key FROM vox WHERE point_id % 3 <> 0), t AS (SELECT DISTINCT scene_id, key FROM vox WHERE point_id % 3 <> 1),
j AS (SELECT coalesce(p.scene_id, t.scene_id) AS scene_id, p.key AS a, t.key AS b FROM p FULL JOIN t ON p.scene_id = t.scene_id AND p.key = t.key),
c AS (SELECT scene_id, count(a) AS n_pred, count(b) AS n_true, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both FROM j GROUP BY ALL)
SELECT *, round(n_both / n_pred, 6) AS precision, round(n_both / n_true, 6) AS recall, round(2 * n_both / (n_pred + n_true), 6) AS f1 FROM c""")
def j20_support_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = voxel_points(spark, sf)
    return rounded(voxels.support_scores(p.where("point_id % 3 <> 0"), p.where("point_id % 3 <> 1"), SITE), "precision", "recall", "f1")


@query(f"""WITH {VOXELS}, o AS (SELECT DISTINCT scene_id, vx // 4 AS vx, vy // 4 AS vy, vz // 4 AS vz FROM vox), s AS (SELECT DISTINCT scene_id FROM o),
g AS (SELECT scene_id, c // 64 AS vx, c // 8 % 8 AS vy, c % 8 AS vz FROM s, range(512) t(c)) SELECT g.*, CASE WHEN o.vx IS NULL THEN -1 ELSE 1 END AS value FROM g LEFT JOIN o USING (scene_id, vx, vy, vz)""")
def p28_dense_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf).select("scene_id", *(F.floor(F.col(c) / 4).alias(c) for c in voxels.XYZ))
    return voxels.occupancy(v, v.select("scene_id").distinct(), SITE, 8)


BALL = "ball AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx, dy, dz))"


@query(f"""WITH {VOXELS}, v AS (SELECT DISTINCT scene_id, vx, vy, vz FROM vox), {BALL},
g AS (SELECT DISTINCT scene_id, vx + dx AS vx, vy + dy AS vy, vz + dz AS vz FROM v, ball WHERE vx + dx BETWEEN 0 AND 31 AND vy + dy BETWEEN 0 AND 31 AND vz + dz BETWEEN 0 AND 31)
SELECT g.scene_id, g.vx, g.vy, g.vz FROM g, ball b LEFT JOIN g n ON n.scene_id = g.scene_id AND n.vx = g.vx + dx AND n.vy = g.vy + dy AND n.vz = g.vz + dz
GROUP BY ALL HAVING bool_and(n.vx IS NOT NULL OR NOT (g.vx + dx BETWEEN 0 AND 31 AND g.vy + dy BETWEEN 0 AND 31 AND g.vz + dz BETWEEN 0 AND 31))""")
def g22_binary_closing(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.close_voxels(voxel_points(spark, sf), SITE, 32)


@query(f"""WITH {VOXELS}, m AS (SELECT DISTINCT scene_id, CAST({SPREAD} AS BIGINT) AS code FROM vox), l AS (SELECT *, unnest(range(5)) AS level FROM m)
SELECT scene_id, CAST(level AS INTEGER) AS level, code >> CAST(3 * (5 - level) AS INTEGER) AS node, CAST(bit_or(1 << CAST((code >> CAST(3 * (4 - level) AS INTEGER)) % 8 AS INTEGER)) AS INTEGER) AS mask FROM l GROUP BY ALL""")
def g25_octree_masks(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.octree_masks(voxel_points(spark, sf), SITE, 5)


@query(f"""WITH {VOXELS}, {FINE}, o AS (SELECT * FROM (VALUES (0,1,1,1),(1,0,1,1),(2,1,0,1),(3,1,1,0),(4,0,0,1),(5,0,1,0),(6,1,0,0)) t(i, dx, dy, dz)),
j AS (SELECT v.scene_id, v.vx, v.vy, v.vz, v.w, n.w AS nw, o.i FROM v, o JOIN v n ON n.scene_id = v.scene_id AND n.vx = v.vx - dx AND n.vy = v.vy - dy AND n.vz = v.vz - dz),
b AS (SELECT scene_id, vx, vy, vz, arg_min(nw, i) AS nw FROM j GROUP BY ALL)
SELECT v.scene_id, v.vx, v.vy, v.vz, CAST((((v.w - coalesce(b.nw, 0)) % 256) + 256) % 256 AS INTEGER) AS delta FROM v LEFT JOIN b USING (scene_id, vx, vy, vz)""")
def g26_neighbour_delta(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.neighbour_deltas(_fine(spark, sf), SITE, "w")


# --- scalar geometry --------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT point_id, round(x - min(x) OVER w, 6) AS x, round(y - min(y) OVER w, 6) AS y, round(z - min(z) OVER w, 6) AS z FROM pts WINDOW w AS (PARTITION BY scene_id)")
def p06_min_corner(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    low = p.groupBy("scene_id").agg(*(F.min(c).alias(f"m{c}") for c in "xyz"))
    return p.join(low, "scene_id").select("point_id", *(F.round(F.col(c) - F.col(f"m{c}"), 6).alias(c) for c in "xyz"))


@query(f"WITH {POINTS} SELECT point_id, round(2 * (0.6::DOUBLE * x - 0.8::DOUBLE * y) + 1, 6) AS x, round(2 * (0.8::DOUBLE * x + 0.6::DOUBLE * y) - 2, 6) AS y, round(2 * z + 3, 6) AS z FROM pts")
def p07_affine(spark: SparkSession, sf: str) -> DataFrame:
    m = [[F.lit(0.6), F.lit(-0.8), F.lit(0.0)], [F.lit(0.8), F.lit(0.6), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    turned = S.matvec(m, [F.col(c) for c in "xyz"])
    return points(spark, sf).select("point_id", *(F.round(2 * v + t, 6).alias(c) for v, t, c in zip(turned, (1, -2, 3), "xyz", strict=True)))


EULER = "e AS (SELECT box_id, cx / 10 AS a, cy / 10 AS b, cz / 10 AS c FROM boxes)"


@query(f"""WITH {BOXES}, {EULER} SELECT box_id, round(cos(b) * cos(c), 6) AS m00, round(sin(a) * sin(b) * cos(c) - cos(a) * sin(c), 6) AS m01, round(cos(a) * sin(b) * cos(c) + sin(a) * sin(c), 6) AS m02,
round(cos(b) * sin(c), 6) AS m10, round(sin(a) * sin(b) * sin(c) + cos(a) * cos(c), 6) AS m11, round(cos(a) * sin(b) * sin(c) - sin(a) * cos(c), 6) AS m12, round(-sin(b), 6) AS m20, round(sin(a) * cos(b), 6) AS m21, round(cos(a) * cos(b), 6) AS m22 FROM e""")
def p08_euler_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = S.rotation_from_euler(*(F.col(c) / 10 for c in ("cx", "cy", "cz")))
    return boxes(spark, sf).select("box_id", *(F.round(m[i][j], 6).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


@query(f"""WITH {BOXES}, n AS (SELECT box_id, cx / l AS w, cy / l AS x, cz / l AS y, sx / l AS z FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz + sx * sx) AS l FROM boxes))
SELECT box_id, round(1 - 2 * (y * y + z * z), 6) AS m00, round(2 * (x * y - z * w), 6) AS m01, round(2 * (x * z + y * w), 6) AS m02, round(1 - 2 * (x * x + y * y), 6) AS m22 FROM n""")
def p09_quaternion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = S.rotation_from_quaternion(*(F.col(c) for c in ("cx", "cy", "cz", "sx")))
    return boxes(spark, sf).select("box_id", *(F.round(m[i][j], 6).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 2))))


@query(f"WITH {POINTS}, q AS (SELECT point_id, least(greatest(CAST(trunc((x - 1) / 20 * 1023) AS BIGINT), 0), 1023) AS bin FROM pts) SELECT point_id, bin, round(bin / 1023.0::DOUBLE * 20 + 1, 6) AS back FROM q")
def p11_quantize(spark: SparkSession, sf: str) -> DataFrame:
    q = points(spark, sf).select("point_id", S.quantize(F.col("x"), 1.0, 21.0).alias("bin"))
    return q.withColumn("back", F.round(S.dequantize(F.col("bin"), 1.0, 21.0), 6))


@query("SELECT bin, round(bin / 1023.0::DOUBLE * 24, 6) AS centre, count(*) AS n FROM (SELECT CAST(trunc(l_quantity * 0.48::DOUBLE / 24 * 1023) AS BIGINT) AS bin FROM lineitem) GROUP BY bin")
def p12_bin_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The centres of the bins that the points' x fall into."""
    q = points(spark, sf).select(S.quantize(F.col("x"), 0.0, 24.0).cast("long").alias("bin"))
    return q.groupBy("bin").agg(F.count("*").alias("n")).select("bin", F.round(S.dequantize(F.col("bin"), 0.0, 24.0), 6).alias("centre"), "n")


@query("""WITH h AS (SELECT doc_id, sha256('7:' || source || ':' || doc_id) AS h FROM documents)
SELECT doc_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) AS seed FROM h""")
def p18_stable_seed(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(":", F.lit("7"), "source", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", S.sha_seed(text).alias("seed"))


@query("SELECT doc_id, source || '/object_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS key FROM documents")
def p19_object_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.format_string("%s/object_%04d", "source", "doc_id").alias("key"))


@query("SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, regexp_extract(url, '//([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number FROM pages")
def p20_path_parsing(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part("([^/]+)$").alias("name"), part("//([^/]+)").alias("host"), part("([0-9]+)[^0-9]*$").try_cast("long").alias("number"))


@query(f"WITH {BOXES} SELECT box_id, CAST(k AS INTEGER) AS corner, round(cx + sx / 2 * (k // 4 * 2 - 1), 6) AS x, round(cy + sy / 2 * (k // 2 % 2 * 2 - 1), 6) AS y, round(cz + sz / 2 * (k % 2 * 2 - 1), 6) AS z FROM boxes, range(8) t(k)")
def p24_box_corners(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    sign = lambda n: F.floor(F.col("corner") / n) % 2 * 2 - 1
    return b.select("box_id", "corner", *(F.round(F.col(f"c{a}") + F.col(f"s{a}") / 2 * sign(n), 6).alias(a) for a, n in (("x", 4), ("y", 2), ("z", 1))))


@query(f"""WITH {BOXES}, {EULER} SELECT box_id, round(acos(least(greatest((cos(b) * cos(c) + sin(a) * sin(b) * sin(c) + cos(a) * cos(c) + cos(a) * cos(b) - 1) / 2, -1), 1)), 5) AS angle FROM e""")
def p26_geodesic(spark: SparkSession, sf: str) -> DataFrame:
    m = S.rotation_from_euler(*(F.col(c) / 10 for c in ("cx", "cy", "cz")))
    eye = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    return boxes(spark, sf).select("box_id", F.round(S.geodesic(m, eye), 5).alias("angle"))


@query(f"""WITH {POINTS}, c AS (SELECT point_id, x - 12 AS x, y - 12 AS y, z + 2 AS z FROM pts) SELECT point_id, round(100 * x / z + 50, 6) AS u, round(100 * y / z + 50, 6) AS v,
100 * x / z + 50 >= 0 AND 100 * x / z + 50 < 100 AND 100 * y / z + 50 >= 0 AND 100 * y / z + 50 < 100 AS visible FROM c WHERE z > 0""")
def p27_projection(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("point_id", (F.col("x") - 12).alias("x"), (F.col("y") - 12).alias("y"), (F.col("z") + 2).alias("z")).where("z > 0")
    u, v = (100 * F.col(c) / F.col("z") + 50 for c in "xy")
    return p.select("point_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), ((u >= 0) & (u < 100) & (v >= 0) & (v < 100)).alias("visible"))


# --- windows, top-k, sampling -----------------------------------------------------------------------


@query(f"WITH {OBSERVATIONS} SELECT view, cell, depth, row_id FROM obs WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY view, cell ORDER BY depth, row_id) = 1")
def w01_z_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.z_buffer(observations(spark, sf), "view", "cell", "depth", "row_id").select("view", "cell", "depth", "row_id")


@query(f"WITH {POINTS} SELECT x, y, z, min(scene_id) AS scene_id, arg_min(point_id, (scene_id, point_id)) AS point_id, min(point_id) AS seen FROM pts GROUP BY x, y, z")
def w03_dedupe_points(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.dedupe_nearest(points(spark, sf), ["x", "y", "z"], "scene_id", "point_id")


@query(f"WITH {OBSERVATIONS}, s AS (SELECT object, view, count(DISTINCT cell) AS support FROM obs GROUP BY ALL) SELECT object, view, support FROM s QUALIFY row_number() OVER (PARTITION BY object ORDER BY support DESC, view) <= 4")
def w04_top_views(spark: SparkSession, sf: str) -> DataFrame:
    s = observations(spark, sf).groupBy("object", "view").agg(F.countDistinct("cell").alias("support"))
    return ranking.top_per_group(s, ["object"], [F.desc("support"), "view"], 4)


@query(f"WITH {OBSERVATIONS}, s AS (SELECT object, cell, count(*) AS pixels FROM obs GROUP BY ALL) SELECT object, cell, pixels FROM s QUALIFY row_number() OVER (PARTITION BY object ORDER BY pixels DESC, cell) <= 5")
def w05_most_visible(spark: SparkSession, sf: str) -> DataFrame:
    s = observations(spark, sf).groupBy("object", "cell").agg(F.count("*").alias("pixels"))
    return ranking.top_per_group(s, ["object"], [F.desc("pixels"), "cell"], 5)


@query("""WITH d AS (SELECT DISTINCT source, doc_id FROM documents), g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM d)),
q AS (SELECT source, 50 // n + CASE WHEN g < 50 % n THEN 1 ELSE 0 END AS quota FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM d)
SELECT r.source, doc_id, CAST(rank AS INTEGER) AS rank FROM r JOIN q USING (source) WHERE rank <= quota""")
def w06_balanced_selection(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.balanced_selection(table(spark, sf, "documents"), "source", "doc_id", 50)


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS n, count(*) OVER (PARTITION BY scene_id) AS m FROM pts),
i AS (SELECT DISTINCT scene_id, CAST(floor(k * (m - 1) / 99) AS BIGINT) AS n FROM r, range(100) t(k) WHERE n = 0)
SELECT scene_id, point_id FROM r SEMI JOIN i USING (scene_id, n)""")
def w07_even_stride(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.even_stride(points(spark, sf), SITE, "point_id", 100).select("scene_id", "point_id")


@query("""WITH s AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)), m AS (SELECT count(*) AS m FROM part)
SELECT i * 3 + k AS position, CASE WHEN k = 0 THEN conv_id END AS conv_id, CASE WHEN k > 0 THEN CAST((floor(i * m / n) + k - 1) AS BIGINT) % m END AS object_index FROM s, m, range(3) t(k)""")
def w10_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.interleaved(table(spark, sf, "conversations").select("conv_id").distinct(), table(spark, sf, "part"), "conv_id", 2)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CAST(i % 4 AS BIGINT) AS turn, (SELECT min(s) FROM range(4) t(s) WHERE i < n * (s + 1) // 4) AS part FROM r""")
def w11_shards(spark: SparkSession, sf: str) -> DataFrame:
    r = ranking.numbered(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "i", "n")
    return r.select("doc_id", ranking.round_robin(F.col("i"), 4).alias("turn"), ranking.contiguous_shard(F.col("i"), F.col("n"), 4).alias("part"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 100")
def w12_retention(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.retained(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100).select("event_type", "event_id")


@query("SELECT s_suppkey, CAST(unnest(range(1, s_nationkey % 4 + 1)) AS INTEGER) AS copy FROM supplier")
def w13_replication(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.replicated(table(spark, sf, "supplier"), F.col("s_nationkey") % 4).select("s_suppkey", "copy")


@query(f"""WITH {RECORDS}, d AS (SELECT scene_id, value, CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END AS hit, object_id, weight FROM records),
t AS (SELECT scene_id, object_id, max(hit) AS hit, max(value) AS s FROM d GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n_truth FROM t),
r AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY scene_id ORDER BY s DESC, object_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, tp / n_truth AS recall, tp / n AS prec FROM r), e AS (SELECT *, max(prec) OVER (PARTITION BY scene_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
coalesce(lag(recall) OVER (PARTITION BY scene_id ORDER BY n), 0) AS before FROM p) SELECT scene_id, round(sum((recall - before) * env), 6) AS ap FROM e GROUP BY scene_id""")
def w17_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).groupBy("scene_id", "object_id").agg(F.max((F.col("status") == "evaluated").cast("int")).alias("hit"), F.max("value").alias("s"))
    n = d.groupBy("scene_id").agg(F.count("*").alias("n_truth"))
    return rounded(ranking.average_precision(d.join(n, "scene_id"), "scene_id", [F.desc("s"), "object_id"], "hit", "n_truth"), "ap")


@query("""WITH p AS (SELECT source, source || '/step_' || doc_id || '.ckpt' AS path, doc_id AS step FROM documents) SELECT source, max(step) AS step, arg_max(path, step) AS path FROM p GROUP BY source""")
def w18_latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select("source", F.concat("source", F.lit("/step_"), "doc_id", F.lit(".ckpt")).alias("path"))
    return ranking.latest(p, ["source"], "path", r"step_(\d+)\.ckpt$")


@query(f"WITH {OBSERVATIONS}, t AS (SELECT object, depth FROM obs QUALIFY row_number() OVER (PARTITION BY object ORDER BY depth DESC, row_id) <= 3) SELECT object, round(avg(depth), 6) AS score FROM t GROUP BY object")
def a35_top_three_score(spark: SparkSession, sf: str) -> DataFrame:
    top = ranking.top_per_group(observations(spark, sf), ["object"], [F.desc("depth"), "row_id"], 3)
    return top.groupBy("object").agg(F.round(F.avg("depth"), 6).alias("score"))


# --- roll-ups ---------------------------------------------------------------------------------------


@query(f"WITH {OBSERVATIONS} SELECT object, count(*) AS pixels, count(DISTINCT view) AS views FROM obs WHERE depth > 0 GROUP BY object")
def a08_visible_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).where("depth > 0").groupBy("object").agg(F.count("*").alias("pixels"), F.countDistinct("view").alias("views"))


@query(f"WITH {RECORDS} SELECT scene_id, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM records GROUP BY scene_id")
def a09_scalar_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.scalar_summary(records(spark, sf), SITE, "value"), "mean", "std", "median")


COVERAGE = f"""{RECORDS}, e AS (SELECT CAST(s AS BIGINT) AS scene_id FROM range(20) t(s)), p AS (SELECT scene_id, count(*) AS n, count(*) FILTER (status = 'evaluated') AS n_done,
avg(value) FILTER (status = 'evaluated') AS mean, avg(CASE WHEN status = 'evaluated' THEN value ELSE 0 END) AS zero_mean FROM records GROUP BY scene_id),
cov AS (SELECT e.scene_id, coalesce(n, 0) AS n, coalesce(n_done, 0) AS n_done, mean, zero_mean, CASE WHEN n > 0 THEN n_done / n ELSE 1.0 END AS coverage FROM e LEFT JOIN p USING (scene_id))"""


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.range(20).select(F.col("id").alias("scene_id"))
    return rollups.coverage_rollup(expected, records(spark, sf), "scene_id", "status", "value")


@query(f"WITH {COVERAGE} SELECT scene_id, n, n_done, round(mean, 6) AS mean, round(zero_mean, 6) AS zero_mean, round(coverage, 6) AS coverage FROM cov")
def a10_benchmark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_coverage(spark, sf), "mean", "zero_mean", "coverage")


@query(f"WITH {COVERAGE}, t AS (SELECT CAST(sum(n) AS BIGINT) AS n_objects, CAST(sum(n_done) AS BIGINT) AS n_done, count(*) AS n_scenes, sum(mean * n_done) AS s, avg(mean) AS macro, avg(zero_mean) AS zero_macro FROM cov) SELECT n_scenes, n_objects, n_done, round(s / n_done, 6) AS micro, round(macro, 6) AS macro, round(zero_macro, 6) AS zero_macro, CASE WHEN n_objects = n_done THEN round(macro, 6) END AS \"primary\" FROM t")
def a10_benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.benchmark_summary(_coverage(spark, sf)), "micro", "macro", "zero_macro", "primary")


@query(f"WITH {RECORDS}, i AS (SELECT scene_id, object_id, avg(value) AS m FROM records GROUP BY ALL) SELECT scene_id, round(avg(m), 6) AS mean, count(m) AS n FROM i GROUP BY scene_id")
def a11_two_level_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.two_level_mean(records(spark, sf), SITE, ["object_id"], "value"), "mean")


@query(f"""WITH {RECORDS}, c AS (SELECT scene_id, count(*) FILTER (status = 'evaluated') AS tp, count(*) FILTER (status = 'failed') AS fp, count(*) FILTER (status = 'missing_prediction') AS fn FROM records GROUP BY scene_id),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS j FROM c)
SELECT scene_id, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(j, 6) AS jaccard, round((p + r + f + j) / 4, 6) AS comprehensive FROM s""")
def a12_detection_rollup(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    c = records(spark, sf).groupBy("scene_id").agg(is_("evaluated").alias("tp"), is_("failed").alias("fp"), is_("missing_prediction").alias("fn"))
    return rounded(rollups.detection_scores(c), "precision", "recall", "f1", "jaccard", "comprehensive")


@query(f"""WITH {POINTS}, p AS (SELECT scene_id, label % 6 - 1 AS a, (label + point_id % 2) % 6 - 1 AS b FROM pts), s AS (SELECT scene_id, a AS class, a = b AS same, 0 AS t FROM p WHERE a <> -1 UNION ALL SELECT scene_id, b, a = b, 1 FROM p WHERE b <> -1),
g AS (SELECT scene_id, CAST(class AS BIGINT) AS class, count(*) FILTER (same AND t = 1) AS intersection, count(*) AS n FROM s GROUP BY scene_id, class)
SELECT scene_id, class, intersection, n - intersection AS "union", round(intersection / (n - intersection), 6) AS iou FROM g""")
def a13_class_iou(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("scene_id", (F.col("label") % 6 - 1).cast("long").alias("a"), ((F.col("label") + F.col("point_id") % 2) % 6 - 1).cast("long").alias("b"))
    return rounded(rollups.class_iou(p, SITE, "a", "b"), "iou")


@query(f"WITH {RECORDS} SELECT scene_id, round(sum(value * weight) / sum(weight), 6) AS mean FROM records GROUP BY scene_id")
def a25_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.weighted_mean(records(spark, sf), SITE, "value", "weight"), "mean")


@query(f"WITH {OBSERVATIONS} SELECT view, round(avg(depth), 6) AS mean, round(quantile_cont(depth, 0.5), 6) AS median, round(quantile_cont(depth, 0.9), 6) AS p90, round(quantile_cont(depth, 0.95), 6) AS p95, round(quantile_cont(depth, 0.99), 6) AS p99, round(max(depth), 6) AS max FROM obs GROUP BY view")
def a25b_directional_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.directional_stats(observations(spark, sf), ["view"], "depth"), "mean", "median", "p90", "p95", "p99", "max")


@query("""WITH a AS (SELECT DISTINCT source FROM documents), b AS (SELECT source, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT a.source, round(coalesce(m, 0), 6) AS mean FROM a LEFT JOIN b USING (source)""")
def a32_empty_scene_zero(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    m = d.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("m"))
    return d.select("source").distinct().join(m, "source", "left").select("source", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"))


@query("SELECT lang, round(regr_slope(CAST(length(text) AS DOUBLE), n_chars), 5) AS slope, round(regr_intercept(CAST(length(text) AS DOUBLE), n_chars), 2) AS intercept FROM documents GROUP BY lang")
def a33_linear_regression(spark: SparkSession, sf: str) -> DataFrame:
    y, x = F.length("text").cast("double"), F.col("n_chars").cast("double")
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"))


@query(f"""WITH {POINTS}, m AS (SELECT label, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, quantile_cont(z, 0.5) AS cz FROM pts GROUP BY label),
h AS (SELECT label, cx, cy, cz, quantile_cont(abs(x - cx), 0.95) AS hx, quantile_cont(abs(y - cy), 0.95) AS hy, quantile_cont(abs(z - cz), 0.95) AS hz FROM pts JOIN m USING (label) GROUP BY ALL)
SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(hx, 6) AS hx, round(hy, 6) AS hy, round(hz, 6) AS hz, round(2 * greatest(hx, hy, hz), 6) AS extent FROM h""")
def a17_robust_extent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollups.robust_extent(points(spark, sf), ["label"]), "cx", "cy", "cz", "hx", "hy", "hz", "extent")


@query(f"WITH {POINTS}, h AS (SELECT scene_id, quantile_cont(z, 0.99) - quantile_cont(z, 0.01) AS height FROM pts GROUP BY scene_id) SELECT scene_id, round(height, 6) AS height, round(least(greatest(2.6 / height, 0.25), 4), 6) AS factor FROM h")
def a31_room_height(spark: SparkSession, sf: str) -> DataFrame:
    h = quantiles(points(spark, sf), ["scene_id"], {"q": "z"}, [0.01, 0.99]).select("scene_id", (F.col("q")[1] - F.col("q")[0]).alias("height"))
    return rounded(h.withColumn("factor", S.clip(2.6 / F.col("height"), 0.25, 4.0)), "height", "factor")


@query(f"WITH {VOXELS} SELECT scene_id, vx, vy, count(*) AS n, round(max(z) - min(z), 6) AS span FROM vox GROUP BY ALL HAVING count(*) >= 3")
def a21_vertical_span(spark: SparkSession, sf: str) -> DataFrame:
    g = voxel_points(spark, sf).groupBy("scene_id", "vx", "vy").agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("z"), 6).alias("span"))
    return g.where("n >= 3")


# --- manifests, sets, audits ------------------------------------------------------------------------


@query("""SELECT doc_id, 'missing' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels ANTI JOIN documents USING (doc_id)""")
def j14_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("""WITH c AS (SELECT source AS k, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY source), i AS (SELECT DISTINCT source AS k FROM documents), e AS (SELECT DISTINCT source AS k FROM documents WHERE doc_id % 97 = 0)
SELECT k, coalesce(n, 0) AS n_candidates, CASE WHEN e.k IS NOT NULL OR n = 1 THEN 'found' WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status FROM i LEFT JOIN c USING (k) LEFT JOIN e USING (k)""")
def j12_prediction_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumnRenamed("source", "k")
    return lineage.lookup_status(d.select("k").distinct(), d.where("doc_id % 97 = 0"), d.where("lang = 'es'"), "k")


@query("""SELECT coalesce(o.c, c.c) AS k, coalesce(o.v, c.v) AS v FROM (SELECT o_custkey AS c, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o FULL JOIN (SELECT c_custkey AS c, c_acctbal AS v FROM customer) c ON o.c = c.c""")
def j19_outer_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return lineage.coalesced(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 3) d ON o_orderkey = l_orderkey")
def f16_pending_work(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("variant"))
    return lineage.pending(table(spark, sf, "orders").select("o_orderkey"), out, "o_orderkey", 3)


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def f13_scene_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT p_partkey, coalesce(n, 0) AS n, coalesce(n, 0) >= 30 AS visible FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def f14_visibility(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    out = table(spark, sf, "part").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("visible", F.col("n") >= 30)


@query(f"WITH {POINTS} SELECT scene_id, label, count(*) AS n FROM pts WHERE isfinite(x) GROUP BY ALL HAVING count(*) >= 20")
def f17_min_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where(S.finite(F.col("x")).isNotNull()).groupBy("scene_id", "label").agg(F.count("*").alias("n")).where("n >= 20")


@query("SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text")
def u05_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source", "text").agg(F.min("doc_id").alias("doc_id"))
    return d.select("source", "text", "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def u07_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.conflicts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("SELECT s_suppkey + 1000 AS k, 1 AS batch FROM supplier UNION ALL SELECT p_partkey, 0 FROM part")
def u01_union_reoffset(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit(0).alias("batch"))
    return table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).alias("k"), F.lit(1).alias("batch")).unionByName(a)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u02_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def u03_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, sf, "lineitem").where("l_quantity = 1").select("l_partkey").distinct())


@query("SELECT source AS k FROM documents UNION SELECT url FROM pages")
def u04_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("k")).union(table(spark, sf, "pages").select("url")).distinct()


@query("SELECT count(*) FILTER (n = 2) = 0 AND bool_or(a) AND bool_or(b) AS disjoint FROM (SELECT k, count(DISTINCT s) AS n, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT doc_id AS k, 0 AS s FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de') GROUP BY k)")
def u08_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    both = d.where("lang = 'en'").select("doc_id", F.lit(True).alias("a"), F.lit(False).alias("b")).union(d.where("lang = 'de'").select("doc_id", F.lit(False), F.lit(True)))
    g = both.groupBy("doc_id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return g.agg(((F.count_if(F.col("a") & F.col("b")) == 0) & F.bool_or("a") & F.bool_or("b")).alias("disjoint"))


@query("""WITH p AS (SELECT user_id, event_type, value, event_id AS part FROM events), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC) = 1), d AS (SELECT c_custkey AS user_id FROM customer)
SELECT user_id, event_type, value, part FROM l UNION ALL SELECT user_id, NULL, NULL, NULL FROM d ANTI JOIN l USING (user_id)""")
def s26_part_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("part"))
    return lineage.merge_parts(parts, "user_id", "part", table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")))


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'absent' WHEN doc_id % 7 = 0 THEN 'wrong' ELSE 'ok' END AS state FROM documents""")
def s16_checksum_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    manifest = d.select("path", F.when(F.col("path") % 7 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return lineage.checksum_audit(manifest, d.where("path % 11 <> 0"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def s20_content_store(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# --- meshes -----------------------------------------------------------------------------------------


@query(f"WITH {FACES} SELECT mesh_id, vid, count(DISTINCT fid) AS n FROM (SELECT mesh_id, fid, unnest([v0, v1, v2]) AS vid FROM faces) GROUP BY ALL")
def g01_vertex_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.vertex_faces(faces(spark, sf)).select("mesh_id", "vid", F.size("fids").cast("long").alias("n"))


@query(f"WITH {FACES} SELECT mesh_id, e0, e1, count(*) AS n_faces FROM sides GROUP BY ALL")
def g02_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.edges(faces(spark, sf))


@query(f"WITH {FACES} SELECT mesh_id, e0, e1, list_aggregate(list_sort(list(fid)), 'string_agg', ',') AS fids FROM sides GROUP BY ALL")
def g03_edge_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.edge_faces(faces(spark, sf)).withColumn("fids", F.concat_ws(",", F.transform("fids", lambda x: x.cast("string"))))


@query(f"""WITH {FACES}, e AS (SELECT mesh_id, e0, e1, count(*) AS n FROM sides GROUP BY ALL), u AS (SELECT mesh_id, unnest([e0, e1]) AS vid, n FROM e)
SELECT mesh_id, vid, count(*) AS n_edges, count(*) FILTER (n = 1) AS n_boundary, count(*) FILTER (n > 2) AS n_overfull, count(*) FILTER (n > 2) = 0 AND count(*) FILTER (n = 1) <= 2 AS manifold FROM u GROUP BY ALL""")
def g06_vertex_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.vertex_edges(faces(spark, sf))


@query(f"WITH {FACES} SELECT mesh_id, e0, e1 FROM sides GROUP BY ALL HAVING count(*) = 1")
def g05_boundary_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.boundary_edges(faces(spark, sf))


@query(f"WITH {FACES} SELECT mesh_id, e0, e1, min(fid) AS f0, max(fid) AS f1, count(*) FILTER (forward) <> 1 AS same_direction FROM sides GROUP BY ALL HAVING count(*) = 2")
def g07_face_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.manifold_neighbours(faces(spark, sf))


@query(f"WITH {FACES} SELECT mesh_id, fid, v0, v1, v2 FROM faces QUALIFY row_number() OVER (PARTITION BY mesh_id, list_sort([v0, v1, v2]) ORDER BY fid) = 1")
def g13_duplicate_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.without_duplicates(faces(spark, sf))


@query(f"WITH {FACES}, r AS (SELECT mesh_id, fid, row_number() OVER (PARTITION BY mesh_id, e0, e1 ORDER BY fid) AS n FROM sides) SELECT mesh_id, fid, v0, v1, v2 FROM faces ANTI JOIN (SELECT mesh_id, fid FROM r WHERE n > 2) USING (mesh_id, fid)")
def g15_overfull_edges(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.without_overfull_edges(faces(spark, sf)).select("mesh_id", "fid", "v0", "v1", "v2")


POSITIONS = f"""{VERTICES}, pos AS (SELECT f.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM faces f
JOIN vertices a ON a.mesh_id = f.mesh_id AND a.vid = v0 JOIN vertices b ON b.mesh_id = f.mesh_id AND b.vid = v1 JOIN vertices c ON c.mesh_id = f.mesh_id AND c.vid = v2),
geo AS (SELECT mesh_id, fid, v0, v1, v2, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM pos)"""


@query(f"WITH {POSITIONS} SELECT mesh_id, fid, round(sqrt(nx*nx + ny*ny + nz*nz) / 2, 6) AS area, nx, ny, nz FROM geo")
def g17_face_geometry(spark: SparkSession, sf: str) -> DataFrame:
    g = mesh.face_geometry(faces(spark, sf), vertices(spark, sf))
    return rounded(g, "area").select("mesh_id", "fid", "area", "nx", "ny", "nz")


@query(f"WITH {POSITIONS}, u AS (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM geo), s AS (SELECT mesh_id, vid, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM u GROUP BY ALL) SELECT mesh_id, vid, round(sqrt(sx*sx + sy*sy + sz*sz), 5) > 0 AS whole, round(abs(sx) / sqrt(sx*sx + sy*sy + sz*sz), 5) AS ax FROM s WHERE sx*sx + sy*sy + sz*sz > 0")
def g17b_vertex_normals(spark: SparkSession, sf: str) -> DataFrame:
    n = mesh.vertex_normals(faces(spark, sf), vertices(spark, sf))
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return n.where(F.round(length, 6) == 1.0).select("mesh_id", "vid", F.lit(True).alias("whole"), F.round(F.abs("nx"), 5).alias("ax"))


@query(f"WITH {POSITIONS} SELECT mesh_id, fid, v0, v1, v2 FROM geo WHERE sqrt(nx*nx + ny*ny + nz*nz) / 2 >= 1e-9")
def g14_degenerate_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.without_degenerate(faces(spark, sf), vertices(spark, sf), 1.0, 1e-9).select("mesh_id", "fid", "v0", "v1", "v2")


@query(f"""WITH {FACES}, k AS (SELECT * FROM faces WHERE fid % 5 = 0), u AS (SELECT DISTINCT mesh_id, unnest([v0, v1, v2]) AS vid FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY vid) - 1 AS nid FROM u)
SELECT k.mesh_id, fid, CAST(a.nid AS BIGINT) AS v0, CAST(b.nid AS BIGINT) AS v1, CAST(c.nid AS BIGINT) AS v2 FROM k JOIN n a ON a.mesh_id = k.mesh_id AND a.vid = v0 JOIN n b ON b.mesh_id = k.mesh_id AND b.vid = v1 JOIN n c ON c.mesh_id = k.mesh_id AND c.vid = v2""")
def g12_compaction(spark: SparkSession, sf: str) -> DataFrame:
    f, _ = mesh.compacted(faces(spark, sf).where("fid % 5 = 0"), vertices(spark, sf))
    return f.select("mesh_id", "fid", *(F.col(c).cast("long").alias(c) for c in mesh.CORNERS))


@query(f"""WITH RECURSIVE {FACES}, p AS (SELECT mesh_id, min(fid) AS a, max(fid) AS b FROM sides GROUP BY mesh_id, e0, e1 HAVING count(*) = 2),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT fid AS node, fid AS root FROM faces UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT f.mesh_id, f.fid, min(r.root) AS component FROM faces f JOIN r ON r.node = f.fid GROUP BY ALL""")
def g09_components(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.face_components(faces(spark, sf))


@query(f"WITH {VERTICES} SELECT mesh_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM vertices GROUP BY mesh_id")
def a34_mesh_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mesh.bounds(vertices(spark, sf), ["mesh_id"]), "mean_x", "mean_y", "mean_z")


@query(f"""WITH {VERTICES}, b AS (SELECT mesh_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, 0.99999 / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM vertices GROUP BY mesh_id)
SELECT mesh_id, vid, round((x - cx) * s, 6) AS x, round((y - cy) * s, 6) AS y, round((z - cz) * s, 6) AS z FROM vertices JOIN b USING (mesh_id)""")
def s21_canonical_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mesh.canonical(vertices(spark, sf), ["mesh_id"]), "x", "y", "z")
