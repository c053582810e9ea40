"""Registered queries over frames, predicates, manifests, augmentation and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.functions import semantics as S
from scenarium.operators import frames, lineage, mesh, ranking, rollups
from scenarium.operators.quantiles import with_quantiles
from scenarium.plans.catalog import query, rounded
from scenarium.plans.derived import BOXES, FACES, OBSERVATIONS, POINTS, SHEETS, VOXELS, boxes, faces, observations, points, sheets, table, voxel_points
from scenarium.streaming.incremental import last_n, windowed_counts
from scenarium.streaming.ring import ring_over_table

# One pixel for each order line: 16 frames of 64 x 48, invalid depths among them.
PIXELS = """px AS (SELECT frame, v, u, CASE WHEN d % 7 = 0 THEN 'nan'::DOUBLE WHEN d % 11 = 0 THEN 60.0 ELSE 1 + (d % 400) / 10.0::DOUBLE END AS depth FROM
(SELECT o_custkey % 16 AS frame, o_orderkey % 48 AS v, (o_orderkey // 48) % 64 AS u, min(CAST(floor(o_totalprice) AS BIGINT)) AS d FROM orders GROUP BY ALL))"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 16).alias("frame"), (F.col("o_orderkey") % 48).alias("v"), (F.floor(F.col("o_orderkey") / 48) % 64).alias("u")).agg(F.min(F.floor("o_totalprice")).alias("d"))
    depth = F.when(F.col("d") % 7 == 0, float("nan")).when(F.col("d") % 11 == 0, 60.0).otherwise(1 + F.col("d") % 400 / 10.0)
    return o.select("frame", "v", "u", depth.alias("depth"))


OK = "(NOT isnan(depth) AND depth > 0 AND depth <= {})"


@query(f"WITH {PIXELS} SELECT frame, v, u, round((u // 4 * 4 + 2 - 32) / 50.0::DOUBLE * depth, 6) AS x, round((v // 4 * 4 + 2 - 24) / 50.0::DOUBLE * depth, 6) AS y, depth AS z FROM px WHERE {OK.format(50)} AND u % 4 = 0 AND v % 4 = 0")
def p01_unproject(spark: SparkSession, sf: str) -> DataFrame:
    p = frames.unproject(pixels(spark, sf).where(frames.valid_depth(F.col("depth"))), 4, 64, 48, 50.0, 50.0, 32.0, 24.0)
    return rounded(p, "x", "y").select("frame", "v", "u", "x", "y", "z")


@query(f"WITH {PIXELS} SELECT frame, v, u, round((u // 4 * 4 + 2 - 32) / 50.0::DOUBLE * depth, 6) AS x, {OK.format(50)} AS keep FROM px WHERE u % 4 = 2 AND v % 4 = 2 AND NOT isnan(depth)")
def p02_patch_centres(spark: SparkSession, sf: str) -> DataFrame:
    p = frames.unproject(pixels(spark, sf).where(~F.isnan("depth")), 4, 64, 48, 50.0, 50.0, 32.0, 24.0, centred=True)
    return rounded(p, "x").select("frame", "v", "u", "x", frames.valid_depth(F.col("depth")).alias("keep"))


@query(f"WITH {PIXELS} SELECT frame, v // 4 AS pv, u // 4 AS pu, round(avg(depth) FILTER {'(WHERE ' + OK.format(1000)[1:]}, 6) AS depth FROM px GROUP BY frame, v // 4, u // 4")
def p02b_patch_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.patch_mean(pixels(spark, sf), ["frame"], 4), "depth")


@query(f"WITH {OBSERVATIONS}, i AS (SELECT *, 1 / abs(depth) AS i FROM obs), m AS (SELECT view, quantile_cont(i, 0.5) AS m FROM i GROUP BY view) SELECT row_id, round(i / m, 6) AS depth FROM i JOIN m USING (view)")
def p05_proportional_depth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.proportional_depth(observations(spark, sf), ["view"], "depth", infinite=True), "depth").select("row_id", "depth")


@query(f"""WITH {PIXELS}, ok AS (SELECT frame, v, u, depth FROM px WHERE {OK.format(50)}), c AS (SELECT p.frame, p.v, p.u, o.depth, (o.v - p.v) * (o.v - p.v) + (o.u - p.u) * (o.u - p.u) AS d2 FROM px p JOIN ok o ON o.frame = p.frame AND NOT {OK.format(50).replace('depth', 'p.depth')}),
n AS (SELECT frame, v, u, min(d2) AS d2 FROM c GROUP BY ALL) SELECT frame, v, u, CAST(d2 AS BIGINT) AS d2 FROM n""")
def f01_hole_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Squared distance of each hole to the valid pixel that fills it: unlike the depth, it doesn't depend on ties."""
    p = pixels(spark, sf)
    tagged = p.withColumn("depth", F.when(frames.valid_depth(F.col("depth")), 1.0 + F.col("v") * 0.1 + F.col("u") * 0.0001).otherwise(float("nan")))
    filled = frames.fill_nearest(tagged, ["frame"]).withColumnRenamed("depth", "code").join(tagged.where(F.isnan("depth")).select("frame", "v", "u"), ["frame", "v", "u"])
    n = F.round((F.col("code") - 1) * 10000).cast("long")
    fv, fu = F.floor(n / 1000), n % 1000
    return filled.where("code > 0").select("frame", "v", "u", ((fv - F.col("v")) * (fv - F.col("v")) + (fu - F.col("u")) * (fu - F.col("u"))).alias("d2"))


@query(f"WITH {PIXELS} SELECT frame, v, u, CASE WHEN (u % 10) / 10.0::DOUBLE >= 0.3 AND NOT isnan(depth) AND depth > 0 THEN depth END AS depth FROM px")
def s02_confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumn("depth", frames.gated_depth(F.col("depth"), F.col("u") % 10 / 10.0, 0.3))


@query("SELECT user_id % 16 AS frame, count(DISTINCT event_type) AS n_ids, bool_or(event_type = 'click') AS has_click FROM events GROUP BY 1")
def s04_mask_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 16).alias("frame")).agg(F.countDistinct("event_type").alias("n_ids"), F.bool_or(F.col("event_type") == "click").alias("has_click"))


@query(f"WITH {BOXES} SELECT box_id, cx, greatest(sx, sy, sz) AS side FROM boxes WHERE coalesce(confidence, 1.0) >= 0.3")
def s08_box_scan(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).where(F.coalesce("confidence", F.lit(1.0)) >= 0.3).select("box_id", "cx", F.greatest("sx", "sy", "sz").alias("side"))


@query(f"WITH {POINTS}, {BOXES} SELECT point_id, abs(x - cx) <= sx / 2 + 1e-8 AND abs(y - cy) <= sy / 2 + 1e-8 AND abs(z - cz) <= sz / 2 + 1e-8 AS inside FROM pts JOIN boxes ON box_id = label + 1")
def f04_point_in_box(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("label", (F.col("box_id") - 1).cast("int")).drop("scene_id")
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & (F.abs(F.col(a) - F.col(f"c{a}")) <= F.col(f"s{a}") / 2 + 1e-8)
    return points(spark, sf).join(b, "label").select("point_id", inside.alias("inside"))


@query(f"WITH {POINTS}, {BOXES} SELECT point_id, CASE WHEN abs(x - cx) <= sx / 2 + 1e-8 AND abs(y - cy) <= sy / 2 + 1e-8 AND abs(z - cz) <= sz / 2 + 1e-8 THEN label ELSE -1 END AS label FROM pts LEFT JOIN boxes ON box_id = label + 1")
def f05_clean_labels(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("label", (F.col("box_id") - 1).cast("int")).drop("scene_id")
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & (F.abs(F.col(a) - F.col(f"c{a}")) <= F.col(f"s{a}") / 2 + 1e-8)
    rows = points(spark, sf).join(b, "label", "left")
    return rows.select("point_id", F.when(F.coalesce(inside, F.lit(False)), F.col("label")).otherwise(-1).alias("label"))


# A pentagon for each scene.
EDGES = "pent AS (SELECT * FROM (VALUES (3.0,2.0,20.0,4.0),(20.0,4.0,22.0,15.0),(22.0,15.0,10.0,23.0),(10.0,23.0,2.0,12.0),(2.0,12.0,3.0,2.0)) t(x0, y0, x1, y1))"


@query(f"WITH {POINTS}, {EDGES} SELECT scene_id, point_id, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 = 1 AS inside FROM pts, pent GROUP BY scene_id, point_id")
def f07_polygon_prune(spark: SparkSession, sf: str) -> DataFrame:
    corners = [(3.0, 2.0), (20.0, 4.0), (22.0, 15.0), (10.0, 23.0), (2.0, 12.0)]
    p = points(spark, sf)
    sides = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((*a, *b), ("x0", "y0", "x1", "y1"), strict=True))) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)))
    edges = p.select("scene_id").distinct().withColumn("e", F.explode(sides)).select("scene_id", "e.*")
    return frames.odd_crossings(p, edges, ["scene_id"])


@query(f"WITH {VOXELS}, keep AS (SELECT scene_id, vx, vy FROM vox GROUP BY ALL HAVING count(*) >= 10) SELECT point_id FROM vox SEMI JOIN keep USING (scene_id, vx, vy)")
def f09_keep_region(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf)
    keep = v.groupBy("scene_id", "vx", "vy").agg(F.count("*").alias("n")).where("n >= 10")
    return v.join(keep, ["scene_id", "vx", "vy"], "left_semi").select("point_id")


@query(f"""WITH {POINTS}, s AS (SELECT scene_id, label, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e, count(*) AS n FROM pts GROUP BY ALL), k AS (SELECT scene_id, label, row_number() OVER (PARTITION BY scene_id ORDER BY label) - 1 AS new FROM s WHERE label = 0 OR e * e * e <= 0.95::DOUBLE * 24 * 24 * 24)
SELECT point_id, CAST(coalesce(new, -1) AS INTEGER) AS label FROM pts LEFT JOIN k USING (scene_id, label)""")
def f11_oversized_prune(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    side = F.greatest(*(F.max(a) - F.min(a) for a in "xyz"))
    kept = p.groupBy("scene_id", "label").agg(side.alias("e")).where((F.col("label") == 0) | (F.col("e") * F.col("e") * F.col("e") <= F.lit(0.95 * 24 * 24 * 24)))
    kept = kept.withColumn("new", F.row_number().over(W.partitionBy("scene_id").orderBy("label")) - 1)
    return p.join(kept, ["scene_id", "label"], "left").select("point_id", F.coalesce("new", F.lit(-1)).cast("int").alias("label"))


@query(f"WITH {VOXELS}, c AS (SELECT scene_id, vx, vy, vz, count(*) AS n FROM vox GROUP BY ALL), s AS (SELECT a.scene_id, a.vx, a.vy, a.vz, sum(b.n) AS n FROM c a JOIN c b ON a.scene_id = b.scene_id AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 GROUP BY ALL) SELECT scene_id, vx, vy, vz, CAST(n AS BIGINT) AS n FROM s WHERE n > 1")
def f20_support_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = voxel_points(spark, sf).groupBy("scene_id", "vx", "vy", "vz").agg(F.count("*").alias("n"))
    step = lambda v: F.explode(F.array(*(F.col(v) + F.lit(d) for d in (-1, 0, 1)))).alias(v)
    spread = c.select("scene_id", step("vx"), "vy", "vz", "n").select("scene_id", "vx", step("vy"), "vz", "n").select("scene_id", "vx", "vy", step("vz"), "n")
    sums = spread.groupBy("scene_id", "vx", "vy", "vz").agg(F.sum("n").alias("n"))
    return sums.join(c.drop("n"), ["scene_id", "vx", "vy", "vz"], "left_semi").where("n > 1")


@query("""WITH i AS (SELECT doc_id, source || '/' || doc_id AS c0, CAST(doc_id AS VARCHAR) AS c1 FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x' || doc_id END AS k, quality FROM labels),
l AS (SELECT k, quality FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) = 1) SELECT doc_id, quality FROM i JOIN l ON l.k IN (c0, c1)""")
def j11_metadata_candidates(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "documents").select("doc_id", "source")
    m = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("x"), "doc_id")).alias("k"), "quality", F.col("doc_id").alias("n"))
    return lineage.ordered_candidates(i, [F.concat_ws("/", "source", "doc_id"), F.col("doc_id").cast("string")], m, "k", "n").select("doc_id", "quality")


@query("SELECT conv_id, turn, role, t.doc_id IS NOT NULL AS known FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) t ON t.doc_id = c.conv_id")
def j13_ordered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("known")).distinct()
    return table(spark, sf, "conversations").join(known, "conv_id", "left").select("conv_id", "turn", "role", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT DISTINCT l_partkey AS doc_id FROM lineitem ANTI JOIN documents d ON d.doc_id = l_partkey")
def j15_requested(spark: SparkSession, sf: str) -> DataFrame:
    """Part numbers of the order lines, as requested documents: those that aren't there."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc_id")).distinct().join(table(spark, sf, "documents"), "doc_id", "left_anti")


@query("""WITH i AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT k, unnest([k, k + 7, k + 13]) AS cand, unnest([0, 1, 2]) AS pos FROM i), f AS (SELECT k, cand, pos, EXISTS (SELECT 1 FROM customer WHERE c_custkey = cand AND c_mktsegment = 'BUILDING') AS e FROM c)
SELECT k, arg_min(cand, CASE WHEN e THEN pos ELSE pos + 3 END) AS chosen FROM f GROUP BY k""")
def j16_first_existing(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    c = i.select("k", F.posexplode(F.array(F.col("k"), F.col("k") + 7, F.col("k") + 13)).alias("pos", "cand"))
    there = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cand"), F.lit(True).alias("e"))
    rows = c.join(there, "cand", "left").withColumn("rank", F.when(F.col("e"), F.col("pos")).otherwise(F.col("pos") + 3))
    return rows.groupBy("k").agg(F.min_by("cand", "rank").alias("chosen"))


@query(f"WITH {POINTS}, m AS (SELECT p_partkey % 32 AS label, min(p_size) AS gt FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 32 < 20 GROUP BY 1) SELECT point_id, CAST(CASE WHEN label = 0 THEN 0 ELSE coalesce(gt, -1) END AS INTEGER) AS label FROM pts LEFT JOIN m USING (label)")
def j17_relabel(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").where("p_partkey % 3 = 0 and p_partkey % 32 < 20").groupBy((F.col("p_partkey") % 32).cast("int").alias("label")).agg(F.min("p_size").alias("gt"))
    rows = points(spark, sf).join(m, "label", "left")
    return rows.select("point_id", F.when(F.col("label") == 0, 0).otherwise(F.coalesce("gt", F.lit(-1))).cast("int").alias("label"))


@query("""WITH a AS (SELECT l_partkey AS name, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey AS name, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
p AS (SELECT name, list_sort(list_intersect(a.r, b.r)) AS r FROM a JOIN b USING (name)) SELECT name, r[1] AS first, len(r) AS n FROM p WHERE len(r) > 0""")
def j26_paired_manifests(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem")
    side = lambda s: i.where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("name")).agg(F.collect_set("l_returnflag").alias(s))
    both = side("O").join(side("F"), "name").select("name", F.array_sort(F.array_intersect("O", "F")).alias("r")).where(F.size("r") > 0)
    return both.select("name", F.col("r")[0].alias("first"), F.size("r").cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderstatus, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j27_batch_attribute(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "o_orderstatus", "n_name")


@query(f"WITH {VOXELS}, e AS (SELECT DISTINCT scene_id, key FROM vox WHERE label < 4) SELECT DISTINCT label, count(DISTINCT point_id) AS hits FROM vox SEMI JOIN e USING (scene_id, key) WHERE label >= 4 GROUP BY label")
def j30_voxel_collision(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf)
    taken = v.where("label < 4").select("scene_id", "key").distinct()
    return v.where("label >= 4").join(taken, ["scene_id", "key"], "left_semi").groupBy("label").agg(F.countDistinct("point_id").alias("hits"))


@query("""WITH r AS (SELECT source, unnest([0, 90, 180, 270]) AS d FROM (SELECT DISTINCT source FROM documents)), h AS (SELECT source, (doc_id % 4) * 90 AS d, count(*) AS n FROM documents WHERE lang <> 'en' AND doc_id % 3 = 0 GROUP BY ALL)
SELECT d AS degrees, count(*) AS required, count(h.n) AS existing, count(*) - count(h.n) AS missing FROM r LEFT JOIN h USING (source, d) GROUP BY d""")
def a26_completeness(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    wanted = d.select("source").distinct().withColumn("degrees", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 90, 180, 270)))))
    have = d.where("lang <> 'en' and doc_id % 3 = 0").select("source", (F.col("doc_id") % 4 * 90).alias("degrees"), F.lit(1).alias("h")).distinct()
    out = wanted.join(have, ["source", "degrees"], "left").groupBy(F.col("degrees").cast("int").alias("degrees")).agg(F.count("*").alias("required"), F.count("h").alias("existing"))
    return out.withColumn("missing", F.col("required") - F.col("existing"))


@query(f"WITH {POINTS} SELECT scene_id, CAST(floor(x) AS BIGINT) AS row, CAST(floor(y) AS BIGINT) AS col, count(*) AS n FROM pts GROUP BY ALL")
def a20_occupancy_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("scene_id", F.floor("x").alias("row"), F.floor("y").alias("col")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, c AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM pts GROUP BY scene_id) SELECT scene_id, round(mx, 6) AS mx, round(my, 6) AS my, round(0.5::DOUBLE * atan2(2 * c, a - b), 4) AS yaw FROM c")
def a24_principal_yaw(spark: SparkSession, sf: str) -> DataFrame:
    c = points(spark, sf).groupBy("scene_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    return c.select("scene_id", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), F.round(0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b")), 4).alias("yaw"))


@query(f"WITH {OBSERVATIONS} SELECT view, count(DISTINCT cell) AS cells FROM obs GROUP BY view")
def a29_feature_cells(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("view").agg(F.countDistinct("cell").alias("cells"))


@query(f"""WITH {POINTS}, v AS (SELECT label, scene_id, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM pts GROUP BY ALL HAVING count(*) >= 4), m AS (SELECT label, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM v GROUP BY label HAVING count(*) >= 2)
SELECT label, round(quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 0.5), 6) AS spread FROM v JOIN m USING (label) GROUP BY label""")
def a36_centroid_consistency(spark: SparkSession, sf: str) -> DataFrame:
    middle = lambda rows, keys, **of: with_quantiles(rows.groupBy(*keys).agg(F.count("*").alias("n")), rows, keys, of, [0.5]).withColumns({c: F.col(c)[0] for c in of})
    v = middle(points(spark, sf), ["label", "scene_id"], x="x", y="y").where("n >= 4")
    m = middle(v, ["label"], mx="x", my="y").where("n >= 2").drop("n")
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return middle(v.join(m, "label"), ["label"], spread=d).select("label", F.round("spread", 6).alias("spread"))


@query(f"""WITH {POINTS}, t AS (SELECT scene_id, k, cos(radians(k * 0.5::DOUBLE)) * x + sin(radians(k * 0.5::DOUBLE)) * y AS u, cos(radians(k * 0.5::DOUBLE)) * y - sin(radians(k * 0.5::DOUBLE)) * x AS v FROM pts, range(180) r(k)),
s AS (SELECT scene_id, k, quantile_cont(u, 0.99) - quantile_cont(u, 0.01) AS w, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS h FROM t GROUP BY ALL)
SELECT scene_id, k * 0.5::DOUBLE AS yaw, round(w * h, 6) AS area, round(w, 6) AS w, round(h, 6) AS h FROM s QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY round(w * h, 9), k) = 1""")
def a18_enclosing_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    r = rollups.enclosing_rectangle(points(spark, sf).select("scene_id", "x", "y"), ["scene_id"])
    return rounded(r, "yaw", "area", "w", "h")


@query(f"WITH {FACES}, b AS (SELECT mesh_id, e0, e1 FROM sides GROUP BY ALL HAVING count(*) = 1) SELECT mesh_id, vid, count(*) AS n FROM (SELECT mesh_id, unnest([e0, e1]) AS vid FROM b) GROUP BY ALL")
def g08_boundary_vertices(spark: SparkSession, sf: str) -> DataFrame:
    b = mesh.boundary_edges(faces(spark, sf))
    return b.select("mesh_id", F.explode(F.array("e0", "e1")).alias("vid")).groupBy("mesh_id", "vid").agg(F.count("*").alias("n"))


LOOPS = """k AS (SELECT mesh_id, e0, e1, count(*) AS n FROM sides GROUP BY ALL), b AS (SELECT *, row_number() OVER (ORDER BY mesh_id, e0, e1) AS edge FROM k WHERE n = 1),
w AS (SELECT mesh_id, vid, max(n) AS most, count(*) FILTER (n = 1) AS open FROM (SELECT mesh_id, unnest([e0, e1]) AS vid, n FROM k) GROUP BY ALL), t AS (SELECT mesh_id, edge, unnest([e0, e1]) AS vid FROM b), p AS (SELECT min(edge) AS x, max(edge) AS y FROM t JOIN w USING (mesh_id, vid) WHERE most <= 2 AND open = 2 GROUP BY mesh_id, vid),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r AS (SELECT edge, edge AS root FROM b UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.edge), c AS (SELECT edge, min(root) AS root FROM r GROUP BY edge), d AS (SELECT edge, count(*) AS ends FROM (SELECT x AS edge FROM p UNION ALL SELECT y FROM p) GROUP BY edge),
loops AS (SELECT b.mesh_id, c.root, min({'a': e0, 'b': e1}) AS first, count(*) AS n_edges, bool_and(coalesce(ends, 0) >= 2) AS closed FROM b JOIN c USING (edge) LEFT JOIN d USING (edge) GROUP BY b.mesh_id, c.root)"""


@query(f"WITH RECURSIVE {SHEETS}, {LOOPS} SELECT mesh_id, first.a AS loop_e0, first.b AS loop_e1, n_edges, closed FROM loops")
def g10_boundary_loops(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.boundary_loops(sheets(spark, sf)).drop("root")


@query(f"""WITH {POINTS}, q AS (SELECT scene_id, label, quantile_cont(x, 0.4) AS cut, count(*) AS n FROM pts GROUP BY ALL) SELECT point_id FROM pts JOIN q USING (scene_id, label) WHERE NOT (label % 5 = 1 AND n >= 10 AND x < cut)""")
def x01_partial_delete(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    q = with_quantiles(p.groupBy("scene_id", "label").agg(F.count("*").alias("n")), p, ["scene_id", "label"], {"cut": "x"}, [0.4]).withColumn("cut", F.col("cut")[0])
    return p.join(q, ["scene_id", "label"]).where(~((F.col("label") % 5 == 1) & (F.col("n") >= 10) & (F.col("x") < F.col("cut")))).select("point_id")


@query(f"""WITH {POINTS}, s AS (SELECT label, CASE WHEN label = 0 THEN 0 ELSE row_number() OVER (ORDER BY label) END AS new FROM (SELECT DISTINCT label FROM pts WHERE label % 3 = 0)) SELECT point_id, CAST(coalesce(CASE WHEN label = 0 THEN 0 ELSE new - 1 END, -1) AS INTEGER) AS label FROM pts LEFT JOIN s USING (label)""")
def x04_object_subset(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    chosen = p.where("label % 3 = 0").select("label").distinct()  # one row a label: at most as many as there are ids
    new = chosen.withColumn("new", F.row_number().over(W.orderBy("label")) - 1)
    return p.join(new, "label", "left").select("point_id", F.coalesce("new", F.lit(-1)).cast("int").alias("label"))


@query(f"WITH {POINTS}, m AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY scene_id) SELECT point_id, round(1.1::DOUBLE * (0.8::DOUBLE * (x - mx) - 0.6::DOUBLE * (y - my)) + mx, 5) AS x, round(1.1::DOUBLE * (0.6::DOUBLE * (x - mx) + 0.8::DOUBLE * (y - my)) + my, 5) AS y FROM pts JOIN m USING (scene_id)")
def x05_cloud_augmentation(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    m = p.groupBy("scene_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return p.join(m, "scene_id").select("point_id", F.round(1.1 * (0.8 * dx - 0.6 * dy) + F.col("mx"), 5).alias("x"), F.round(1.1 * (0.6 * dx + 0.8 * dy) + F.col("my"), 5).alias("y"))


@query("""WITH r AS (SELECT conv_id, unnest([0, 1, 2]) AS repeat FROM (SELECT DISTINCT conv_id FROM conversations)), h AS (SELECT *, sha256('7:' || conv_id || ':' || repeat) AS h FROM r) SELECT conv_id, CAST(repeat AS INTEGER) AS repeat, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) AS seed FROM h""")
def x07_replay_seeds(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("repeat", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    return r.withColumn("seed", S.sha_seed(F.concat_ws(":", F.lit("7"), F.col("conv_id").cast("string"), F.col("repeat").cast("string"))))


@query("SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS last_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def t07_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(last_n(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 5), "last_n").select("event_id", "last_n")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_id % 100 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE isfinite(value)),
f AS (
  SELECT *, CASE WHEN n >= 8 THEN quantile_cont(y, 0.95) OVER w END AS lim, CASE WHEN n % 4 = 0 THEN {'s': regr_slope(y, x) OVER w, 'i': regr_intercept(y, x) OVER w} END AS fit
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING)
),
g AS (SELECT *, last_value(fit IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS line FROM f)
SELECT event_id, round(lim + 3.1e-8, 5) AS "limit", round(line.s + 3.1e-8, 5) AS slope, round(line.i + 3.1e-8, 5) AS intercept FROM g""")
def t07b_ring_refits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("x", F.col("event_id") % 100)
    rings = ring_over_table(e, "user_id", ["ts", "event_id"], "x", "value", 8, 4, 0.95)
    return rings.select("event_id", *(F.round(F.col(c) + 3.1e-8, 5).alias(c) for c in ("limit", "slope", "intercept")))  # no sum is half of the last digit


@query("SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t08_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: not one of the inventory's operators."""
    w = windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT ON (source) source, doc_id FROM (SELECT * FROM documents ORDER BY source, n_chars DESC, doc_id)")
def w09_argmax_winner(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_per_group(table(spark, sf, "documents"), ["source"], [F.desc("n_chars"), "doc_id"]).select("source", "doc_id")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN i >= n - n // 10 THEN 'val' ELSE 'train' END AS split FROM r""")
def w14_splits(spark: SparkSession, sf: str) -> DataFrame:
    r = ranking.numbered(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "i", "n")
    return r.select("doc_id", F.when(F.col("i") >= F.col("n") - F.floor(F.col("n") / 10), "val").otherwise("train").alias("split"))


@query("SELECT d.doc_id FROM documents d ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 0) t USING (doc_id)")
def u06_validation_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.join(d.where("lang = 'en' and doc_id % 3 = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, json_keys(props)[1] AS first_key FROM events WHERE json_valid(props)")
def p21_lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    key = F.json_object_keys("props")[0]
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").where(m.isNotNull()).select("event_id", F.element_at(m, key).alias("first_value"), key.alias("first_key"))


@query(f"WITH {POINTS}, v AS (SELECT point_id, CASE WHEN label % 7 = 0 THEN 'nan'::DOUBLE WHEN label % 5 = 0 THEN 'inf'::DOUBLE ELSE x END AS x FROM pts) SELECT point_id, CASE WHEN isfinite(x) THEN x END AS x FROM v")
def p23_json_safe(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("label") % 7 == 0, float("nan")).when(F.col("label") % 5 == 0, float("inf")).otherwise(F.col("x"))
    return points(spark, sf).select("point_id", S.finite(x).alias("x"))


@query("SELECT p_partkey, round(sin(p_size / 50.0::DOUBLE * pi()), 6) AS s0, round(cos(p_size / 50.0::DOUBLE * pi()), 6) AS c0, round(sin(p_size / 50.0::DOUBLE * 2 * pi()), 6) AS s1, round(cos(p_size / 50.0::DOUBLE * 2 * pi()), 6) AS c1 FROM part")
def p25_fourier(spark: SparkSession, sf: str) -> DataFrame:
    f = frames.fourier(F.col("p_size") / 50.0, 2)
    return table(spark, sf, "part").select("p_partkey", f.alias("f")).select("p_partkey", *(F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(("s0", "c0", "s1", "c1"))))


@query("SELECT doc_id, CASE WHEN max(CASE WHEN i = 1 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT doc_id, 0 AS i FROM documents UNION ALL SELECT doc_id, 1 FROM labels) GROUP BY doc_id")
def t02_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """What an incremental run over ``documents`` still has to do, given that ``labels`` is its output."""
    done = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("d")).distinct()
    return table(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("d", F.lit(1)).alias("fresh"))
