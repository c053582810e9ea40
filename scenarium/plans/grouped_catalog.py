"""Registered queries of the steps that run in one small group at a time, and of mesh repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import grouped, mesh
from scenarium.plans.catalog import query, rounded
from scenarium.plans.derived import BOXES, FACES, POINTS, SHEETS, VOXELS, boxes, faces, points, sheets, table, voxel_points
from scenarium.plans.scene_catalog import LOOPS


def _hilbert_sql() -> str:
    """A clause for each bit and axis: where the bit is set the lower bits of the first axis turn over, else they change places with the axis's."""
    clauses, last = ["h0 AS (SELECT DISTINCT vx, vy, vz, vx AS a0, vy AS a1, vz AS a2 FROM vox)"], 0
    for bit in range(9, 0, -1):
        low = (1 << bit) - 1
        for i in range(3):
            now = {0: f"CASE WHEN (a{i} >> {bit}) & 1 = 1 THEN xor(a0, {low}) ELSE xor(a0, xor(a0, a{i}) & {low}) END"}
            if i:
                now[i] = f"CASE WHEN (a{i} >> {bit}) & 1 = 1 THEN a{i} ELSE xor(a{i}, xor(a0, a{i}) & {low}) END"
            clauses.append(f"h{last + 1} AS (SELECT vx, vy, vz, {', '.join(f'{now.get(k, f"a{k}")} AS a{k}' for k in range(3))} FROM h{last})")
            last += 1
    gray = "0"
    for bit in range(9, 0, -1):
        gray = f"xor({gray}, CASE WHEN (c2 >> {bit}) & 1 = 1 THEN {(1 << bit) - 1} ELSE 0 END)"
    clauses.append(f"g AS (SELECT vx, vy, vz, a0 AS c0, xor(a1, a0) AS c1, xor(a2, xor(a1, a0)) AS c2 FROM h{last})")
    clauses.append(f"t AS (SELECT vx, vy, vz, xor(c0, {gray}) AS b0, xor(c1, {gray}) AS b1, xor(c2, {gray}) AS b2 FROM g)")
    code = " + ".join(f"(((b{i} >> {bit}) & 1) << {3 * bit + 2 - i})" for bit in range(10) for i in range(3))
    return f"WITH {VOXELS}, {', '.join(clauses)} SELECT vx, vy, vz, CAST({code} AS BIGINT) AS code FROM t"


@query(_hilbert_sql())
def p13b_hilbert(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel_points(spark, sf).select("vx", "vy", "vz").distinct()
    return v.withColumn("code", grouped.hilbert("vx", "vy", "vz"))


@query()
def p18b_blake_seed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", grouped.blake_seed(F.concat_ws("::", F.lit("7"), "source", F.col("doc_id").cast("string"))).alias("seed"))


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT box_id // 512 * 8 + scene_id AS block, box_id AS item, cx, cy, cz FROM boxes),
t AS (SELECT block, item, cx, cy, cz, 0::BIGINT AS rank, [item] AS seen FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY item) = 1
UNION ALL SELECT block, best.item, best.cx, best.cy, best.cz, rank + 1, list_append(seen, best.item) FROM (SELECT t.block, t.rank, t.seen,
arg_min({{'item': s.item, 'cx': s.cx, 'cy': s.cy, 'cz': s.cz}}, (round(sqrt((s.cx - t.cx) ** 2 + (s.cy - t.cy) ** 2 + (s.cz - t.cz) ** 2) + 1.5::DOUBLE * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cos(s.cx) * cos(t.cx) + sin(s.cx) * sin(t.cx)))), 9), s.item)) AS best
FROM t JOIN s ON s.block = t.block AND NOT list_contains(t.seen, s.item) GROUP BY ALL)) SELECT block, item, rank FROM t""")
def g29_greedy_tour(spark: SparkSession, sf: str) -> DataFrame:
    """A tour through the boxes of each small block of a scene."""
    b = boxes(spark, sf)
    block = (F.floor(F.col("box_id") / 512) * 8 + F.col("scene_id")).alias("block")
    stops = b.select(block, F.col("box_id").alias("item"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.cos("cx").alias("fx"), F.sin("cx").alias("fy"), F.lit(0.0).alias("fz"))
    return grouped.greedy_tour(stops, "block")


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT box_id // 512 * 8 + scene_id AS block, box_id AS item, cx, cy, cos(cz) * sy AS dx, sin(cz) * sx AS dy FROM boxes),
q AS (SELECT block, item, dx / l AS ux, dy / l AS uy, cx + dx / 2 AS mx, cy + dy / 2 AS my, row_number() OVER (PARTITION BY block ORDER BY round(l, 9) DESC, item) AS n FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM s)),
k AS (SELECT block, 0::BIGINT AS n, []::STRUCT(ux DOUBLE, uy DOUBLE, mx DOUBLE, my DOUBLE)[] AS kept, NULL::BIGINT AS item FROM q WHERE n = 1
UNION ALL SELECT k.block, q.n, CASE WHEN near THEN kept ELSE list_append(kept, {{'ux': q.ux, 'uy': q.uy, 'mx': q.mx, 'my': q.my}}) END, CASE WHEN NOT near THEN q.item END FROM k JOIN q ON q.block = k.block AND q.n = k.n + 1,
LATERAL (SELECT len(list_filter(kept, lambda o: abs(q.ux * o.ux + q.uy * o.uy) >= 0.98 AND abs((q.my - o.my) * o.ux - (q.mx - o.mx) * o.uy) < 0.5)) > 0 AS near))
SELECT block, item FROM k WHERE item IS NOT NULL""")
def w20_distinct_segments(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    block = (F.floor(F.col("box_id") / 512) * 8 + F.col("scene_id")).alias("block")
    return grouped.distinct_segments(b.select(block, F.col("box_id").alias("item"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + F.cos(F.col("cz")) * F.col("sy")).alias("x1"), (F.col("cy") + F.sin(F.col("cz")) * F.col("sx")).alias("y1")), "block")


@query()
def j28_trimmed_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's coarse voxels with odd point ids onto those with even ones."""
    v = voxel_points(spark, sf)
    coarse = [F.floor(F.col(c) / 8).alias(f"c{c}") for c in ("vx", "vy", "vz")]
    side = v.groupBy(F.col("label").cast("long").alias("label"), (F.col("point_id") % 2).alias("side"), *coarse).agg(*(F.avg(a).alias(a) for a in "xyz"))
    return rounded(grouped.trimmed_alignment(side.select("label", "side", "x", "y", "z"), "label"), "scale", "residual", digits=4)


@query(f"""WITH {POINTS}, s AS (SELECT scene_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY ALL), a AS (SELECT scene_id, k, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, abs(degrees(atan2(y1 - y0, x1 - x0)) - k * 0.5::DOUBLE) < 2.0 AS near FROM s, range(180) t(k)),
c AS (SELECT scene_id, k, count(*) FILTER (near) AS n, round(sum(len) FILTER (near), 6) AS len FROM a GROUP BY ALL) SELECT scene_id, CAST(arg_max(k, (n, coalesce(len, 0), -k)) AS INTEGER) AS step, max(n) AS n FROM c GROUP BY scene_id""")
def a27_alignment_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The direction, in half degrees, that most segments lie along; ties by length, then the smaller angle."""
    s = points(spark, sf).groupBy("scene_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    a = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(179))))
    near = F.abs(F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))) - F.col("k") * 0.5) < 2.0
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    c = a.groupBy("scene_id", "k").agg(F.count_if(near).alias("n"), F.coalesce(F.round(F.sum(F.when(near, length)), 6), F.lit(0.0)).alias("len"))
    best = c.groupBy("scene_id").agg(F.max(F.struct("n", "len", (-F.col("k")).alias("m"))).alias("b"))
    return best.select("scene_id", (-F.col("b.m")).alias("step"), F.col("b.n").alias("n"))


@query(f"""WITH RECURSIVE {SHEETS}, {LOOPS}, o AS (SELECT root, mesh_id, first, sum(sqrt((e1 // 15 - e0 // 15) ** 2 + (e1 % 15 - e0 % 15) ** 2)) AS perimeter FROM loops JOIN c USING (root) JOIN b USING (edge, mesh_id) WHERE closed GROUP BY ALL HAVING perimeter < 9),
n AS (SELECT root, mesh_id, -row_number() OVER (PARTITION BY mesh_id ORDER BY first) AS vid FROM o) SELECT mesh_id, e0 AS v0, e1 AS v1, vid AS v2 FROM n JOIN c USING (root) JOIN b USING (edge, mesh_id)""")
def g18_filled_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Fans over the holes of the sheets of a perimeter under nine sides of a square."""
    f = sheets(spark, sf)
    corners = mesh.face_corners(f).select("mesh_id", "vid").distinct()
    v = corners.select("mesh_id", "vid", F.floor(F.col("vid") / 15).cast("double").alias("x"), (F.col("vid") % 15).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return mesh.filled_holes(f, v, 9.0)[1]


@query(f"""WITH RECURSIVE {FACES}, p AS (SELECT min(fid) AS f0, max(fid) AS f1, count(*) FILTER (forward) AS along FROM sides GROUP BY mesh_id, e0, e1 HAVING count(*) = 2),
n AS (SELECT f0 * 2 + t AS a, f1 * 2 + (t + CASE WHEN along <> 1 THEN 1 ELSE 0 END) % 2 AS b FROM p, range(2) k(t)), l AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT mesh_id, fid, v0, CASE WHEN root % 2 = 1 THEN v2 ELSE v1 END AS v1, CASE WHEN root % 2 = 1 THEN v1 ELSE v2 END AS v2 FROM faces LEFT JOIN c ON node = fid * 2""")
def g18c_orientation(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.oriented(faces(spark, sf))
