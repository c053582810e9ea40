"""Registered queries over regions, backgrounds and replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import regions
from scenarium.operators.spatial import AXES, _cell, _neighbour_cells
from scenarium.plans.catalog import query
from scenarium.plans.derived import BOXES, POINTS, boxes, points

CELLS = "cells AS (SELECT scene_id, CAST(least(floor(x / 2), 11) AS BIGINT) AS row, CAST(least(floor(y / 2), 11) AS BIGINT) AS col FROM pts GROUP BY ALL HAVING count(*) % 3 <> 0)"


@query(f"""WITH RECURSIVE {POINTS}, {CELLS}, g AS (SELECT scene_id, r AS row, c AS col FROM (SELECT DISTINCT scene_id FROM cells), range(12) a(r), range(12) b(c)), f AS (SELECT * FROM g ANTI JOIN cells USING (scene_id, row, col)),
o AS (SELECT scene_id, row, col FROM f WHERE row IN (0, 11) OR col IN (0, 11) UNION SELECT f.scene_id, f.row, f.col FROM o JOIN f ON f.scene_id = o.scene_id AND abs(f.row - o.row) + abs(f.col - o.col) = 1)
SELECT * FROM g ANTI JOIN o USING (scene_id, row, col)""")
def f21_filled_region(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda a: F.least(F.floor(F.col(a) / 2), F.lit(11)).cast("long")
    cells = points(spark, sf).groupBy("scene_id", at("x").alias("row"), at("y").alias("col")).agg(F.count("*").alias("n")).where("n % 3 <> 0")
    return regions.filled(cells, "scene_id", 12)


@query(f"WITH {POINTS}, r AS (SELECT point_id, 0.8::DOUBLE * (x - 12) + 0.6::DOUBLE * (y - 12) AS u, 0.8::DOUBLE * (y - 12) - 0.6::DOUBLE * (x - 12) AS v, z FROM pts) SELECT point_id FROM r WHERE abs(u) <= 8 * 1.1::DOUBLE AND abs(v) <= 7 * 1.1::DOUBLE AND abs(z - 12) <= 11 * 1.1::DOUBLE")
def f08_turned_box(spark: SparkSession, sf: str) -> DataFrame:
    dx, dy = F.col("x") - 12, F.col("y") - 12
    u, v = 0.8 * dx + 0.6 * dy, 0.8 * dy - 0.6 * dx
    return points(spark, sf).where((F.abs(u) <= 8 * F.lit(1.1)) & (F.abs(v) <= 7 * F.lit(1.1)) & (F.abs(F.col("z") - 12) <= 11 * F.lit(1.1))).select("point_id")


@query(f"""WITH {POINTS}, g AS (SELECT scene_id, arg_max(label, (c, -label)) AS ground FROM (SELECT scene_id, label, count(*) AS c FROM pts GROUP BY ALL) GROUP BY scene_id),
b AS (SELECT scene_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM pts GROUP BY scene_id),
d AS (SELECT point_id, scene_id, label, CASE WHEN label = ground THEN least(x - ax, bx - x, y - ay, by_ - y, z - az, bz - z) END AS d FROM pts JOIN g USING (scene_id) JOIN b USING (scene_id)),
k AS (SELECT scene_id, d AS kth FROM d WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY d) = 40)
SELECT point_id, CAST(CASE WHEN d IS NULL OR d <= greatest(0.3, least(coalesce(kth, 2.0), 2.0)) THEN label ELSE -1 END AS INTEGER) AS label FROM d LEFT JOIN k USING (scene_id)""")
def f10_background_near_faces(spark: SparkSession, sf: str) -> DataFrame:
    return regions.near_box_faces(points(spark, sf), "scene_id", 0.3, 40, 2.0)


@query(f"""WITH {BOXES}, c AS (SELECT a.box_id, b.box_id AS other, sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) AS d, a.sx * a.sy / (b.sx * b.sy) AS ratio FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND a.box_id // 8 % 2 = 0 AND b.box_id // 8 % 2 = 1),
n AS (SELECT box_id, arg_min(other, (d, other)) AS other FROM c WHERE d <= 2 AND ratio BETWEEN 0.5 AND 2 GROUP BY box_id) SELECT b.box_id, coalesce(n.other, 0) AS replacement FROM boxes b LEFT JOIN n USING (box_id) WHERE b.box_id // 8 % 2 = 0""")
def j23_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest kept box within a radius and a ratio of size, else 0; candidates meet in neighbouring cells."""
    b = boxes(spark, sf).select("box_id", "scene_id", *(F.col(f"c{a}").alias(a) for a in AXES), (F.col("sx") * F.col("sy")).alias("area")).withColumn("half", F.floor(F.col("box_id") / 8) % 2)
    # boxes of one place and area are one on either side: of the kept ones the least name, and all lost ones get the same
    kind = ["scene_id", *AXES, "area"]
    lost, kept = b.where("half = 0"), b.where("half = 1").groupBy(*kind).agg(F.min("box_id").alias("other"))
    at = lost.select(*kind).distinct().select(*kind, *_cell(2.0)).withColumn("n", _neighbour_cells())
    at = at.select(*kind, *((F.col(f"g{a}") + F.col(f"n.{i}")).alias(f"g{a}") for a, i in zip(AXES, "ijk", strict=True)))
    there = kept.select("scene_id", "other", *(F.col(a).alias(f"t{a}") for a in AXES), F.col("area").alias("tarea"), *_cell(2.0))
    d = F.sqrt(sum(((F.col(a) - F.col(f"t{a}")) * (F.col(a) - F.col(f"t{a}")) for a in AXES), F.lit(0.0)))
    pairs = at.join(there, ["scene_id", *(f"g{a}" for a in AXES)]).withColumn("d", d).where((F.col("d") <= 2) & (F.col("area") / F.col("tarea")).between(0.5, 2))
    best = pairs.groupBy(*kind).agg(F.min(F.struct("d", "other")).alias("b"))
    return lost.join(best, kind, "left").select("box_id", F.coalesce("b.other", F.lit(0)).alias("replacement"))


@query(f"WITH {BOXES} SELECT a.scene_id, round(sum(a.confidence * abs(a.cx - b.cx)) / sum(a.confidence), 5) AS position, round(avg(CASE WHEN abs(a.sx - b.sx) < 1.5 THEN 1.0 ELSE 0 END), 6) AS scale_hits FROM boxes a JOIN boxes b ON b.box_id = a.box_id + 8 GROUP BY a.scene_id")
def a30_pose_errors(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    o = b.select((F.col("box_id") - 8).alias("box_id"), F.col("cx").alias("ox"), F.col("sx").alias("os"))
    e = F.abs(F.col("cx") - F.col("ox"))
    return b.join(o, "box_id").groupBy("scene_id").agg(F.round(F.sum(F.col("confidence") * e) / F.sum("confidence"), 5).alias("position"), F.round(F.avg((F.abs(F.col("sx") - F.col("os")) < 1.5).cast("double")), 6).alias("scale_hits"))
