"""Spatial relations derived from the driver's tables: the same arithmetic in Spark and, as SQL, for the cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, RESOLUTION = 24.0, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled point for each line item; ``point_id`` orders them."""
    ident = ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(ident.alias("point_id"), (F.col("l_suppkey") % 8).alias("scene_id"), (F.col("l_quantity") * F.lit(0.48)).alias("x"), (F.col("l_discount") * F.lit(240.0)).alias("y"), (F.col("l_tax") * F.lit(300.0)).alias("z"), (F.col("l_partkey") % 32).cast("int").alias("label"))
    return rows


POINTS = """pts AS (SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS point_id,
  l_suppkey % 8 AS scene_id, l_quantity * 0.48::DOUBLE AS x, l_discount * 240.0::DOUBLE AS y, l_tax * 300.0::DOUBLE AS z,
  CAST(l_partkey % 32 AS INTEGER) AS label FROM lineitem)"""


def voxel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.operators.voxels import with_voxels

    return with_voxels(points(spark, sf_dir), SCALE, RESOLUTION)


_AXIS = "least(greatest(CAST(trunc({0} / 0.75::DOUBLE) AS BIGINT), 0), 31)"
VOXELS = f"""{POINTS}, vox AS (SELECT *, (vx * 32 + vy) * 32 + vz AS key FROM (SELECT *, {_AXIS.format("x")} AS vx, {_AXIS.format("y")} AS vy, {_AXIS.format("z")} AS vz FROM pts))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cell = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 15).cast("long")
    return e.select(F.col("event_id").alias("row_id"), (F.col("user_id") % 16).alias("view"), cell.alias("cell"), F.col("value").alias("depth"), F.col("event_type").alias("object"))


OBSERVATIONS = "obs AS (SELECT event_id AS row_id, user_id % 16 AS view, CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS BIGINT) AS cell, value AS depth, event_type AS object FROM events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upright cuboid for each part."""
    p = table(spark, sf_dir, "part")
    c = lambda a, m: ((F.col("p_partkey") * a) % m) * F.lit(24.0 / m)
    return p.select(
        F.col("p_partkey").alias("box_id"), (F.col("p_partkey") % 8).alias("scene_id"), (F.col("p_size") * F.lit(0.48)).alias("cx"), c(7, 11).alias("cy"), c(5, 9).alias("cz"),
        (F.lit(1.0) + F.col("p_size") % 4).alias("sx"), (F.lit(2.0) + F.col("p_partkey") % 3).alias("sy"), F.lit(3.0).alias("sz"), ((F.col("p_retailprice") - 900) / 100).alias("confidence"),
    )


BOXES = """boxes AS (SELECT p_partkey AS box_id, p_partkey % 8 AS scene_id, p_size * 0.48::DOUBLE AS cx,
  ((p_partkey * 7) % 11) * (24.0::DOUBLE / 11) AS cy, ((p_partkey * 5) % 9) * (24.0::DOUBLE / 9) AS cz,
  1.0::DOUBLE + p_size % 4 AS sx, 2.0::DOUBLE + p_partkey % 3 AS sy, 3.0::DOUBLE AS sz, (p_retailprice - 900) / 100 AS confidence FROM part)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric record for each line item, with a status and the scene of its order."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "evaluated").when(F.col("l_returnflag") == "A", "missing_prediction").otherwise("failed")
    rows = i.join(o, i.l_orderkey == o.o_orderkey)
    return rows.select((F.col("o_custkey") % 16).alias("scene_id"), F.col("l_partkey").alias("object_id"), status.alias("status"), F.col("l_discount").alias("value"), F.col("l_quantity").alias("weight"), F.col("o_orderpriority").alias("group"))


RECORDS = """records AS (SELECT o_custkey % 16 AS scene_id, l_partkey AS object_id, CASE l_returnflag WHEN 'N' THEN 'evaluated'
  WHEN 'A' THEN 'missing_prediction' ELSE 'failed' END AS status, l_discount AS value, l_quantity AS weight, o_orderpriority AS "group"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each line item over 128 vertices of its mesh."""
    i = table(spark, sf_dir, "lineitem")
    fid = ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return i.select((F.col("l_suppkey") % 64).alias("mesh_id"), fid.alias("fid"), (F.col("l_partkey") % 128).alias("v0"), (F.col("l_orderkey") % 128).alias("v1"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 128).alias("v2")).where("v0 <> v1 and v1 <> v2 and v2 <> v0").dropDuplicates(["fid"])


FACES = """faces AS (SELECT DISTINCT ON (fid) * FROM (SELECT l_suppkey % 64 AS mesh_id, ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS fid,
  l_partkey % 128 AS v0, l_orderkey % 128 AS v1, (l_partkey * 3 + l_linenumber) % 128 AS v2 FROM lineitem) WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0),
sides AS (SELECT mesh_id, fid, least(v0, v1) AS e0, greatest(v0, v1) AS e1, v0 <= v1 AS forward FROM faces UNION ALL
  SELECT mesh_id, fid, least(v1, v2), greatest(v1, v2), v1 <= v2 FROM faces UNION ALL SELECT mesh_id, fid, least(v2, v0), greatest(v2, v0), v2 <= v0 FROM faces)"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of squares for each thousand order keys, two triangles each; squares without an order are holes."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("mesh_id"), (F.col("o_orderkey") % 14).alias("i"), (F.col("o_custkey") % 14).alias("j")).distinct()
    at = lambda a, b: (F.col("i") + a) * 15 + F.col("j") + b
    two = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("v0"), y.alias("v1"), z.alias("v2")) for k, (x, y, z) in enumerate(((at(0, 0), at(1, 0), at(1, 1)), (at(0, 0), at(1, 1), at(0, 1))))))
    return o.select("mesh_id", "i", "j", F.explode(two).alias("t")).select("mesh_id", ((F.col("mesh_id") * 196 + F.col("i") * 14 + F.col("j")) * 2 + F.col("t.k")).alias("fid"), "t.v0", "t.v1", "t.v2")


SHEETS = """sq AS (SELECT DISTINCT o_orderkey // 1000 AS mesh_id, o_orderkey % 14 AS i, o_custkey % 14 AS j FROM orders), faces AS (SELECT mesh_id, ((mesh_id * 196 + i * 14 + j) * 2) AS fid, i * 15 + j AS v0, (i + 1) * 15 + j AS v1, (i + 1) * 15 + j + 1 AS v2 FROM sq
  UNION ALL SELECT mesh_id, ((mesh_id * 196 + i * 14 + j) * 2 + 1), i * 15 + j, (i + 1) * 15 + j + 1, i * 15 + j + 1 FROM sq),
sides AS (SELECT mesh_id, fid, least(v0, v1) AS e0, greatest(v0, v1) AS e1 FROM faces UNION ALL SELECT mesh_id, fid, least(v1, v2), greatest(v1, v2) FROM faces UNION ALL SELECT mesh_id, fid, least(v2, v0), greatest(v2, v0) FROM faces)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of ``faces`` on a lattice."""
    from scenarium.operators.mesh import face_corners

    used = face_corners(faces(spark, sf_dir)).select("mesh_id", "vid").distinct()
    return used.select("mesh_id", "vid", (F.col("vid") % 8).cast("double").alias("x"), (F.floor(F.col("vid") / 8) % 4).cast("double").alias("y"), F.floor(F.col("vid") / 32).cast("double").alias("z"))


VERTICES = f"""{FACES}, vertices AS (SELECT mesh_id, vid, CAST(vid % 8 AS DOUBLE) AS x, CAST((vid // 8) % 4 AS DOUBLE) AS y, CAST(vid // 32 AS DOUBLE) AS z
  FROM (SELECT DISTINCT mesh_id, unnest([v0, v1, v2]) AS vid FROM faces))"""
