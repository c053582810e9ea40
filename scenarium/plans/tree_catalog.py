"""Queries of octree streams and of attributes as deltas along the tree, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.functions import semantics as S
from scenarium.operators import octree, voxels
from scenarium.plans.catalog import FINE, SITE, SPREAD, query
from scenarium.plans.derived import VOXELS, voxel_points

LEVELS, BLOCK = 5, 256
CODES = f"""{VOXELS}, {FINE},
leaf AS (SELECT scene_id, CAST({SPREAD} AS BIGINT) AS code, w % 256 AS w FROM v)"""
NODES = f"""{CODES},
up AS (SELECT scene_id, code, unnest(range({LEVELS})) AS level FROM leaf),
nodes AS (
  SELECT scene_id, level, code >> CAST(3 * ({LEVELS} - level) AS INTEGER) AS node,
    CAST(bit_or(1 << CAST((code >> CAST(3 * ({LEVELS - 1} - level) AS INTEGER)) % 8 AS INTEGER)) AS INTEGER) AS mask
  FROM up GROUP BY ALL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY node << CAST(3 * ({LEVELS} - level) AS INTEGER), level) - 1 AS place FROM nodes
)"""
DELTAS = f"""{CODES},
up AS (SELECT scene_id, code, w, unnest(range({LEVELS + 1})) AS level FROM leaf),
cells AS (SELECT scene_id, level, code >> CAST(3 * ({LEVELS} - level) AS INTEGER) AS node, arg_min(w, code) AS w FROM up GROUP BY ALL),
steps AS (SELECT *, w - lag(w) OVER (PARTITION BY scene_id, level, node >> 3 ORDER BY node) AS step FROM cells),
deltas AS (
  SELECT scene_id, 0 AS slot, CAST(w AS INTEGER) AS delta FROM cells WHERE level = 0
  UNION ALL
  SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY (node >> 3) << CAST(3 * ({LEVELS + 1} - level) AS INTEGER), level, node), CAST((step + 256) % 256 AS INTEGER)
  FROM steps WHERE step IS NOT NULL
)"""


def _voxels(spark: SparkSession, sf: str) -> DataFrame:
    rows = voxel_points(spark, sf).groupBy(*SITE, *voxels.XYZ).agg(F.count("*").alias("w"))
    return rows.select(*SITE, S.morton(*map(F.col, voxels.XYZ)).alias("code"), (F.col("w") % 256).alias("w"))


@query(f"""WITH {NODES},
first AS (SELECT scene_id, place // {BLOCK} AS block, level, node FROM placed WHERE place % {BLOCK} = 0),
above AS (
  SELECT f.scene_id, f.block, string_agg(CAST(n.mask AS VARCHAR), ',' ORDER BY n.level) AS above
  FROM first f JOIN nodes n ON n.scene_id = f.scene_id AND n.level < f.level AND n.node = f.node >> CAST(3 * (f.level - n.level) AS INTEGER) GROUP BY ALL
),
data AS (SELECT scene_id, place // {BLOCK} AS block, string_agg(printf('%02X', mask), '' ORDER BY place) AS bytes FROM placed GROUP BY ALL)
SELECT f.scene_id, f.block, CAST(f.level AS INTEGER) AS level, f.node, coalesce(a.above, '') AS above, d.bytes
FROM first f JOIN data d ON d.scene_id = f.scene_id AND d.block = f.block LEFT JOIN above a ON a.scene_id = f.scene_id AND a.block = f.block""")
def g25b_octree_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = octree.stream(octree.tree(_voxels(spark, sf), SITE, "code", LEVELS), SITE, LEVELS, BLOCK)
    return rows.select(*SITE, "block", "level", "node", F.array_join("above", ",").alias("above"), F.hex("bytes").alias("bytes"))


@query(f"WITH {CODES} SELECT scene_id, code FROM leaf")
def g25c_octree_decoded(spark: SparkSession, sf: str) -> DataFrame:
    nodes = octree.tree(_voxels(spark, sf), SITE, "code", LEVELS)
    return octree.decoded(octree.stream(nodes, SITE, LEVELS, BLOCK), SITE, LEVELS)


@query(f"WITH {DELTAS} SELECT * FROM deltas")
def g26b_parent_delta(spark: SparkSession, sf: str) -> DataFrame:
    return octree.parent_deltas(_voxels(spark, sf), SITE, "code", "w", LEVELS)


@query(f"WITH {CODES} SELECT scene_id, code, CAST(w AS INTEGER) AS value FROM leaf")
def g26c_parent_decoded(spark: SparkSession, sf: str) -> DataFrame:
    leaves = _voxels(spark, sf)
    return octree.from_parent_deltas(octree.parent_deltas(leaves, SITE, "code", "w", LEVELS), leaves, SITE, "code", LEVELS)
