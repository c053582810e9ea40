"""Queries of seeded placement, with their SQL: a few clauses for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import placement
from scenarium.plans.catalog import query
from scenarium.plans.derived import BOXES, VOXELS, boxes, voxel_points

SEED, SIDE, ROUNDS, SUPPORT, MOST, STOREYS = "11", 32, 3, 0.5, 60, 3


def _draw(turn: int, axis: str, choices: str) -> str:
    return f"CAST('0x' || substr(sha256('{SEED}:' || object || ':{turn}:{axis}'), 1, 8) AS BIGINT) % ({choices})"


def _round(n: int) -> str:
    before = f"taken{n - 1}" if n else "start"
    placed = " UNION ALL ".join(f"SELECT * FROM kept{k}" for k in range(n)) or "SELECT * FROM (SELECT scene_id, object, 0 AS turn, 0 AS dx, 0 AS dy, 0 AS dz FROM size) WHERE false"
    return f"""old{n} AS ({placed}),
drawn{n} AS (
  SELECT scene_id, object, {_draw(n, "vx", f"{SIDE} - nx + 1")} AS dx, {_draw(n, "vy", f"{SIDE} - ny + 1")} AS dy, {_draw(n, "vz", f"least({SIDE} - nz + 1, {STOREYS})")} AS dz
  FROM size ANTI JOIN old{n} USING (scene_id, object)
),
moved{n} AS (SELECT scene_id, object, dx, dy, dz, vz = 0 AS bottom, vx + dx AS vx, vy + dy AS vy, vz + dz AS vz FROM shape JOIN drawn{n} USING (scene_id, object)),
fit{n} AS (
  SELECT m.scene_id, m.object, m.dx, m.dy, m.dz FROM moved{n} m LEFT JOIN {before} t ON t.scene_id = m.scene_id AND t.vx = m.vx AND t.vy = m.vy AND t.vz = m.vz
  LEFT JOIN {before} u ON u.scene_id = m.scene_id AND u.vx = m.vx AND u.vy = m.vy AND u.vz = m.vz - 1
  GROUP BY ALL HAVING count(t.vx) = 0 AND count(*) FILTER (bottom AND (m.vz = 0 OR u.vx IS NOT NULL)) >= {SUPPORT} * count(*) FILTER (bottom)
),
own{n} AS (SELECT scene_id, object, vx, vy, vz FROM moved{n} SEMI JOIN fit{n} USING (scene_id, object)),
late{n} AS (SELECT scene_id, object FROM own{n} QUALIFY object > min(object) OVER (PARTITION BY scene_id, vx, vy, vz)),
kept{n} AS (
  SELECT scene_id, object, {n} AS turn, dx, dy, dz FROM fit{n} ANTI JOIN late{n} USING (scene_id, object)
  LEFT JOIN (SELECT scene_id, count(*) AS have FROM old{n} GROUP BY scene_id) USING (scene_id)
  QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY object) <= {MOST} - coalesce(have, 0)
),
taken{n} AS (SELECT * FROM {before} UNION ALL SELECT scene_id, vx, vy, vz FROM own{n} SEMI JOIN kept{n} USING (scene_id, object))"""


PLACED = f"""{VOXELS}, {BOXES},
start AS (SELECT DISTINCT scene_id, vx, vy, vz FROM vox WHERE label % 16 = 0),
size AS (SELECT scene_id, box_id AS object, CAST(sx AS BIGINT) AS nx, CAST(sy AS BIGINT) AS ny, CAST(sz AS BIGINT) AS nz FROM boxes),
shape AS (SELECT scene_id, object, a.i AS vx, b.i AS vy, c.i AS vz FROM size, range(4) a(i), range(4) b(i), range(4) c(i) WHERE a.i < nx AND b.i < ny AND c.i < nz),
{", ".join(_round(n) for n in range(ROUNDS))}"""


@query(f"WITH {PLACED} SELECT scene_id, object, CAST(turn AS INTEGER) AS turn, dx, dy, dz FROM ({' UNION ALL '.join(f'SELECT * FROM kept{n}' for n in range(ROUNDS))})")
def x01b_placed_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes as blocks of whole voxels, placed among a sixteenth of the scenes' labels."""
    start = voxel_points(spark, sf).where("label % 16 = 0").select("scene_id", "vx", "vy", "vz")
    block = boxes(spark, sf).select("scene_id", F.col("box_id").alias("object"), *(F.col(f"s{a}").cast("long").alias(f"n{a}") for a in "xyz"))
    for a in "xyz":
        block = block.withColumn(f"v{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{a}") - 1)))
    return placement.place(block, start, ["scene_id"], SEED, SIDE, ROUNDS, SUPPORT, MOST, STOREYS)
