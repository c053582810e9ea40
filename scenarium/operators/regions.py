"""Regions of a plane grid, and filters against boxes and backgrounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.operators.graph import connected_components


def filled(cells: DataFrame, key: str, resolution: int) -> DataFrame:
    """``(key, row, col)`` of a region with its holes: free cells from which the border can't be reached over free cells.

    The free cells of each group are components of a grid graph in which all border cells hang together. A group
    has at most ``resolution`` squared cells, numbered with it so that groups don't touch.
    """
    size = resolution * resolution
    groups = cells.select(key).distinct()
    grid = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    free = grid.join(cells.select(key, (F.col("row") * resolution + F.col("col")).alias("cell")), [key, "cell"], "left_anti")
    node = F.col(key) * (size + 1) + F.col("cell") + 1  # 0 of each group is the border
    row, col = F.floor(F.col("cell") / resolution), F.col("cell") % resolution
    steps = free.select(key, "cell", F.explode(F.array(*(F.struct(d.alias("step"), ok.alias("ok")) for d, ok in ((F.lit(1), col < resolution - 1), (F.lit(resolution), row < resolution - 1))))).alias("s")).where("s.ok")
    steps = steps.select(key, "cell", (F.col("cell") + F.col("s.step")).alias("to"))
    links = steps.join(free.select(key, F.col("cell").alias("to")), [key, "to"]).select(node.alias("src"), (F.col(key) * (size + 1) + F.col("to") + 1).alias("dst"))
    edge = free.where((row == 0) | (col == 0) | (row == resolution - 1) | (col == resolution - 1)).select(node.alias("src"), (F.col(key) * (size + 1)).alias("dst"))
    outside = connected_components(links.union(edge)).where((F.col("component") % (size + 1) == 0) & (F.col("node") % (size + 1) != 0)).select(F.col("node").alias("n"))
    kept = grid.withColumn("n", node).join(outside, "n", "left_anti")
    return kept.select(key, F.floor(F.col("cell") / resolution).cast("long").alias("row"), (F.col("cell") % resolution).cast("long").alias("col"))


def near_box_faces(points: DataFrame, key: str, threshold: float, least: int, most: float) -> DataFrame:
    """Labels, with -1 for background points far from the faces of the scene's bounds.

    Background is the most frequent label (ties: the smallest). If fewer than ``least`` of its points are near
    enough, the threshold grows to the distance of the ``least``-th, up to ``most``.
    """
    counts = points.groupBy(key, "label").agg(F.count("*").alias("c"))
    ground = counts.groupBy(key).agg(F.max(F.struct("c", (-F.col("label")).alias("n"))).alias("b")).select(key, (-F.col("b.n")).alias("ground"))
    box = points.groupBy(key).agg(*(f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"))
    gap = F.least(*(F.least(F.col(a) - F.col(f"lo{a}"), F.col(f"hi{a}") - F.col(a)) for a in "xyz"))
    rows = points.join(ground, key).join(box, key).withColumn("_d", F.when(F.col("label") == F.col("ground"), gap))
    # the distances are counted in steps, so that the threshold needs no sorted list of all points
    steps = rows.where("_d is not null").groupBy(key, "_d").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(key).orderBy("_d"))
    kth = steps.withColumn("upto", upto).where(F.col("upto") >= least).groupBy(key).agg(F.min("_d").alias("kth"))
    limit = F.greatest(F.lit(threshold), F.least(F.coalesce("kth", F.lit(most)), F.lit(most)))
    out = rows.join(kth, key, "left")
    return out.select("point_id", F.when(F.col("_d").isNull() | (F.col("_d") <= limit), F.col("label")).otherwise(-1).cast("int").alias("label"))


def walls_to_rooms(walls: DataFrame, rooms: DataFrame, key: str, within: float = 0.05) -> DataFrame:
    """``(key, wall, room)``: a wall whose middle is so near to the outlines of two rooms or more goes to the nearest two, else to the nearest; ties to the smaller room.

    Rooms are rectangles ``x0, y0, x1, y1``; a scene has few of them, so that each wall looks at all of its scene.
    """
    dx, dy = (F.greatest(F.col(f"{a}0") - F.col(a), F.col(a) - F.col(f"{a}1")) for a in "xy")
    outside = F.sqrt(F.pow(F.greatest(dx, F.lit(0.0)), F.lit(2)) + F.pow(F.greatest(dy, F.lit(0.0)), F.lit(2)))
    distance = F.when((dx <= 0) & (dy <= 0), F.least(-dx, -dy)).otherwise(outside)
    near = walls.join(rooms, key).select(key, "wall", "room", F.round(distance, 9).alias("d"))
    # the limit holds in each task before the shuffle, so that no wall's rooms are gathered
    nth = F.row_number().over(W.partitionBy(key, "wall").orderBy("d", "room"))
    nearest_two = near.withColumn("_n", nth).where(F.col("_n") <= 2)
    return nearest_two.where((F.col("_n") == 1) | (F.col("d") <= within)).select(key, "wall", "room")
