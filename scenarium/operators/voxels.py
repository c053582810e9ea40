"""Voxel relations: pooling, votes, label transfer, resampling, rotation, closing and octree masks."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.functions.semantics import linear_key, morton, voxel_index

XYZ = ["vx", "vy", "vz"]


def with_voxels(points: DataFrame, scale: float, resolution: int) -> DataFrame:
    """Adds vx, vy, vz and the linear ``key``."""
    out = points.withColumns({v: voxel_index(F.col(c), scale, resolution) for v, c in zip(XYZ, "xyz", strict=True)})
    return out.withColumn("key", linear_key(*map(F.col, XYZ), resolution))


def pool_mean(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))


def pool_first(points: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def pool_last(points: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last row by ``order`` wins, the deterministic form of concurrent overwriting."""
    return points.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def vote(points: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Majority label of each key, -1 on an exact tie; how many labels it has and how many points lost."""
    counts = points.groupBy(*keys, label).agg(F.count("*").alias("c"))
    best = F.max(F.struct("c", F.col(label)))
    won = counts.groupBy(*keys).agg(best.alias("best"), F.sum("c").alias("n"), F.count("*").alias("n_labels"), F.collect_list("c").alias("cs"))
    tie = F.size(F.filter("cs", lambda c: c == F.col("best.c"))) > 1
    return won.select(*keys, F.when(tie, F.lit(-1)).otherwise(F.col(f"best.{label}")).cast("int").alias(label), "n", "n_labels", (F.col("n") - F.col("best.c")).alias("minority"), tie.alias("tie"))


def transfer_labels(dense: DataFrame, source: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """``dense`` with the voted label of the source voxel it lies in, else -1."""
    votes = vote(source, keys, label).select(*keys, label)
    return dense.drop(label).join(votes, keys, "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def child_slot(factor: int = 2) -> Column:
    return (F.col("vx") % factor * factor + F.col("vy") % factor) * factor + F.col("vz") % factor


def downsample(voxels: DataFrame, keys: list[str], value: str, factor: int = 2) -> DataFrame:
    """Coarse voxels with the mean and maximum of their children and a bitmap of which exist."""
    coarse = {v: F.floor(F.col(v) / factor).cast("long") for v in XYZ}
    rows = voxels.withColumn("bit", F.pow(F.lit(2.0), child_slot(factor)).cast("long")).withColumns(coarse)
    return rows.groupBy(*keys, *XYZ).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.bit_or("bit").alias("children"))


def upsample(voxels: DataFrame, keys: list[str], factor: int = 2) -> DataFrame:
    """The fine voxels whose bit is set in ``children``."""
    n = factor**3
    slots = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(F.col("children") / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1)
    rows = voxels.withColumn("slot", F.explode(slots))
    at = {"vx": F.floor(F.col("slot") / (factor * factor)), "vy": F.floor(F.col("slot") / factor) % factor, "vz": F.col("slot") % factor}
    return rows.select(*keys, *((F.col(v) * factor + at[v]).cast("long").alias(v) for v in XYZ))


def space_to_channel(voxels: DataFrame, keys: list[str], value: str, factor: int = 2) -> DataFrame:
    """Children's values in slot order, null where a child is missing."""
    coarse = {v: F.floor(F.col(v) / factor).cast("long") for v in XYZ}
    rows = voxels.withColumn("slot", child_slot(factor).cast("int")).withColumns(coarse)
    slots = [F.max(F.when(F.col("slot") == i, F.col(value))).alias(f"c{i}") for i in range(factor**3)]
    return rows.groupBy(*keys, *XYZ).agg(*slots)


def quarter_yaw(voxels: DataFrame, resolution: int) -> DataFrame:
    """Each voxel turned by 0, 90, 180 and 270 degrees about z, in whole numbers."""
    x, y, top = F.col("vx"), F.col("vy"), F.lit(resolution - 1)
    turns = F.array(*(F.struct(F.lit(d).alias("degrees"), a.alias("rx"), b.alias("ry")) for d, a, b in ((0, x, y), (90, top - y, x), (180, top - x, top - y), (270, y, top - x))))
    return voxels.withColumn("t", F.explode(turns)).select("*", "t.degrees", "t.rx", "t.ry").drop("t")


def pack_flags(a: Column, b: Column, c: Column) -> Column:
    return a.cast("int") + 2 * b.cast("int") + 4 * c.cast("int")


def unpack_flag(flags: Column, bit: int) -> Column:
    return F.floor(flags / (1 << bit)).cast("int") % 2 == 1


def shifted_flags(voxels: DataFrame, keys: list[str], flags: str, shift: tuple[int, int, int], bit: int) -> DataFrame:
    """Flag ``bit`` of the voxel at ``shift``, put on this voxel; dropped where there is none."""
    other = voxels.select(*keys, *((F.col(v) - s).alias(v) for v, s in zip(XYZ, shift, strict=True)), unpack_flag(F.col(flags), bit).alias("moved"))
    return voxels.join(other, [*keys, *XYZ]).select(*keys, *XYZ, F.col("moved"))


def support_scores(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of the occupied voxels of each group."""
    p = pred.select(*keys, *XYZ).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys, *XYZ).distinct().withColumn("t", F.lit(1))
    both = p.join(t, [*keys, *XYZ], "full").groupBy(*keys)
    sums = both.agg(F.sum(F.coalesce("p", F.lit(0))).alias("n_pred"), F.sum(F.coalesce("t", F.lit(0))).alias("n_true"), F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("n_both"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumns({"precision": ratio("n_both", "n_pred"), "recall": ratio("n_both", "n_true"), "f1": F.when(F.col("n_pred") + F.col("n_true") > 0, 2 * F.col("n_both") / (F.col("n_pred") + F.col("n_true"))).otherwise(0.0)})


def occupancy(voxels: DataFrame, groups: DataFrame, keys: list[str], resolution: int) -> DataFrame:
    """Every cell of every group's grid, +1 where occupied and -1 elsewhere."""
    cells = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(resolution**3 - 1))))
    grid = cells.select(*keys, F.floor(F.col("cell") / resolution**2).cast("long").alias("vx"), (F.floor(F.col("cell") / resolution) % resolution).cast("long").alias("vy"), (F.col("cell") % resolution).cast("long").alias("vz"))
    taken = voxels.select(*keys, *XYZ).distinct().withColumn("taken", F.lit(1))
    return grid.join(taken, [*keys, *XYZ], "left").select(*keys, *XYZ, F.coalesce("taken", F.lit(-1)).alias("value"))


def l1_ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [o for o in product(r, r, r) if sum(map(abs, o)) <= radius]


def _around(voxels: DataFrame, keys: list[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    o = F.explode(F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(x, ("dx", "dy", "dz"), strict=True))) for x in offsets)))
    return voxels.withColumn("o", o).select(*keys, *((F.col(v) + F.col(f"o.{d}")).cast("long").alias(v) for v, d in zip(XYZ, ("dx", "dy", "dz"), strict=True)))


def close_voxels(voxels: DataFrame, keys: list[str], resolution: int, radius: int = 1) -> DataFrame:
    """Dilation by the L1 ball within the grid, then erosion in which cells beyond the border count as filled."""
    offsets = l1_ball(radius)
    inside = " and ".join(f"{v} between 0 and {resolution - 1}" for v in XYZ)
    grown = _around(voxels.select(*keys, *XYZ), keys, offsets).where(inside).distinct()
    # a grown voxel gives one to each neighbour that is in the grid; full marks keep it
    given = _around(grown, keys, offsets).where(inside).groupBy(*keys, *XYZ).agg(F.count("*").alias("marks"))
    wanted = sum((F.when(_inside(o, resolution), 1).otherwise(0) for o in offsets), F.lit(0))
    return grown.join(given, [*keys, *XYZ]).where(F.col("marks") == wanted).select(*keys, *XYZ)


def _inside(o: tuple[int, int, int], resolution: int) -> Column:
    tests = [(F.col(v) + d).between(0, resolution - 1) for v, d in zip(XYZ, o, strict=True)]
    return tests[0] & tests[1] & tests[2]


def octree_masks(voxels: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(level, code of the node, mask of its children) of the octree over the Morton codes; level 0 is the root."""
    codes = voxels.select(*keys, morton(*map(F.col, XYZ)).alias("code")).distinct()
    up = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright("code", 3 * (levels - n)).alias("node"), F.pow(F.lit(2.0), F.shiftright("code", 3 * (levels - n - 1)) % 8).cast("int").alias("bit")) for n in range(levels))))
    return codes.select(*keys, up.alias("u")).groupBy(*keys, "u.level", "u.node").agg(F.bit_or("u.bit").alias("mask"))


def neighbour_deltas(voxels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value less that of the first occupied lower neighbour (xyz, yz, xz, xy, z, y, x), modulo 256."""
    order = [(1, 1, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    lower = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz"), strict=True))) for i, o in enumerate(order))))
    offers = voxels.withColumn("o", lower).select(*keys, *((F.col(v) + F.col(f"o.{d}")).cast("long").alias(v) for v, d in zip(XYZ, ("dx", "dy", "dz"), strict=True)), F.struct("o.i", F.col(value).alias("v")).alias("offer"))
    best = offers.groupBy(*keys, *XYZ).agg(F.min("offer").alias("offer"))
    return voxels.join(best, [*keys, *XYZ], "left").select(*keys, *XYZ, F.pmod(F.col(value) - F.coalesce("offer.v", F.lit(0)), F.lit(256)).cast("int").alias("delta"))


def pasted(occupied: DataFrame, objects: DataFrame, candidates: DataFrame, keys: list[str], resolution: int, most: float) -> DataFrame:
    """``(keys, object, candidate, vx, vy, vz)``: each object at the candidate shift that meets fewest occupied voxels; ties to the first.

    A shift that leaves the grid, or meets more than the share ``most`` of the object's voxels, is no place; an object
    without a place isn't pasted.
    """
    at = ["vx", "vy", "vz"]
    moved = objects.join(candidates, keys).select(*keys, "object", "candidate", *((F.col(c) + F.col(f"d{c[1]}")).alias(c) for c in at))
    hit = moved.join(occupied.select(*keys, *at).distinct().withColumn("_hit", F.lit(1)), [*keys, *at], "left")
    inside = F.bool_and(F.least(*at) >= 0) & F.bool_and(F.greatest(*at) < resolution)
    tried = hit.groupBy(*keys, "object", "candidate").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"), inside.alias("inside"))
    best = tried.where(F.col("inside") & (F.col("hits") <= most * F.col("n"))).groupBy(*keys, "object").agg(F.min(F.struct("hits", "candidate")).alias("b"))
    return moved.join(best.select(*keys, "object", F.col("b.candidate").alias("candidate")), [*keys, "object", "candidate"], "left_semi")
