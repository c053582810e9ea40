"""Frames of pixels to points: validity, unprojection, patch means, lattices and normals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.functions.semantics import cross, norm
from scenarium.operators.quantiles import quantiles


def valid_depth(depth: Column, limit: float = 50.0) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & (depth > 0) & (depth <= limit)


def gated_depth(depth: Column, confidence: Column, least: float) -> Column:
    """Depth where it is usable and trusted, else null; a confidence outside [0, 1] is an error."""
    sound = F.when(confidence.between(0, 1) | F.isnan(confidence) | confidence.isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("confidence outside [0, 1]")).cast("boolean"))
    return F.when(sound & ~F.isnan(confidence) & (confidence >= least) & valid_depth(depth, 1e5), depth)


def fill_nearest(pixels: DataFrame, keys: list[str], limit: float = 50.0) -> DataFrame:
    """Invalid depths take that of the nearest valid pixel of the frame (ties: upper, then left); 0 in a frame without any.

    Rows and columns are propagated in windows: the nearest valid pixel of each row first, then the best row.
    The grid of a frame's rows and columns is completed for that, so that missing pixels don't matter.
    """
    seen = pixels.withColumn("_d", F.when(valid_depth(F.col("depth"), limit), F.col("depth"))).withColumn("_there", F.lit(True))
    grid = pixels.select(*keys, "v").distinct().join(pixels.select(*keys, "u").distinct(), keys)
    p = grid.join(seen, [*keys, "v", "u"], "left")
    row = W.partitionBy(*keys, "v")
    near = lambda order: F.last(F.when(F.col("_d").isNotNull(), F.struct("u", "_d")), True).over(row.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_l", near(F.asc("u"))).withColumn("_r", near(F.desc("u")))
    own = F.array_min(F.filter(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.u") - F.col("u")).alias("dx"), F.col(f"{s}.u").alias("at"), F.col(f"{s}._d").alias("d"))) for s in ("_l", "_r"))), lambda x: x.isNotNull()))
    p = p.withColumn("_own", own)
    holes = p.where("_d is null and _there").select(*keys, "v", "u")
    lines = p.where("_own is not null").select(*keys, "u", F.col("v").alias("_v"), "_own")
    d2 = (F.col("_v") - F.col("v")) * (F.col("_v") - F.col("v")) + F.col("_own.dx") * F.col("_own.dx")
    best = holes.join(lines, [*keys, "u"]).groupBy(*keys, "v", "u").agg(F.min(F.struct(d2.alias("d2"), F.col("_v"), F.col("_own.at"), F.col("_own.d").alias("d"))).alias("_b"))
    out = p.where("_there").join(best, [*keys, "v", "u"], "left")
    return out.select(*[c for c in pixels.columns if c != "depth"], F.coalesce("_d", "_b.d", F.lit(0.0)).alias("depth"))


def unproject(pixels: DataFrame, step: int, width: int, height: int, fx: float, fy: float, cx: float, cy: float, centred: bool = False) -> DataFrame:
    """Camera points of every ``step``-th pixel; the ray goes through the middle of the patch.

    Depth is read at the patch's corner, or at its middle if ``centred``.
    """
    at = step // 2 if centred else 0
    rows = pixels.where((F.col("u") % step == at) & (F.col("v") % step == at) & (F.col("u") < step * (width // step)) & (F.col("v") < step * (height // step)))
    ray = lambda c, o, f: (F.floor(F.col(c) / step) * step + step // 2 - F.lit(o)) / F.lit(f) * F.col("depth")
    return rows.withColumns({"x": ray("u", cx, fx), "y": ray("v", cy, fy), "z": F.col("depth")})


def patch_mean(pixels: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Mean depth of the valid pixels of each patch, null where there is none."""
    patch = [F.floor(F.col(c) / step).cast("long").alias(f"p{c}") for c in "vu"]
    return pixels.groupBy(*keys, *patch).agg(F.avg(F.when(valid_depth(F.col("depth"), 1000.0), F.col("depth"))).alias("depth"))


def proportional_depth(pixels: DataFrame, keys: list[str], value: str = "p", infinite: bool = False) -> DataFrame:
    """1 / abs(p) over its frame's median of finite values; with ``infinite`` of all values, as in SQL, where the inverse of 0 is one of them."""
    inverse = F.when(F.col(value) != 0, 1 / F.abs(F.col(value)))
    if infinite:
        inverse = F.when(F.col(value) == 0, float("inf")).otherwise(inverse)
    mid = quantiles(pixels, keys, {"_m": inverse}, [0.5], infinite=infinite).withColumn("_m", F.col("_m")[0])
    share = inverse / F.col("_m")
    if infinite:
        share = F.when((F.col("_m") != 0) | inverse.isNull(), share).when(inverse > 0, inverse * float("inf")).otherwise(float("nan"))
    return pixels.join(mid, keys).withColumn("depth", share).drop("_m")


def lattice_normals(points: DataFrame, keys: list[str]) -> DataFrame:
    """Unit normals from central differences along rows and columns; zero at the border and where undefined."""
    along, down = W.partitionBy(*keys, "v").orderBy("u"), W.partitionBy(*keys, "u").orderBy("v")
    diff = lambda w: [F.lead(c).over(w) - F.lag(c).over(w) for c in "xyz"]
    n = cross(diff(along), diff(down))
    rows = points.withColumns({f"n{c}": v for c, v in zip("xyz", n, strict=True)})
    length = norm([F.col(f"n{c}") for c in "xyz"])
    return rows.withColumns({f"n{c}": F.coalesce(F.when(length > 0, F.col(f"n{c}") / length), F.lit(0.0)) for c in "xyz"})


def instance_of_scores(scores: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Each point's best mask among those whose validity passes ``least``; ties to the lowest mask."""
    passing = scores.where(1 / (1 + F.exp(-F.col("logit"))) > least)
    best = F.max(F.struct(F.col("score"), (-F.col("mask")).alias("n")))
    return passing.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.n")).alias("mask"))


def odd_crossings(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``inside`` by the parity of the edges that a ray along x crosses; edges as (x0, y0, x1, y1) of the same keys."""
    rows = points.join(edges, keys, "left")
    spans = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    at = F.when(spans, (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return rows.groupBy(*keys, "point_id").agg((F.count_if(F.col("x") < at) % 2 == 1).alias("inside"))


def fourier(value: Column, bands: int) -> Column:
    """sin and cos of value * 2**k * pi, band after band."""
    return F.array(*reduce(lambda a, k: [*a, F.sin(value * (2.0**k) * F.pi()), F.cos(value * (2.0**k) * F.pi())], range(bands), []))
