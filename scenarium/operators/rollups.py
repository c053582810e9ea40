"""Metric roll-ups over records, each with its own rule for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.functions.semantics import finite, safe_div
from scenarium.operators.quantiles import quantiles, with_quantiles


def scalar_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation and median of the finite values."""
    v = finite(F.col(value).cast("double"))
    sums = rows.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return with_quantiles(sums, rows, keys, {"median": v}, [0.5]).withColumn("median", F.col("median")[0])


def coverage_rollup(expected: DataFrame, records: DataFrame, scene: str, status: str, value: str, done: str = "evaluated") -> DataFrame:
    """Per expected scene: records, evaluated ones, coverage (1 without records), mean, and mean with missing as zero."""
    ok = F.col(status) == done
    per = records.groupBy(scene).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_done"), F.avg(F.when(ok, F.col(value))).alias("mean"), F.avg(F.when(ok, F.col(value)).otherwise(0.0)).alias("zero_mean"))
    rows = expected.select(scene).distinct().join(per, scene, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_done": F.coalesce("n_done", F.lit(0))})
    return rows.withColumn("coverage", safe_div(F.col("n_done"), F.col("n"), 1.0))


def benchmark_summary(scenes: DataFrame, value: str = "mean") -> DataFrame:
    """One row: object micro and scene macro means; ``primary`` is the macro mean if everything was evaluated, else null."""
    total = scenes.agg(
        F.sum("n").alias("n_objects"), F.sum("n_done").alias("n_done"), F.count("*").alias("n_scenes"),
        F.sum(F.col(value) * F.col("n_done")).alias("s"), F.avg(value).alias("macro"), F.avg("zero_mean").alias("zero_macro"),
    )
    out = total.withColumn("micro", safe_div(F.col("s"), F.col("n_done"), None))
    return out.select("n_scenes", "n_objects", "n_done", "micro", "macro", "zero_macro", F.when(F.col("n_objects") == F.col("n_done"), F.col("macro")).alias("primary"))


def two_level_mean(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over the inner groups' means of finite values."""
    v = finite(F.col(value).cast("double"))
    return rows.groupBy(*outer, *inner).agg(F.avg(v).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count("_m").alias("n"))


def detection_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and Jaccard index of rows with tp, fp and fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn), "jaccard": safe_div(tp, tp + fp + fn)})
    return out.withColumn("comprehensive", (F.col("precision") + F.col("recall") + F.col("f1") + F.col("jaccard")) / 4)


def class_iou(pairs: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """Intersection over union of each class from one confusion count; label -1 is no class, unseen classes don't appear."""
    cells = pairs.groupBy(*keys, pred, truth).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col(pred).alias("c"), F.lit(0).alias("t")), F.struct(F.col(truth).alias("c"), F.lit(1).alias("t")))
    rows = cells.withColumn("s", F.explode(sides)).where("s.c <> -1")
    sums = rows.groupBy(*keys, F.col("s.c").alias("class")).agg(F.sum(F.when((F.col("s.t") == 1) & (F.col(pred) == F.col(truth)), F.col("n")).otherwise(0)).alias("intersection"), F.sum("n").alias("both"))
    union = F.col("both") - F.col("intersection")
    return sums.select(*keys, "class", "intersection", union.alias("union"), (F.col("intersection") / union).alias("iou"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    v = finite(F.col(value).cast("double"))
    w = F.when(v.isNotNull(), F.col(weight))
    return rows.groupBy(*keys).agg(F.sum(v * w).alias("_s"), F.sum(w).alias("_w")).select(*keys, safe_div(F.col("_s"), F.col("_w"), None).alias("mean"))


def directional_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    out = with_quantiles(sums, rows, keys, {"p": value}, [0.5, 0.9, 0.95, 0.99])
    return out.select(*keys, "mean", *(F.col("p")[i].alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))), "max")


def robust_extent(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median centre, 95th percentile of the distance to it on each axis, and twice the largest of these."""
    mid = quantiles(points, keys, {f"c{c}": c for c in "xyz"}, [0.5]).select(*keys, *(F.col(f"c{c}")[0].alias(f"c{c}") for c in "xyz"))
    far = {f"h{c}": F.abs(F.col(c) - F.col(f"c{c}")) for c in "xyz"}
    half = with_quantiles(mid, points.join(mid, keys), keys, far, [0.95]).withColumns({h: F.col(h)[0] for h in far})
    return half.withColumn("extent", 2 * F.greatest("hx", "hy", "hz"))


def enclosing_rectangle(points: DataFrame, keys: list[str], yaws: int = 180, trim: float = 0.01) -> DataFrame:
    """Yaw in [0, 90) degrees of the least trimmed rectangle in the plane (ties: smaller yaw), its area and sides."""
    places = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("times"))  # equal points turn together
    turned = places.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(yaws - 1)))).withColumn("a", F.radians(F.col("step") * F.lit(90.0 / yaws)))
    turned = turned.select(*keys, "step", "times", (F.cos("a") * F.col("x") + F.sin("a") * F.col("y")).alias("u"), (F.cos("a") * F.col("y") - F.sin("a") * F.col("x")).alias("v"))
    sides = quantiles(turned, [*keys, "step"], {"u": "u", "v": "v"}, [trim, 1 - trim], "times")
    sides = sides.select(*keys, "step", (F.col("u")[1] - F.col("u")[0]).alias("w"), (F.col("v")[1] - F.col("v")[0]).alias("h"))
    best = F.min(F.struct(F.round(F.col("w") * F.col("h"), 9).alias("area"), "step", "w", "h"))
    return sides.groupBy(*keys).agg(best.alias("b")).select(*keys, (F.col("b.step") * F.lit(90.0 / yaws)).alias("yaw"), "b.area", "b.w", "b.h")


def mean_iou(pairs: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """Mean class IoU over the classes that occur on either side, over those that both sides have, and over all true ones; without any, null."""
    scores = class_iou(pairs, keys, pred, truth)
    true_ = pairs.where(F.col(truth) != -1).select(*keys, F.col(truth).alias("class"), F.lit(True).alias("_true")).distinct()
    rows = scores.join(true_, [*keys, "class"], "left")
    met = F.col("intersection") > 0
    return rows.groupBy(*keys).agg(F.avg("iou").alias("mean_iou"), F.avg(F.when(met, F.col("iou"))).alias("matched_iou"), F.avg(F.when(F.col("_true"), F.col("iou"))).alias("all_true_iou"), F.count("*").alias("classes"))


def oriented_box(points: DataFrame, keys: list[str], trim: float, margin: float) -> DataFrame:
    """An upright box: median centre, the principal direction in the plane as yaw, trimmed extents along it, and their largest with a margin as scale."""
    mid = quantiles(points, keys, {"mx": "x", "my": "y"}, [0.5]).select(*keys, F.col("mx")[0].alias("mx"), F.col("my")[0].alias("my"))
    rows = points.join(mid, keys).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    spread = rows.groupBy(*keys).agg(F.avg(F.col("dx") * F.col("dx")).alias("a"), F.avg(F.col("dy") * F.col("dy")).alias("b"), F.avg(F.col("dx") * F.col("dy")).alias("c"))
    rows = rows.join(spread.select(*keys, (0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("yaw")), keys)
    along, across = F.cos("yaw") * F.col("dx") + F.sin("yaw") * F.col("dy"), F.cos("yaw") * F.col("dy") - F.sin("yaw") * F.col("dx")
    turns = rows.groupBy(*keys).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("yaw").alias("yaw"))  # the same in all rows of a group
    q = with_quantiles(turns, rows, keys, {"u": along, "v": across, "w": "z"}, [trim, 1 - trim])
    middle, length = (lambda c: (F.col(c)[0] + F.col(c)[1]) / 2), (lambda c: F.col(c)[1] - F.col(c)[0])
    out = q.withColumns({"cx": F.col("mx") + F.cos("yaw") * middle("u") - F.sin("yaw") * middle("v"), "cy": F.col("my") + F.sin("yaw") * middle("u") + F.cos("yaw") * middle("v"), "cz": middle("w")})
    return out.select(*keys, "cx", "cy", "cz", "yaw", F.greatest(F.greatest(length("u"), length("v"), length("w")) * margin, F.lit(1e-4)).alias("scale"))


def alignment_vote(segments: DataFrame, keys: list[str], step: float = 0.05, tolerance: float = 5.0, shortest: float = 0.3) -> DataFrame:
    """The turn, in degrees from -45 to 45, that lays most segments along an axis; ties by their length, then the smaller turn.

    Segments have ``angle`` (degrees) and ``length``; those shorter than ``shortest`` vote only where there are no others.
    The best turn of a grid is refined by the weighted mean residual of the segments that it aligns.
    """
    longest = segments.groupBy(*keys).agg(F.max("length").alias("_most"))
    rows = segments.join(longest, keys).where((F.col("length") >= shortest) | ((F.col("_most") < shortest) & (F.col("length") > 0)))
    rows = rows.select(*keys, F.pmod(F.col("angle"), F.lit(90.0)).alias("angle"), "length")
    turned = lambda by: F.pmod(F.col("angle") + by, F.lit(90.0))
    near = lambda by: F.least(turned(by), 90.0 - turned(by)) <= tolerance
    tried = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(round(90 / step) - 1)))).withColumn("by", F.col("k") * step)
    votes = tried.groupBy(*keys, "k").agg(F.count_if(near(F.col("by"))).alias("n"), F.round(F.sum(F.when(near(F.col("by")), F.col("length")).otherwise(0.0)), 6).alias("len"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("n", "len", (-F.col("k")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m") * step).alias("by"))
    signed = F.when(turned(F.col("by")) > 45.0, turned(F.col("by")) - 90.0).otherwise(turned(F.col("by")))
    kept = rows.join(best, keys).where(near(F.col("by")))
    out = kept.groupBy(*keys, "by").agg((F.sum(signed * F.col("length")) / F.sum("length")).alias("off"), F.count("*").alias("aligned"))
    return out.select(*keys, (F.pmod(F.col("by") - F.col("off") + 45.0, F.lit(90.0)) - 45.0).alias("turn"), "aligned")


def surface_classes(points: DataFrame, keys: list[str], wall: float, flat: float, band: float = 0.1) -> DataFrame:
    """Which points, with unit normals, are of walls, level surfaces, the floor or the ceiling; these lie at the 1st and 99th percentile of height."""
    height = quantiles(points, keys, {"h": "z"}, [0.01, 0.99]).select(*keys, F.col("h")[0].alias("floor_z"), F.col("h")[1].alias("ceiling_z"))
    valid = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz") > 0.25
    level = valid & (F.abs("nz") >= flat)
    return points.join(height, keys).withColumns({"is_vertical": valid & (F.abs("nz") <= wall), "is_horizontal": level, "is_floor": level & (F.col("z") <= F.col("floor_z") + band), "is_ceiling": level & (F.col("z") >= F.col("ceiling_z") - band)})


def similarity_fits(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Scale, rotation (row-major) and shift that lay ``x, y, z`` onto ``u, v, w`` best, and the root mean square ``residual``.

    Means and products are sums over the pairs; only these, one row a group, meet Python for a 3 x 3 decomposition.
    """
    import numpy as np
    import pandas as pd

    a, b = "xyz", "uvw"
    mean = pairs.groupBy(*keys).agg(*(F.avg(c).alias(f"m{c}") for c in a + b))
    d = pairs.join(mean, keys).select(*keys, *((F.col(c) - F.col(f"m{c}")).alias(c) for c in a + b))
    sums = d.groupBy(*keys).agg(*(F.avg(F.col(q) * F.col(p)).alias(f"c{q}{p}") for q in b for p in a), sum((F.avg(F.col(p) * F.col(p)) for p in a), F.lit(0.0)).alias("spread")).join(mean, keys)
    out = [*keys, "scale", *(f"r{i}{j}" for i in range(3) for j in range(3)), "tx", "ty", "tz"]

    def run(batches):
        for pdf in batches:
            c = pdf[[f"c{q}{p}" for q in b for p in a]].to_numpy(float).reshape(-1, 3, 3)
            u, s, vt = np.linalg.svd(c)
            s[:, 2] *= (flip := np.sign(np.linalg.det(u @ vt)))
            u[:, :, 2] *= flip[:, None]
            r = u @ vt
            scale = s.sum(1) / np.maximum(pdf["spread"].to_numpy(), 1e-12)
            shift = pdf[[f"m{q}" for q in b]].to_numpy() - scale[:, None] * (r @ pdf[[f"m{p}" for p in a]].to_numpy()[:, :, None])[:, :, 0]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(np.concatenate([scale[:, None], r.reshape(-1, 9), shift], 1), columns=out[len(keys) :])], axis=1)

    fits = sums.mapInPandas(run, mean.select(*keys, *(F.lit(0.0).alias(c) for c in out[len(keys) :])).schema)
    off = [F.col("scale") * sum((F.col(f"r{i}{j}") * F.col(p) for j, p in enumerate(a)), F.lit(0.0)) + F.col(f"t{a[i]}") - F.col(q) for i, q in enumerate(b)]
    left = pairs.join(fits, keys).groupBy(*keys).agg(F.sqrt(F.avg(sum((o * o for o in off), F.lit(0.0)))).alias("residual"))
    return fits.join(left, keys)


def pull_and_push(points: DataFrame, key: str, label: str, near: float, apart: float) -> DataFrame:
    """Per scene: how far points lie beyond ``near`` of their segment's centroid, averaged over segments, and how much centroids fall short of twice ``apart``, over pairs.

    Only pairs nearer than that add anything; they meet in grid cells of its size, all others only count.
    """
    centre = points.groupBy(key, label).agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    gap = lambda p, q: F.sqrt(sum(((F.col(p.format(a)) - F.col(q.format(a))) ** 2 for a in "xyz"), F.lit(0.0)))
    pull = points.join(centre, [key, label]).groupBy(key, label).agg(F.avg(F.greatest(gap("{}", "m{}") - near, F.lit(0.0))).alias("p")).groupBy(key).agg(F.avg("p").alias("pull"))
    cells = [f"g{a}" for a in "xyz"]
    placed = centre.withColumns({f"g{a}": F.floor(F.col(f"m{a}") / (2 * apart)) for a in "xyz"})
    steps = F.sequence(F.lit(-1), F.lit(1))
    other = placed.select(key, F.col(label).alias("_other"), *(F.col(f"m{a}").alias(f"o{a}") for a in "xyz"), *cells)
    for c in cells:
        other = other.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    close = placed.join(other, [key, *cells]).where(F.col(label) < F.col("_other"))
    short = close.groupBy(key).agg(F.sum(F.greatest(2 * apart - gap("m{}", "o{}"), F.lit(0.0))).alias("short"))
    pairs = centre.groupBy(key).agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs")).where("pairs > 0")
    push = pairs.join(short, key, "left").select(key, (F.coalesce("short", F.lit(0.0)) / F.col("pairs")).alias("push"))
    return pull.join(push, key)


def dice_costs(predicted: DataFrame, truth: DataFrame, keys: list[str], item: str, pred: str, label: str, p: str, eps: float = 1.0) -> DataFrame:
    """``(keys, pred, label, shared, cost)``: 1 less the soft Dice score of each predicted mask and true label that share an item.

    ``predicted`` has a probability for items of a mask, ``truth`` a label for an item, -1 for none. A pair that shares nothing isn't listed: its cost follows
    from the areas alone. Shared mass and areas are sums that are combined before the shuffle.
    """
    areas = predicted.groupBy(*keys, pred).agg(F.sum(p).alias("_pred"))
    sizes = truth.where(F.col(label) != -1).groupBy(*keys, label).agg(F.count("*").alias("_true"))
    both = predicted.join(truth.where(F.col(label) != -1), [*keys, item]).groupBy(*keys, pred, label).agg(F.sum(p).alias("shared"))
    rows = both.where(F.col("shared") > 0).join(areas, [*keys, pred]).join(sizes, [*keys, label])
    return rows.select(*keys, pred, label, "shared", (1 - (2 * F.col("shared") + eps) / (F.col("_pred") + F.col("_true") + eps)).alias("cost"))


def scene_balanced_mean(losses: DataFrame, scene: str, value: str, valid: str) -> DataFrame:
    """One row: the mean over scenes of the mean over their valid objects; scenes without any don't count, 0 without any scene."""
    per = losses.where(F.col(valid)).groupBy(scene).agg(F.avg(value).alias("_m"))
    return per.agg(F.coalesce(F.avg("_m"), F.lit(0.0)).alias("mean"), F.count("*").alias("scenes"))
