"""Images as pixel relations: world points, downsampling, and fidelity of one image to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.functions.semantics import cross, norm


def world_points(pixels: DataFrame, eye: list[Column], look_at: list[Column], up: list[Column], fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Masked pixels with a depth in world coordinates ``x, y, z``, by a camera that looks from ``eye`` to ``look_at``; image rows run downwards."""
    unit = lambda v: [c / (norm(v) + 1e-12) for c in v]
    forward = unit([a - b for a, b in zip(look_at, eye, strict=True)])
    right = unit(cross(forward, unit(up)))
    above = unit(cross(right, forward))
    rows = pixels.where(F.col("mask") & F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") > 0) & (F.col("depth") < float("inf")))
    side, rise = (F.col("u") - cx) * F.col("depth") / fx, -(F.col("v") - cy) * F.col("depth") / fy
    return rows.withColumns({a: e + side * r + rise * o + F.col("depth") * f for a, e, r, o, f in zip("xyz", eye, right, above, forward, strict=True)})


def downsampled(pixels: DataFrame, keys: list[str], factor: int, height: int, width: int, smooth: list[str], strided: list[str]) -> DataFrame:
    """Images reduced by ``factor``: ``smooth`` columns bilinear about the middle of each block, ``strided`` ones from its corner.

    An odd factor has a pixel in the middle, an even one the mean of four; pixels that aren't there don't count.
    """
    if factor < 1:
        raise ValueError("the factor must be positive")
    low, high = (factor - 1) // 2, factor // 2
    whole = pixels.where((F.col("v") < height // factor * factor) & (F.col("u") < width // factor * factor))
    middle = (F.col("v") % factor).between(low, high) & (F.col("u") % factor).between(low, high)
    corner = (F.col("v") % factor == 0) & (F.col("u") % factor == 0)
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in "vu"]
    return whole.groupBy(*keys, *block).agg(*(F.avg(F.when(middle, F.col(c))).alias(c) for c in smooth), *(F.max(F.when(corner, F.col(c))).alias(c) for c in strided))


def psnr(error: Column) -> Column:
    """Of a mean squared error, for values from 0 to 1."""
    return -10 * F.log10(F.greatest(error, F.lit(1e-12)))


def image_metrics(images: DataFrame, keys: list[str], padding: int = 4) -> DataFrame:
    """L1, RMSE and PSNR of ``pred`` to ``truth`` over the image, the crop around both masks, their intersection and the true one; their IoU and coverages.

    An image without masks is its own crop; a metric over no pixels is null.
    """
    either, both = F.col("pred_mask") | F.col("truth_mask"), F.col("pred_mask") & F.col("truth_mask")
    bounds = images.groupBy(*keys).agg(*(f(F.when(either, F.col(c))).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "vu"))
    inside = F.lit(True)
    for c in "vu":
        inside = inside & (F.col(f"low_{c}").isNull() | F.col(c).between(F.col(f"low_{c}") - padding, F.col(f"high_{c}") + padding))
    d = F.col("pred") - F.col("truth")
    rows = images.join(bounds, keys).withColumns({"d2": d * d, "crop": inside})
    over = lambda on: F.avg(F.when(on, F.col("d2")))
    out = rows.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("l1"), F.sqrt(F.avg("d2")).alias("rmse"), psnr(F.avg("d2")).alias("full_psnr"), psnr(over(F.col("crop"))).alias("crop_psnr"),
        psnr(over(both)).alias("intersection_psnr"), psnr(over(F.col("truth_mask"))).alias("foreground_psnr"),
        (F.count_if(both) / F.greatest(F.count_if(either), F.lit(1))).alias("mask_iou"), F.avg(F.col("truth_mask").cast("int")).alias("truth_coverage"), F.avg(F.col("pred_mask").cast("int")).alias("pred_coverage"),
    )
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)) for c in ("crop_psnr", "intersection_psnr", "foreground_psnr")})


def structural_similarity(images: DataFrame, keys: list[str], height: int, width: int, window: int = 7) -> DataFrame:
    """Mean SSIM of ``pred`` and ``truth`` over all whole windows; images are complete grids, values from 0 to 1.

    A window's sums are sums along rows, then along columns: two windows of the relation, no neighbours are listed.
    """
    half, n = window // 2, window * window
    values = {"p": F.col("pred"), "t": F.col("truth"), "pp": F.col("pred") * F.col("pred"), "tt": F.col("truth") * F.col("truth"), "pt": F.col("pred") * F.col("truth")}
    along, down = W.partitionBy(*keys, "v").orderBy("u").rangeBetween(-half, half), W.partitionBy(*keys, "u").orderBy("v").rangeBetween(-half, half)
    rows = images.select(*keys, "v", "u", *(x.alias(c) for c, x in values.items()))
    rows = rows.withColumns({c: F.sum(c).over(along) for c in values})
    rows = rows.withColumns({c: F.sum(c).over(down) / n for c in values})
    rows = rows.where(F.col("u").between(half, width - 1 - half) & F.col("v").between(half, height - 1 - half))
    sample = n / (n - 1)
    p, t = F.col("p"), F.col("t")
    cov = lambda a, b, c: sample * (F.col(a) - b * c)
    c1, c2 = 0.01**2, 0.03**2
    s = (2 * p * t + c1) * (2 * cov("pt", p, t) + c2) / ((p * p + t * t + c1) * (cov("pp", p, p) + cov("tt", t, t) + c2))
    return rows.groupBy(*keys).agg(F.avg(s).alias("ssim"))
