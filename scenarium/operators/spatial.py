"""Spatial joins by grid cells: nearest neighbour, points in boxes, overlapping boxes; and matchings over their pairs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.plans.materialize import materialize

AXES = ("x", "y", "z")
CELL = [f"g{a}" for a in AXES]
#: Targets of a cell that a point is compared with directly, of a leaf of the tree, and levels of the tree, at each of which cells are a quarter as wide.
CROWD, LEAF, DEEPEST = 256, 64, 31


def _cell(size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(size)).cast("long").alias(f"g{a}") for a in AXES]


def _neighbour_cells() -> Column:
    r = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    cells = F.flatten(F.transform(r, lambda i: F.flatten(F.transform(r, lambda j: F.transform(r, lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))
    return F.explode(cells)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda s, x: s + (F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")), AXES, F.lit(0.0)))


def _split_cells(targets: DataFrame, keys: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Cells with the bounds of their targets, a table for each level, and the targets with the cell they are a leaf of.

    From one that holds everything on, cells of more than LEAF targets are split into 64, so that levels are few where targets are few or spread out and
    more only where they crowd.
    """
    most = targets.agg(F.max(F.greatest(*(F.abs(a) for a in AXES)))).first()[0] or 1.0
    levels, leaves, rest = [], [], targets
    for level in range(DEEPEST):
        size = 4.0 ** (math.ceil(math.log(max(most, 1e-12), 4)) - level) * (1 + 1e-9)
        rest = rest.select(*targets.columns, *_cell(size))
        cells = rest.groupBy(*keys, *CELL).agg(F.count("*").alias("held"), *(F.min(a).alias(f"lo{a}") for a in AXES), *(F.max(a).alias(f"hi{a}") for a in AXES))
        cells = materialize(cells.withColumn("leaf", F.lit(level + 1 == DEEPEST) | (F.col("held") <= LEAF)), "cells")
        levels.append(cells)
        placed = rest.join(cells.select(*keys, *CELL, "leaf"), [*keys, *CELL])
        leaves.append(placed.where("leaf").select(*targets.columns, *CELL, F.lit(level).alias("level")))
        rest = materialize(placed.where("not leaf").select(*targets.columns), "crowded")
        if rest.isEmpty():
            break
    return levels, reduce(DataFrame.unionByName, leaves)


def _nearest_by_bounds(queries: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _id, b)`` of queries anywhere: from the coarsest cells down, those are left out whose bounds lie farther than another's farthest corner."""
    levels, leaves = _split_cells(targets, keys)
    off = lambda a: F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0))
    end = lambda a: F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}")))
    norm = lambda part: F.sqrt(reduce(lambda s, a: s + part(a) * part(a), AXES, F.lit(0.0)))
    whole, found, own = W.partitionBy(*keys, "_id"), [], ["_id", *AXES]
    front = queries.select(*keys, *own, F.lit(float("inf")).alias("bound"))
    for level, cells in enumerate(levels):
        if level:
            inside = cells.withColumns({f"p{c}": F.floor(F.col(c) / 4).cast("long") for c in CELL})
            front = front.withColumnsRenamed({c: f"p{c}" for c in CELL}).join(inside, [*keys, *(f"p{c}" for c in CELL)]).drop(*(f"p{c}" for c in CELL))
        else:
            front = front.join(cells, keys)  # eight cells at most
        front = front.withColumn("near", norm(off)).withColumn("bound", F.least("bound", F.min(norm(end)).over(whole)))
        front = materialize(front.where(F.col("near") * (1 - 1e-9) <= F.col("bound")).select(*keys, *own, *CELL, "near", "bound", "leaf"), "front")
        found.append(front.where("leaf").select(*keys, *own, *CELL, "near", F.lit(level).alias("level")).withColumn("bound", F.lit(None).cast("double")))
        bounds = front.groupBy(*keys, "_id").agg(F.min("bound").alias("least"))
        found.append(bounds.select(*keys, "_id", *(F.lit(None).cast("double").alias(a) for a in AXES), *(F.lit(None).cast("long").alias(c) for c in CELL), F.lit(None).cast("double").alias("near"), F.lit(level).alias("level"), F.col("least").alias("bound")))
        front = front.where("not leaf").select(*keys, *own, *CELL, "bound")
    asked = reduce(DataFrame.unionByName, found).withColumn("least", F.min("bound").over(whole)).where("bound is null").where(F.col("near") * (1 - 1e-9) <= F.col("least"))
    there = leaves.select(*keys, *CELL, "level", "nearest_id", *(F.col(a).alias(f"t{a}") for a in AXES))
    pairs = asked.select(*keys, *own, *CELL, "level").join(there, [*keys, *CELL, "level"]).withColumn("distance", _distance("", "t"))
    return pairs.groupBy(*keys, "_id").agg(F.min(F.struct("distance", "nearest_id")).alias("b"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], cell: float, left_id: str = "point_id", right_id: str = "point_id") -> DataFrame:
    """``(keys, left_id, nearest_id, distance)``: the nearest right point of the same keys, ties to the smaller id.

    Where the 27 cells around a point hold no crowd, both sides meet there, and what is found within one cell size is proven nearest. All others, in crowds
    or far from anything, look through a tree of cells that splits where targets crowd: bounds leave a few leaves for each, so that neither
    a dense place nor an outlier meets the whole cloud. Null where there is none, or a coordinate is null or no number.
    """
    somewhere = " and ".join(f"{a} is not null and not isnan({a})" for a in AXES)
    targets = materialize(right.groupBy(*keys, *AXES).agg(F.min(right_id).alias("nearest_id")).where(somewhere), "targets")
    every = left.select(*keys, F.col(left_id).alias("_id"), *AXES)
    asked = materialize(every.where(somewhere), "asked")
    crowds = targets.groupBy(*keys, *_cell(cell)).agg(F.count("*").alias("held"))
    around = asked.select("*", *_cell(cell)).withColumn("n", _neighbour_cells())
    around = around.select(*keys, "_id", *AXES, *((F.col(f"g{a}") + F.col(f"n.{i}")).alias(f"g{a}") for a, i in zip(AXES, "ijk", strict=True)))
    around = around.join(crowds, [*keys, *CELL]).withColumn("most", F.max("held").over(W.partitionBy(*keys, "_id"))).where(F.col("most") <= CROWD)
    there = targets.select(*keys, "nearest_id", *(F.col(a).alias(f"t{a}") for a in AXES), *_cell(cell))
    close = around.join(there, [*keys, *CELL]).withColumn("distance", _distance("", "t")).groupBy(*keys, "_id").agg(F.min(F.struct("distance", "nearest_id")).alias("b"))
    close = materialize(close.where(F.col("b.distance") <= cell), "close")
    far = materialize(asked.join(close.select(*keys, "_id"), [*keys, "_id"], "left_anti"), "far")
    found = close if far.isEmpty() else close.unionByName(materialize(_nearest_by_bounds(far, targets, keys), "found"))
    whole = every.select(*keys, "_id").distinct().join(found, [*keys, "_id"], "left")
    return whole.select(*keys, F.col("_id").alias(left_id), F.col("b.nearest_id").alias("nearest_id"), F.col("b.distance").alias("distance"))


def label_within(found: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """The nearest point's label within ``radius``, else -1."""
    named = labels.select(F.col("point_id").alias("nearest_id"), F.col("label").alias("near_label"))
    near = F.when(F.col("distance") <= radius, F.col("near_label"))
    return found.join(named, "nearest_id", "left").select("point_id", "distance", F.coalesce(near, F.lit(-1)).alias("label"))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], cell: float, reach: float = 0.0) -> DataFrame:
    """Pairs of ``left`` and ``right``, boxes with lo and hi on each axis, among them all whose gap is ``reach`` or less; columns are named a... and b....

    A box has a level, at which cells are as large as the box, and ``cell`` at least. A pair meets in the grid of the larger of its two levels, where
    both touch a few cells however large they are, and there in the first cell that both touch, so that it comes once. Levels are a few dozen at most.
    """
    side = F.greatest(*(F.col(f"hi{x}") - F.col(f"lo{x}") for x in AXES))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-12)) / cell))).cast("int")
    named = lambda rows, n: rows.select(*keys, *(F.col(c).alias(n + c) for c in rows.columns if c not in keys), level.alias(f"{n}level"))
    a, b = named(left, "a"), named(right, "b")
    levels = sorted({r[0] for r in a.select("alevel").distinct().union(b.select("blevel").distinct()).collect()})
    at = lambda c: F.floor(c / (F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level")))).cast("long")

    def dealt(rows: DataFrame, n: str, more: float) -> DataFrame:
        rows = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).where(F.col("level") >= F.col(f"{n}level"))
        for x in AXES:
            rows = rows.withColumn(f"{n}first{x}", at(F.col(f"{n}lo{x}") - more)).withColumn(f"g{x}", F.explode(F.sequence(F.col(f"{n}first{x}"), at(F.col(f"{n}hi{x}") + more))))
        return rows

    met = dealt(a, "a", reach * (1 + 1e-9)).join(dealt(b, "b", 0.0), [*keys, "level", *(f"g{x}" for x in AXES)]).where(F.greatest("alevel", "blevel") == F.col("level"))
    for x in AXES:
        met = met.where(F.col(f"g{x}") == F.greatest(f"afirst{x}", f"bfirst{x}")).where(F.greatest(F.col(f"alo{x}") - F.col(f"bhi{x}"), F.col(f"blo{x}") - F.col(f"ahi{x}")) <= reach)
    return met


def near_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs of points and boxes (upright: c, s) that share a cell, among them all pairs of a box and a point within it.

    A box is dealt to the cells it touches in a grid of half its own size, ``cell`` times a power of two, so that it touches
    27 at most and few points beside it; a point is in one cell of each grid that there is. Grids are a list of a few dozen at most.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*(F.col(f"s{a}") for a in AXES), F.lit(1e-12)) / cell))).cast("int")
    b = boxes.withColumn("_level", level)
    levels = sorted(r[0] for r in b.select("_level").distinct().collect())
    size = F.lit(cell / 2) * F.pow(F.lit(2.0), F.col("_level"))
    for a in AXES:
        low, high = (F.floor((F.col(f"c{a}") + s * F.col(f"s{a}") / 2 * (1 + 1e-8)) / size).cast("long") for s in (-1, 1))
        b = b.withColumn(f"g{a}", F.explode(F.sequence(low, high)))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({f"g{a}": F.floor(F.col(a) / size).cast("long") for a in AXES})
    return p.join(b, [*keys, "_level", *(f"g{a}" for a in AXES)]).drop("_level", *(f"g{a}" for a in AXES))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, by_depth: bool = False, background: int = 0) -> DataFrame:
    """``(point_id, box_id)``: the box that a point is in; of several the most confident, then the one it lies deepest in.

    ``by_depth`` looks at the depth first. Points outside of all boxes get ``background``. Equal boxes are one, of which the best can win, and points at
    one place look together, so that pairs are of distinct places and boxes only. The choice is a minimum, combined before the shuffle.
    """
    kinds = boxes.groupBy(*keys, *(f"{n}{a}" for n in "cs" for a in AXES)).agg(F.min(F.struct((-F.col("confidence")).alias("doubt"), "box_id")).alias("b"))
    near = near_boxes(points.select(*keys, *AXES).distinct(), kinds.select("*", "b.doubt", "b.box_id").drop("b"), keys, cell)
    radius = F.greatest(*(F.abs(F.col(a) - F.col(f"c{a}")) / F.greatest(F.col(f"s{a}") / 2, F.lit(1e-12)) for a in AXES))
    pairs = near.withColumn("radius", radius).where(F.col("radius") <= 1 + 1e-8)
    won = pairs.groupBy(*keys, *AXES).agg(F.min(F.struct(*(("radius", "doubt") if by_depth else ("doubt", "radius")), "box_id")).alias("b"))
    found = points.select("point_id", *keys, *AXES).join(materialize(won, "won"), [*keys, *AXES], "left").select("point_id", "b")
    own = F.when(F.col("point_id").isNotNull(), F.min("b").over(W.partitionBy("point_id")))  # rows of one id have one box
    return found.select("point_id", F.coalesce(own["box_id"], F.lit(background)).alias("box_id"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """``(keys, a, b, iou)`` of upright boxes that share volume; a from left, b from right."""
    ends = lambda rows: rows.select(*keys, "box_id", *(F.col(f"{n}{x}") for n in "cs" for x in AXES), *((F.col(f"c{x}") + s * F.col(f"s{x}") / 2).alias(n + x) for n, s in (("lo", -1), ("hi", 1)) for x in AXES))
    side = lambda x: F.least(f"ahi{x}", f"bhi{x}") - F.greatest(f"alo{x}", f"blo{x}")
    rows = meeting(ends(left), ends(right), keys, cell)
    for x in AXES:
        rows = rows.where(side(x) > 0)
    shared = side("x") * side("y") * side("z")
    volume = lambda n: F.col(f"{n}sx") * F.col(f"{n}sy") * F.col(f"{n}sz")
    return rows.select(*keys, F.col("abox_id").alias("a"), F.col("bbox_id").alias("b"), (shared / (volume("a") + volume("b") - shared)).alias("iou"))


def greedy_matches(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One-to-one matches in descending (iou, a, b): what taking the best free pair again and again gives.

    Each round takes all pairs that are the best one of both their sides; these are the ones that the greedy
    order would take too, as nothing before them touches either side.
    """
    open_, taken = materialize(pairs.where(F.col("iou") >= threshold).select(*keys, "a", "b", "iou"), "pairs"), []
    pair = F.struct("iou", "a", "b")
    while not open_.isEmpty():
        best_a = open_.groupBy(*keys, "a").agg(F.max(pair).alias("m")).select(*keys, "m.*")
        best_b = open_.groupBy(*keys, "b").agg(F.max(pair).alias("m")).select(*keys, F.col("m.a").alias("a"), F.col("m.b").alias("b"))
        chosen = materialize(best_a.join(best_b, [*keys, "a", "b"], "left_semi"), "chosen")
        taken.append(chosen)
        open_ = materialize(open_.join(chosen.select(*keys, "a"), [*keys, "a"], "left_anti").join(chosen.select(*keys, "b"), [*keys, "b"], "left_anti"), "pairs")
    return reduce(DataFrame.unionByName, taken) if taken else open_


def best_of_equal(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` without those that equal a better one of their group: what suppresses the best of equal boxes suppresses all of them, and if it stays they overlap it in full.

    Boxes without volume overlap nothing, and all stay.
    """
    sides = [f"{n}{a}" for n in "cs" for a in AXES]
    solid = reduce(lambda x, a: x & (F.col(f"s{a}") > 0), AXES, F.lit(True))
    best = boxes.where(solid).groupBy(*keys, *sides).agg(F.max_by(F.struct(*boxes.columns), F.struct("confidence", (-F.col("box_id")).alias("n"))).alias("b"))
    return best.select("b.*").unionByName(boxes.where(~F.coalesce(solid, F.lit(False))))


def suppress(boxes: DataFrame, pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Non-maximum suppression: by score, a box stays if it overlaps no kept box above ``threshold``.

    A box whose better overlapping boxes are all gone stays; one that overlaps a kept better box goes; each
    round decides all boxes for which that is known, on all scenes at once.
    """
    score = boxes.select(*keys, "box_id", "confidence")
    links = pairs.where(F.col("iou") > threshold).join(score.select(*keys, F.col("box_id").alias("a"), F.col("confidence").alias("sa")), [*keys, "a"]).join(score.select(*keys, F.col("box_id").alias("b"), F.col("confidence").alias("sb")), [*keys, "b"])
    links = materialize(links.where("sa > sb or (sa = sb and a < b)").select(*keys, "a", "b"), "links")  # a is better
    open_, kept = materialize(score.select(*keys, "box_id"), "open"), []
    while not open_.isEmpty():
        live = links.join(open_.select(*keys, F.col("box_id").alias("a")), [*keys, "a"], "left_semi")
        stay = materialize(open_.join(live.select(*keys, F.col("b").alias("box_id")).distinct(), [*keys, "box_id"], "left_anti"), "stay")
        kept.append(stay)
        go = links.join(stay.select(*keys, F.col("box_id").alias("a")), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("box_id"))
        open_ = materialize(open_.join(stay.union(go).distinct(), [*keys, "box_id"], "left_anti"), "open")
    return reduce(DataFrame.unionByName, kept) if kept else open_


def confident_matches(pairs: DataFrame, predictions: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(key, pred, truth, iou)``: by falling confidence each prediction takes its best free truth; null where under ``threshold``.

    Ties go to the smaller prediction and truth. Each round decides every prediction whose best free truth no open one
    of higher confidence could take; the most confident one of those left always is such a one.
    """
    every = materialize(predictions.select(key, F.col("box_id").alias("pred"), "confidence"), "predictions")
    near = pairs.where(F.col("iou") >= threshold).select(key, F.col("a").alias("pred"), F.col("b").alias("truth"), "iou")
    open_, taken = materialize(near.join(every, [key, "pred"]), "pairs"), []
    while not open_.isEmpty():
        best = open_.groupBy(key, "pred").agg(F.max(F.struct("iou", (-F.col("truth")).alias("t"))).alias("m")).select(key, "pred", (-F.col("m.t")).alias("truth"), "m.iou")
        first = open_.groupBy(key, "truth").agg(F.max(F.struct("confidence", (-F.col("pred")).alias("p"))).alias("m")).select(key, "truth", (-F.col("m.p")).alias("pred"))
        chosen = materialize(best.join(first, [key, "pred", "truth"], "left_semi"), "chosen")
        taken.append(chosen)
        open_ = materialize(open_.join(chosen.select(key, "pred"), [key, "pred"], "left_anti").join(chosen.select(key, "truth"), [key, "truth"], "left_anti"), "pairs")
    found = reduce(DataFrame.unionByName, taken) if taken else open_.select(key, "pred", "truth", "iou")
    return every.select(key, "pred").join(found, [key, "pred"], "left").select(key, "pred", "truth", "iou")


def optimal_assignment(costs: DataFrame, key: str) -> DataFrame:
    """``(key, a, b, cost)``: the assignment of least total cost of each group; missing and NaN pairs cost a million."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="a", columns="b", values="cost", aggfunc="min")
        c = np.nan_to_num(m.to_numpy(float), nan=1e6, posinf=1e6, neginf=-1e6)
        rows = hungarian(c) if c.shape[0] <= c.shape[1] else [(i, j) for j, i in hungarian(c.T)]
        return pd.DataFrame([(pdf[key].iloc[0], m.index[i], m.columns[j], c[i, j]) for i, j in sorted(rows)], columns=[key, "a", "b", "cost"])

    return costs.groupBy(key).applyInPandas(run, f"{key} long, a long, b long, cost double")


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Shortest augmenting paths with potentials; rows at most columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        match[m], j = i, m
        least, via, seen = np.full(m, np.inf), np.full(m, m), np.zeros(m, bool)
        path_seen = [m]
        while match[j] != -1:
            r = match[j]
            reduced = np.where(seen, np.inf, cost[r] - u[r] - v[:m])
            better = reduced < least
            least, via = np.where(better, reduced, least), np.where(better, j, via)
            k = int(np.where(seen, np.inf, least).argmin())
            step = least[k]
            for q in path_seen:
                u[match[q]] += step
                v[q] -= step
            least = np.where(seen, least, least - step)
            seen[k] = True
            path_seen.append(k)
            j = k
        while j != m:
            match[j] = match[via[j]]
            j = int(via[j])
    return [(int(match[j]), j) for j in range(m) if match[j] >= 0]


def farthest_points(points: DataFrame, keys: list[str], k: int, order: str = "point_id") -> DataFrame:
    """Farthest-point sampling within each group from its first point; ``rank`` is the order of choice, ties go to the first in ``order``.

    A round for each choice: every point looks at its group's choices so far, a list of ``k`` at most, and the farthest is an aggregate that is combined
    before the shuffle. No group is gathered, and only choices are written.
    """
    rows = points.select(*keys, order, *AXES)
    spot = F.struct(F.col(order).alias("o"), *AXES)
    picks = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.array(F.min(spot)).alias("_picks")), "picks")
    apart = lambda p: reduce(lambda s, a: s + (F.col(a) - p[a]) * (F.col(a) - p[a]), AXES, F.lit(0.0))
    for n in range(1, k):
        open_ = picks.where(F.col("_n") > n)
        far = rows.join(open_, keys).select(*keys, F.struct((-F.array_min(F.transform("_picks", apart))).alias("d"), spot.alias("p")).alias("f"))
        best = far.groupBy(*keys).agg(F.min("f").alias("f"))
        picks = materialize(picks.join(best, keys, "left").select(*keys, "_n", F.when(F.col("f").isNull(), F.col("_picks")).otherwise(F.array_append("_picks", F.col("f.p"))).alias("_picks")), "picks")
    return picks.select(*keys, F.posexplode("_picks").alias("rank", "p")).select(*keys, F.col("p.o").alias(order), F.col("rank").cast("long").alias("rank"))


def supported_points(points: DataFrame, keys: list[str], k: int, grid: int = 8) -> DataFrame:
    """Points that aren't alone in the 27 cells around theirs, in a grid of ``grid`` cells a side over their group's bounds; all of a group of which fewer than ``k`` (or than it has) would stay."""
    ends = points.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.min(a).alias(f"lo{a}") for a in AXES), *(F.max(a).alias(f"hi{a}") for a in AXES))
    at = lambda a: F.least(F.floor((F.col(a) - F.col(f"lo{a}")) / F.greatest(F.col(f"hi{a}") - F.col(f"lo{a}"), F.lit(1e-6)) * grid), F.lit(grid - 1)).cast("long")
    rows = points.join(ends, keys).withColumns({f"g{a}": at(a) for a in AXES})
    counts = rows.groupBy(*keys, *CELL).agg(F.count("*").alias("c"))
    lent = counts.withColumn("n", _neighbour_cells()).select(*keys, "c", *((F.col(f"g{a}") + F.col(f"n.{i}")).alias(f"g{a}") for a, i in zip(AXES, "ijk", strict=True)))
    support = lent.groupBy(*keys, *CELL).agg(F.sum("c").alias("_support"))
    held = counts.join(support, [*keys, *CELL]).withColumn("_kept", F.col("_support") > 1)
    stays = held.groupBy(*keys).agg(F.sum(F.when(F.col("_kept"), F.col("c")).otherwise(0)).alias("_stay"))
    rows = rows.join(held.select(*keys, *CELL, "_kept"), [*keys, *CELL]).join(stays, keys)
    return rows.where(F.col("_kept") | (F.col("_stay") < F.least(F.col("_n"), F.lit(k)))).select(*points.columns)


def hybrid_points(points: DataFrame, keys: list[str], k: int, seed: str, order: str = "point_id") -> DataFrame:
    """``(keys, order, rank)``: half of ``k`` by farthest points, and of the rest as many as are missing in the order of SHA-256 of seed and name."""
    far = materialize(farthest_points(points, keys, max(1, k // 2), order), "far") if k // 2 else None
    rest = points.select(*keys, order)
    if far is not None:
        rest = rest.join(far.select(*keys, order), [*keys, order], "left_anti").join(far.groupBy(*keys).agg(F.countDistinct(order).alias("_have")), keys)
    else:
        rest = rest.withColumn("_have", F.lit(0))
    drawn = F.row_number().over(W.partitionBy(*keys).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")), 256), order))
    rest = rest.withColumn("_place", drawn).where(F.col("_place") <= k).where(F.col("_place") <= k - F.col("_have"))
    rest = rest.select(*keys, order, (F.col("_have") + F.col("_place") - 1).cast("long").alias("rank"))
    return rest if far is None else far.groupBy(*keys, order).agg(F.min("rank").alias("rank")).unionByName(rest)


def least_loaded(items: DataFrame, key: str, workers: int) -> DataFrame:
    """Longest processing time first: each item of a group goes to the worker with the least load, ties to the lowest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = np.zeros(workers), []
        for ident, weight in pdf.sort_values(["weight", "item"], ascending=[False, True])[["item", "weight"]].itertuples(index=False):
            w = int(load.argmin())
            load[w] += weight
            out.append((pdf[key].iloc[0], ident, w))
        return pd.DataFrame(out, columns=[key, "item", "worker"])

    return items.groupBy(key).applyInPandas(run, items.select(key, "item").withColumn("worker", F.lit(0).cast("long")).schema)


def oriented_iou(pairs: DataFrame) -> DataFrame:
    """Adds ``iou`` of two boxes ``a`` and ``b``: structs of centre c, sides s (arrays of 3) and row-major rotation r (array of 9)."""

    @F.arrow_udf("double")
    def iou(ac: pa.Array, as_: pa.Array, ar: pa.Array, bc: pa.Array, bs: pa.Array, br: pa.Array) -> pa.Array:
        given = [np.asarray(x.flatten()).reshape(-1, w) for x, w in ((ac, 3), (as_, 3), (ar, 9), (bc, 3), (bs, 3), (br, 9))]
        parts = [box_ious(*(x[i : i + 512] for x in given)) for i in range(0, len(ac), 512)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return pairs.withColumn("iou", iou("a.c", "a.s", "a.r", "b.c", "b.s", "b.r"))


def box_iou(ac: np.ndarray, as_: np.ndarray, ar: np.ndarray, bc: np.ndarray, bs: np.ndarray, br: np.ndarray) -> float:
    return float(box_ious(*(np.asarray(x, float).reshape(1, -1) for x in (ac, as_, ar, bc, bs, br)))[0])


def box_ious(ac: np.ndarray, as_: np.ndarray, ar: np.ndarray, bc: np.ndarray, bs: np.ndarray, br: np.ndarray) -> np.ndarray:
    """Intersections over unions of n pairs of boxes, rows of centres, sides and rotations. Boxes that are turned about z share a polygon times a height."""
    va, vb = np.prod(as_, 1), np.prod(bs, 1)
    bs = bs * (1 - 1e-9)
    upright = ((ar[:, [2, 5, 6, 7]] == 0) & (br[:, [2, 5, 6, 7]] == 0)).all(1) & (ar[:, 8] == 1) & (br[:, 8] == 1)
    shared = np.zeros(len(ac))
    for which, volumes in ((upright, _upright_volumes), (~upright, _turned_volumes)):
        shared[which] = volumes(*((c[which], s[which] / 2, r[which].reshape(-1, 3, 3)) for c, s, r in ((ac, as_, ar), (bc, bs, br))))
    shared = np.minimum(np.maximum(shared, 0), np.minimum(va, vb))
    sound = (va > 0) & (vb > 0)
    return np.where(sound, shared / np.where(sound, va + vb - shared, 1), 0.0)


def _upright_volumes(a, b) -> np.ndarray:
    (c, h, r), (oc, oh, o) = a, b
    high = np.minimum(c[:, 2] + h[:, 2], oc[:, 2] + oh[:, 2]) - np.maximum(c[:, 2] - h[:, 2], oc[:, 2] - oh[:, 2])
    corners = np.zeros((len(c), 8, 2))
    corners[:, :4] = (h[:, None, :2] * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])) @ r[:, :2, :2].transpose(0, 2, 1) + c[:, None, :2]
    pair, size = np.arange(len(c)), np.full(len(c), 4)
    for k in range(2):
        for s in (-1, 1):
            to = s * o[pair, :2, k]
            size, corners = _clip(corners, size, to, oh[pair, k] + (to * oc[pair, :2]).sum(1))
            pair, size, corners = pair[size >= 3], size[size >= 3], corners[size >= 3]
    x, y = np.moveaxis(corners - corners[:, :1], 2, 0)
    area = np.where(np.arange(1, 7) + 1 < size[:, None], x[:, 1:-1] * y[:, 2:] - x[:, 2:] * y[:, 1:-1], 0).sum(1) / 2
    return np.bincount(pair, np.abs(area), len(c)) * np.maximum(high, 0)


def _turned_volumes(a, b) -> np.ndarray:
    """By clipping each box's faces with the other and summing cones from an inner point. The faces of all pairs are clipped together, plane by plane."""
    n = len(a[0])
    pair, size, corners, normal = (np.concatenate(x) for x in zip(_clipped_faces(a, b), _clipped_faces(b, a), strict=True))
    there = np.arange(corners.shape[1]) < size[:, None]
    sums = np.stack([np.bincount(pair, np.where(there, corners[:, :, k], 0).sum(1), n) for k in range(3)], 1)
    inner = sums / np.maximum(np.bincount(pair, size, n), 1)[:, None]
    area = np.cross(corners[:, 1:-1] - corners[:, :1], corners[:, 2:] - corners[:, :1])
    area = np.abs((np.where(there[:, 2:, None], area, 0).sum(1) * normal).sum(1)) / 2
    cones = area * ((corners[:, 0] - inner[pair]) * normal).sum(1)
    return np.bincount(pair, cones, n) / 3


def _clipped_faces(box, other) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What of the faces of each box is in the other: the pair, the number of corners, the corners, of which a face has ten at most, and the normal."""
    (c, h, r), (oc, oh, o) = box, other
    n, corners, normals = len(c), [], []
    for axis in range(3):
        p, q = (axis + 1) % 3, (axis + 2) % 3
        for side in (-1, 1):
            local = np.zeros((n, 10, 3))
            local[:, :4, axis] = side * h[:, axis, None]
            local[:, :4, p], local[:, :4, q] = h[:, p, None] * np.array([-1, 1, 1, -1]), h[:, q, None] * np.array([-1, -1, 1, 1])
            corners.append(local @ r.transpose(0, 2, 1) + c[:, None])
            normals.append(side * r[:, :, axis])
    pair, size, corners, normal = np.tile(np.arange(n), 6), np.full(6 * n, 4), np.concatenate(corners), np.concatenate(normals)
    for k in range(3):
        for s in (-1, 1):
            to = s * o[pair, :, k]
            size, corners = _clip(corners, size, to, oh[pair, k] + (to * oc[pair]).sum(1))
            left = size >= 3
            pair, size, corners, normal = pair[left], size[left], corners[left], normal[left]
    return pair, size, corners, normal


def _clip(corners: np.ndarray, size: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons, each of ``size`` corners, on the inner side of a plane each."""
    m = corners.shape[1]
    at = np.arange(m)
    there, after = at < size[:, None], np.where(at + 1 < size[:, None], at + 1, 0)
    d = np.einsum("nmk,nk->nm", corners, normal) - offset[:, None]
    e = np.take_along_axis(d, after, 1)
    emit = np.zeros((len(corners), 2 * m), bool)  # each corner, and after it where the plane cuts its side
    emit[:, ::2], emit[:, 1::2] = there & (d <= 0), there & (((d < 0) & (e > 0)) | ((d > 0) & (e < 0)))
    to = np.cumsum(emit, 1) - 1
    out = np.zeros_like(corners)
    i, j = np.nonzero(emit[:, ::2])
    out[i, to[i, 2 * j]] = corners[i, j]
    i, j = np.nonzero(emit[:, 1::2])
    out[i, to[i, 2 * j + 1]] = corners[i, j] + (corners[i, after[i, j]] - corners[i, j]) * (d[i, j] / (d[i, j] - e[i, j]))[:, None]
    return to[:, -1] + 1, out


def box_coverage(points: DataFrame, boxes: DataFrame, keys: list[str], instance: str, cell: float, least: int) -> DataFrame:
    """How well boxes hold the instances of ``least`` points or more: recall of their centres and of 10 % and 50 % of their points by one box, mean best share, and the boxes' mean share of their commonest instance."""
    sides = [f"{n}{a}" for n in "cs" for a in AXES]
    kinds = materialize(boxes.groupBy(*keys, *sides).agg(F.count("*").alias("_boxes"), F.min("box_id").alias("box_id")), "kinds")
    own = points.groupBy(*keys, instance).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in AXES)).where(F.col("n") >= least)
    held = materialize(held_points(points, kinds, keys, instance, cell), "held")
    best = held.groupBy(*keys, instance).agg(F.max("k").alias("k"))
    centred = _within(own.select(*keys, instance, *AXES), kinds, keys, cell).select(*keys, instance, F.lit(1).alias("hit")).distinct()
    rows = own.join(best, [*keys, instance], "left").join(centred, [*keys, instance], "left").withColumn("share", F.coalesce("k", F.lit(0)) / F.col("n"))
    out = rows.groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("centre_recall"), *(F.avg((F.coalesce("k", F.lit(0)) >= s * F.col("n")).cast("int")).alias(n) for n, s in (("recall10", 0.1), ("recall50", 0.5))), F.avg("share").alias("best"))
    pure = held.groupBy(*keys, "box_id").agg((F.max("k") / F.sum("k")).alias("purity"))
    pure = kinds.select(*keys, "box_id", "_boxes").join(pure, [*keys, "box_id"], "left").groupBy(*keys).agg((F.sum(F.coalesce("purity", F.lit(0.0)) * F.col("_boxes")) / F.sum("_boxes")).alias("purity"))
    return out.join(pure, keys)


def _within(rows: DataFrame, boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    pairs = near_boxes(rows, boxes, keys, cell)
    for a in AXES:
        pairs = pairs.where(F.abs(F.col(a) - F.col(f"c{a}")) <= F.col(f"s{a}") / 2)
    return pairs


def held_points(points: DataFrame, boxes: DataFrame, keys: list[str], instance: str, cell: float) -> DataFrame:
    """``(keys, instance, box_id, k)``: how many points of an instance a box holds; boxes that hold none of it are left out.

    Points at one place look together; give equal boxes once, as all of them hold the same.
    """
    spots = materialize(points.groupBy(*keys, instance, *AXES).agg(F.count("*").alias("_times")), "spots")
    pairs = _within(spots.select(*keys, *AXES).distinct(), boxes, keys, cell).select(*keys, *AXES, "box_id")
    return spots.join(pairs, [*keys, *AXES]).groupBy(*keys, instance, "box_id").agg(F.sum("_times").alias("k"))
