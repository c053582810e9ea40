"""Merkle manifest of a dataset: lag and lead windows give siblings and parents, level by level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.operators.ranking import numbered
from scenarium.plans.materialize import materialize

#: Leaves, about, whose levels are computed in one window partition; their tops are the leaves of the next stage.
TILE = 256


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value: no two rows of values give the same text."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _stage(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (g, pos, of, node) with ``path``, the siblings on the next ``levels`` levels, and ``up``, at the first of each tile what remains of it.

    A level's nodes are the rows at multiples of its stride, so that siblings lie at fixed offsets in the window; slot and
    run length mask those of other runs. First children hash parents. Levels at which a group has one node left do nothing.
    """
    tile = W.partitionBy("g", "tile").orderBy("pos")
    rows, names = nodes.withColumn("tile", F.floor(F.col("pos") / fanout**levels)).withColumn("up", F.col("node")), []
    for n in range(levels):
        stride = fanout**n
        i, count = F.floor(F.col("pos") / stride), F.ceil(F.col("of") / stride)
        slot = F.pmod(i, F.lit(fanout))
        run = F.least(F.lit(fanout).cast("long"), count - (i - slot))
        left = [F.when(slot >= k, F.lag("up", k * stride).over(tile)).otherwise("") for k in range(fanout - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("up", k * stride).over(tile)).otherwise("") for k in range(1, fanout)]
        is_node = (F.col("pos") % stride == 0) & (count > 1)
        rows = rows.withColumn(f"s{n}", F.when(is_node, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        parent = F.when(is_node & (slot == 0), F.sha2(F.concat("up", f"s{n}.right"), 256))
        rows = rows.withColumn("up", F.when(count > 1, parent).otherwise(F.col("up")))
        names.append(f"s{n}")
    so_far = tile.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = [F.last(name, ignorenulls=True).over(so_far).alias(name) for name in names]
    rows = rows.select(*nodes.columns, "tile", "up", *own)
    return rows.select(*nodes.columns, "tile", "up", F.filter(F.array(*names), lambda s: s.isNotNull()).alias("path"))


def climb(leaves: DataFrame, fanout: int = 2) -> list[DataFrame]:
    """The stages of the trees over ``leaves`` (g, pos, of, node and others; pos from 0 in each g, g not null), from the leaves to the roots.

    Each run of ``fanout`` consecutive nodes becomes its hash while a group has more than one; a single leaf is its own root. A stage of windows
    does a few levels, and what remains of its tiles are the leaves of the next, so that no task sees more than a tile of a group.
    """
    levels = max(1, round(math.log(TILE, fanout)))
    most, stages = leaves.agg(F.max("of")).first()[0] or 0, [materialize(_stage(leaves, fanout, levels), "stage")]
    while (most := -(-most // fanout**levels)) > 1:
        tops = stages[-1].where(F.col("pos") % fanout**levels == 0)
        tops = tops.select("g", F.col("tile").alias("pos"), F.ceil(F.col("of") / fanout**levels).alias("of"), F.col("up").alias("node"))
        stages.append(materialize(_stage(tops, fanout, levels), "stage"))
    return stages


def roots(stages: list[DataFrame]) -> DataFrame:
    return stages[-1].where("pos = 0").select("g", F.col("up").alias("top"))


def descend(stages: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The leaves with their whole ``path``, which goes on with the ``rest`` of their g in ``crown``, and its other columns.

    Each stage joins the one above, which has a row for each of its tiles.
    """
    above = crown.withColumn("tile", F.lit(0).cast("long"))
    more = [c for c in above.columns if c not in ("g", "tile", "rest")]
    for stage in reversed(stages):
        full = stage.join(above, ["g", "tile"]).withColumn("path", F.concat("path", "rest")).drop("rest", "tile", "up")
        above = full.select("g", F.col("pos").alias("tile"), F.col("path").alias("rest"), *more)
    return full


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column, fanout: int = 2) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    Leaves are hashes of doc_id, source, lang, n_chars and text. Those of a lang make a tree in the order of doc_id (nulls first; rows of one
    doc_id by leaf), the subroots one in the order of lang (null first, else by UTF-8 bytes; an empty lang is a lang). ``proof_sha256`` is the hash of the
    siblings of all levels. Where ``tampered`` holds, ``folded_root`` starts from the leaf with n_chars raised by one (null stays null), else from the leaf; it
    shows whether a row is the one that the manifest was made of. Repeated rows are leaves of their own, an empty table gives an empty result, other columns are ignored.
    """
    columns = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string")]
    raised = [*columns[:3], columns[3].cast("decimal(20,0)") + 1, columns[4]]
    start = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(*raised))
    group = F.when(columns[2].isNull(), "").otherwise(F.concat(F.lit("="), columns[2]))  # in the order wanted, never null
    rows = docs.select(columns[0].alias("doc_id"), group.alias("g"), leaf_hash(*columns).alias("node"), start.alias("start"))
    stages = climb(numbered(rows, ["g"], ["doc_id", "node"], "pos", "of"), fanout)
    subroots = roots(stages).select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("top").alias("node"))
    over = climb(numbered(subroots, ["g"], ["lang"], "pos", "of"), fanout)
    whole = descend(over, roots(over).withColumn("rest", F.array().cast(over[0].schema["path"].dataType)))
    out = descend(stages, whole.select(F.col("lang").alias("g"), F.col("node").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("rest")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("start", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
