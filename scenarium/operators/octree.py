"""Sparse octrees as relations: the byte stream in preorder, decoding from any of its blocks, attributes as deltas along the tree.

A node is a level (0: the root) and the Morton code of its cell at that level; voxels are the cells of the last level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.operators.ranking import numbered


def _start(node: str, level: str, levels: int) -> Column:
    """The first voxel's code that a node can hold: nodes in the order of it and of level are in preorder."""
    return F.expr(f"shiftleft({node}, cast(3 * ({levels} - ({level})) as int))")


def _up(node: str, by: str) -> Column:
    return F.expr(f"shiftright({node}, cast(3 * ({by}) as int))")


def tree(voxels: DataFrame, keys: list[str], code: str, levels: int) -> DataFrame:
    """``(keys, level, node, mask)``: all nodes above the voxels, with a bit for each child that holds any."""
    rows = voxels.select(*keys, F.col(code).alias("_code")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    slot = _up("_code", f"{levels} - level - 1") % 8
    return rows.groupBy(*keys, "level", _up("_code", f"{levels} - level").alias("node")).agg(F.bit_or(F.pow(F.lit(2.0), slot).cast("int")).alias("mask"))


def stream(nodes: DataFrame, keys: list[str], levels: int, block: int = 4096) -> DataFrame:
    """``(keys, block, level, node, above, bytes)``: the child masks of each group's nodes in preorder, ``block`` bytes a row.

    A node's place is its rank by first voxel and level, which ``numbered`` finds without sorting a group in a task. ``level`` and ``node`` are
    those of the block's first byte and ``above`` the masks of the nodes that it is in, from the root on, so that each block can be decoded by itself.
    """
    placed = numbered(nodes.withColumn("_start", _start("node", "level", levels)), keys, ["_start", "level"], "offset", "_of")
    placed = placed.withColumn("block", F.floor(F.col("offset") / block))
    inside = F.array_sort(F.collect_list(F.struct("offset", "mask")))
    data = placed.groupBy(*keys, "block").agg(inside.alias("_rows"))
    data = data.select(*keys, "block", F.unhex(F.array_join(F.transform("_rows", lambda r: F.lpad(F.hex(r["mask"]), 2, "0")), "")).alias("bytes"))
    first = placed.where(F.col("offset") % block == 0).select(*keys, "block", "level", "node")
    asked = first.where("level > 0").withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
    asked = asked.select(*keys, "block", F.col("_at").alias("level"), _up("node", "level - _at").alias("node"))
    masks = asked.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("level", "mask"))).alias("_above"))
    above = F.coalesce(F.transform("_above", lambda r: r["mask"]), F.array().cast("array<int>"))
    return first.join(data, [*keys, "block"]).join(masks, [*keys, "block"], "left").select(*keys, "block", "level", "node", above.alias("above"), "bytes")


def _voxels(level: int, node: int, above: list[int], data: bytes, levels: int) -> list[int]:
    """Codes of the voxels under a block's last-level nodes; ``left`` has the children still to come at each level of the way down to the node."""
    left = [mask >> (s := (node >> 3 * (level - a - 1) & 7) + 1) << s for a, mask in enumerate(above)] + [0] * (levels - level)
    out = []
    for mask in data:
        if level == levels - 1:
            out += [node << 3 | s for s in range(8) if mask >> s & 1]
            while level and not left[level - 1]:
                level, node = level - 1, node >> 3
            if not level:
                break
            level, node = level - 1, node >> 3
        else:
            left[level] = mask
        s = (left[level] & -left[level]).bit_length() - 1
        left[level] &= left[level] - 1
        level, node = level + 1, node << 3 | s
    return out


def decoded(blocks: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """``(keys, code)``: the voxels of a ``stream``, each block on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_voxels(*row, levels) for row in zip(*(batch.column(c).to_pylist() for c in ("level", "node", "above", "bytes")), strict=True)]
            at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array([c for own in found for c in own], pa.int64())], [*keys, "code"])

    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.select(*keys, "level", "node", "above", "bytes").mapInArrow(run, f"{kinds}, code long")


def _later_children(cells: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """The cells (level, node) that aren't their parent's first, with their ``slot`` from 1: parents in preorder, then children."""
    siblings = W.partitionBy(*keys, "level", "_parent").orderBy("node")
    rows = cells.where("level > 0").withColumn("_parent", _up("node", "1"))
    rows = rows.withColumn("_nth", F.row_number().over(siblings)).where("_nth > 1").drop("_nth")
    rows = rows.withColumn("_start", _start("_parent", "level - 1", levels)).withColumn("_above", F.col("level") - 1)
    return numbered(rows, keys, ["_start", "_above", "node"], "_n", "_of").withColumn("slot", F.col("_n") + 1).drop("_start", "_above", "_n", "_of")


def _cells(voxels: DataFrame, keys: list[str], code: str, levels: int) -> DataFrame:
    rows = voxels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return rows.withColumn("node", _up(code, f"{levels} - level"))


def parent_deltas(voxels: DataFrame, keys: list[str], code: str, value: str, levels: int) -> DataFrame:
    """``(keys, slot, delta)``: as many numbers from 0 to 255 as voxels, the root's value and then what each later child adds to the one before.

    A cell's value is that of its first voxel, found for all levels in one aggregate. ``value`` counts modulo 256.
    """
    cells = _cells(voxels, keys, code, levels).groupBy(*keys, "level", "node").agg(F.min_by(value, code).alias("_value"))
    before = F.lag("_value").over(W.partitionBy(*keys, "level", _up("node", "1")).orderBy("node"))
    cells = cells.withColumn("_delta", F.pmod(F.col("_value") - before, F.lit(256)))
    root = cells.where("level = 0").select(*keys, F.lit(0).cast("long").alias("slot"), F.pmod("_value", F.lit(256)).cast("int").alias("delta"))
    return root.unionByName(_later_children(cells, keys, levels).select(*keys, "slot", F.col("_delta").cast("int").alias("delta")))


def from_parent_deltas(deltas: DataFrame, voxels: DataFrame, keys: list[str], code: str, levels: int) -> DataFrame:
    """``(keys, code, value)`` of the ``voxels`` (keys, code): what children add is summed up among siblings, then from the root down, level by level."""
    cells = _cells(voxels.select(*keys, code), keys, code, levels).select(*keys, "level", "node").distinct()
    later = _later_children(cells, keys, levels).join(deltas, [*keys, "slot"]).select(*keys, "level", "node", "delta")
    added = F.sum(F.coalesce("delta", F.lit(0))).over(W.partitionBy(*keys, "level", "_parent").orderBy("node").rowsBetween(W.unboundedPreceding, 0))
    added = cells.withColumn("_parent", _up("node", "1")).join(later, [*keys, "level", "node"], "left").withColumn("_added", added)
    value = deltas.where("slot = 0").select(*keys, F.lit(0).cast("long").alias("node"), F.col("delta").cast("long").alias("value"))
    for level in range(1, levels + 1):
        below = added.where(F.col("level") == level).select(*keys, "node", "_parent", "_added")
        value = below.join(value.withColumnRenamed("node", "_parent"), [*keys, "_parent"]).select(*keys, "node", F.pmod(F.col("value") + F.col("_added"), F.lit(256)).alias("value"))
    return value.select(*keys, F.col("node").alias(code), F.col("value").cast("int").alias("value"))
