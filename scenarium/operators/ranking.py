"""Windows, top-k, sampling, sharding and ordering, always by explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.plans.materialize import materialize


def numbered(rows: DataFrame, keys: list[str], order: list[str], n: str = "_n", of: str = "_of") -> DataFrame:
    """``rows`` with their place ``n`` (from 0) in their group by ``order``, and the group's size ``of``.

    No task sorts a group: rows are dealt out by range of keys and order, numbered within each part, and moved on by
    the sizes of the parts before, a row for each part and group.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)) - 1
    dealt = materialize(dealt.withColumn("_place", place.cast("long")), "numbered")
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_size"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", *keys, before.alias("_before"), F.sum("_size").over(whole).alias(of))
    same = [F.col("a._part") == F.col("b._part"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    out = dealt.alias("a").join(sizes.alias("b"), same)
    return out.select(*(f"a.{c}" for c in rows.columns), (F.col("_place") + F.col("_before")).alias(n), of)


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_per_group(rows, keys, order, 1)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``; the rank limit is applied before the shuffle too."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def z_buffer(observations: DataFrame, view: str, cell: str, depth: str, row: str) -> DataFrame:
    """The nearest valid observation of each cell of a view; ties go to the lower row."""
    valid = observations.where(F.col(depth).isNotNull() & ~F.isnan(depth) & (F.col(depth) > 0) & (F.col(depth) < float("inf")) & F.col(cell).isNotNull())
    return first_per_group(valid, [view, cell], [depth, row])


def dedupe_nearest(points: DataFrame, at: list[str], depth: str, row: str) -> DataFrame:
    """One row for each place, of least depth (ties: lowest row); ``seen`` is the place's first row, to order by."""
    best = points.groupBy(*at).agg(F.min(F.struct(depth, row)).alias("b"), F.min(row).alias("seen"))
    return best.select(*at, F.col(f"b.{depth}").alias(depth), F.col(f"b.{row}").alias(row), "seen")


def balanced_selection(rows: DataFrame, group: str, name: str, total: int) -> DataFrame:
    """``total`` names shared evenly over the groups, one more for the first ones by name, in SHA-256 order.

    A group with fewer names than its share is an error.
    """
    distinct = rows.select(group, name).distinct()
    groups = distinct.groupBy(group).agg(F.count("*").alias("_have"))  # a row for each group
    ranked = groups.withColumn("_g", F.row_number().over(W.orderBy(group)) - 1).withColumn("_groups", F.count("*").over(W.partitionBy()))
    share = F.floor(F.lit(total) / F.col("_groups")) + F.when(F.col("_g") < F.lit(total) % F.col("_groups"), 1).otherwise(0)
    short = F.raise_error(F.lit("a group has fewer names than its share")).cast("long")
    quota = ranked.withColumn("_share", share).withColumn("_share", F.when(F.col("_have") >= F.col("_share"), F.col("_share")).otherwise(short))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.sha2(F.col(name).cast("string"), 256), name))
    return distinct.withColumn("rank", rank).join(quota.select(group, "_share"), group).where(F.col("rank") <= F.col("_share")).select(group, name, "rank")


def even_stride(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """At most ``k`` rows of each group at even steps from the first to the last."""
    ranked = numbered(rows, keys, [order], "_n", "_m")
    last, step = F.col("_m") - 1, F.lit(max(k - 1, 1))
    # row n is taken if it is floor(i * last / step) of some i
    i = F.ceil(F.col("_n") * step / F.greatest(last, F.lit(1))).cast("long")
    taken = (F.col("_m") <= k) | (F.floor(i * last / step) == F.col("_n"))
    return ranked.where(taken & (F.lit(k) > 0)).drop("_n", "_m")


def interleaved(scenes: DataFrame, objects: DataFrame, scene: str, weight: int) -> DataFrame:
    """After each scene its ``weight`` objects: entry i of n starts at (i * objects) div n, around the end of the list."""
    m = objects.count()
    placed = numbered(scenes, [], [scene], "i", "_n")
    entries = placed.select(scene, "i", "_n", F.explode(F.sequence(F.lit(0), F.lit(weight))).alias("k"))
    at = F.when(F.col("k") == 0, None).otherwise((F.floor(F.col("i") * m / F.col("_n")) + F.col("k") - 1) % F.lit(max(m, 1)))
    return entries.select((F.col("i") * (weight + 1) + F.col("k")).alias("position"), F.when(F.col("k") == 0, F.col(scene)).alias(scene), at.cast("long").alias("object_index"))


def round_robin(index: Column, world: int) -> Column:
    return F.pmod(index, F.lit(world))


def contiguous_shard(index: Column, n: Column, world: int) -> Column:
    """The r for which floor(n * r / world) <= index < floor(n * (r + 1) / world)."""
    return F.floor((F.lit(world) * (index + 1) - 1) / n).cast("long")


def average_precision(detections: DataFrame, key: str, order: list[Column | str], hit: str, n_truth: str) -> DataFrame:
    """Area under the precision envelope of each key: running hits, the highest precision from a point on, steps in recall.

    The envelope runs from the end to the front, so that each row extends the frame of the one before.
    """
    up = W.partitionBy(key).orderBy(*order)
    running = detections.withColumn("_tp", F.sum(hit).over(up.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(up))
    points = running.withColumn("_recall", F.col("_tp") / F.col(n_truth)).withColumn("_precision", F.col("_tp") / F.col("_n"))
    points = points.withColumn("_envelope", F.max("_precision").over(W.partitionBy(key).orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, 0))).withColumn("_before", F.coalesce(F.lag("_recall").over(up), F.lit(0.0)))
    return points.groupBy(key).agg(F.sum((F.col("_recall") - F.col("_before")) * F.col("_envelope")).alias("ap"))


def retained(rows: DataFrame, keys: list[str], newest_first: list[Column | str], keep: int) -> DataFrame:
    """The rows beyond the newest ``keep`` of each group: those to be removed."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("_n", n).where(F.col("_n") > keep).drop("_n")


def replicated(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row ``weight`` times, numbered; none for a weight of 0."""
    return rows.withColumn("copy", F.explode(F.when(weight > 0, F.sequence(F.lit(1), weight.cast("int"))).otherwise(F.array().cast("array<int>"))))


def latest(rows: DataFrame, keys: list[str], path: str, pattern: str) -> DataFrame:
    """The path with the highest number that ``pattern`` captures; -1 and null without any."""
    step = F.regexp_extract(path, pattern, 1).try_cast("long")
    return rows.groupBy(*keys).agg(F.coalesce(F.max(step), F.lit(-1)).alias("step"), F.max_by(path, F.struct(step, F.col(path))).alias("_p"), F.max(step).alias("_s")).select(*keys, "step", F.when(F.col("_s").isNotNull(), F.col("_p")).alias("path"))


def sampler_plan(items: DataFrame, item: str, world: int, seed: str, drop_last: bool = False, resume: int = 0) -> DataFrame:
    """``(rank, step, item)``: what each of ``world`` workers reads, in an order drawn by SHA-256 of seed and item.

    The list is padded from its begin to a multiple of ``world``, or its tail is dropped; steps before ``resume`` are left out.
    """
    drawn = items.select(F.col(item).alias("item"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256).alias("_h"))
    placed = numbered(drawn, [], ["_h", "item"], "_at", "_of")
    per = F.floor(F.col("_of") / world) if drop_last else F.ceil(F.col("_of") / world)
    total = (per * world).cast("long")
    # item n stands at n, and, for padding, at n + of, n + 2 * of, ... below the total
    places = F.when(F.col("_at") < total, F.sequence(F.col("_at"), total - 1, F.col("_of"))).otherwise(F.array().cast("array<bigint>"))
    rows = placed.select("item", F.explode(places).alias("_at"))
    return rows.select((F.col("_at") % world).alias("rank"), F.floor(F.col("_at") / world).alias("step"), "item").where(F.col("step") >= resume)


def balanced_batches(plan: DataFrame, load: str, world: int, batch: int) -> DataFrame:
    """``plan`` with ``rank`` dealt anew in each batch of ``world * batch`` items: by falling load, each goes to the least loaded rank with room.

    A batch is a group of fixed size; an incomplete last batch is left out.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < world * batch:
            return pdf.iloc[:0]
        pdf = pdf.sort_values([load, "item"], ascending=[False, True], kind="stable")
        sums, room, ranks = np.zeros(world), np.full(world, batch), []
        for x in pdf[load]:
            r = int(np.where(room > 0, sums, np.inf).argmin())
            sums[r] += x
            room[r] -= 1
            ranks.append(r)
        return pdf.assign(rank=ranks)

    rows = plan.withColumn("batch", F.floor(F.col("step") / batch))
    return rows.groupBy("batch").applyInPandas(run, rows.schema)


def padded_samples(ranked: DataFrame, groups: DataFrame, keys: list[str], item: str, length: int) -> DataFrame:
    """``length`` slots for each group: its items of ``rank`` 0, 1, ..., then empty ones that are marked as such."""
    slots = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("slot"))
    own = ranked.select(*keys, F.col("rank").cast("int").alias("slot"), F.col(item))
    return slots.join(own, [*keys, "slot"], "left").select(*keys, "slot", item, F.col(item).isNotNull().alias("filled"))


def weighted_choice(draws: DataFrame, options: DataFrame, option: str, weight: str, u: str) -> DataFrame:
    """``draws`` with the option in whose share of the total weight ``u`` (0 to 1) falls, in the order of the options.

    Options are few: they travel as one array. Those without a positive weight are never chosen.
    """
    listed = options.where(F.col(weight) > 0).agg(F.array_sort(F.collect_list(F.struct(F.col(option).alias("o"), F.col(weight).cast("double").alias("w")))).alias("_options"))
    running = F.expr("aggregate(_options, cast(array() as array<struct<o:bigint,upto:double>>), (a, x) -> array_append(a, named_struct('o', cast(x.o as bigint), 'upto', coalesce(try_element_at(a, -1).upto, 0D) + x.w)))")
    listed = listed.select(running.alias("_options"))
    total = F.col("_options")[F.size("_options") - 1]["upto"]
    chosen = F.filter("_options", lambda x: x["upto"] > F.col(u) * total)[0]["o"]
    return draws.crossJoin(F.broadcast(listed)).withColumn(option, chosen).drop("_options")
