"""Placing objects among others: seeded draws in rounds, each tested for collisions and support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.operators.voxels import XYZ
from scenarium.plans.materialize import materialize


def draw(seed: str, name: Column, turn: int, axis: str, choices: Column) -> Column:
    """One of 0, 1, ..., choices - 1 by the first 32 bits of SHA-256 of ``seed:name:turn:axis``."""
    text = F.concat(F.lit(f"{seed}:"), name.cast("string"), F.lit(f":{turn}:{axis}"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), choices)


def place(shapes: DataFrame, occupied: DataFrame, keys: list[str], seed: str, resolution: int, rounds: int, support: float, most: int, storeys: int) -> DataFrame:
    """``(keys, object, turn, dx, dy, dz)``: where objects find a place among what is there, in the round in which they do.

    ``shapes`` are the objects' voxels (keys, object, vx, vy, vz from 0), ``occupied`` the scenes'. In each round every object without a place draws one
    within the grid, its bottom on one of the lowest ``storeys`` levels. It stays if no voxel of it is taken, and at least the share ``support`` of its bottom
    stands on the ground or on taken voxels; of objects that would meet each other, one stays that has the least name in every voxel. A scene takes
    ``most`` objects, first come, then by name. Names are numbers. Rounds are joins and counts over voxels; objects are never compared with each other one by one,
    only those that stand look for collisions, and the objects of a scene that has taken all it may draw no more.
    """
    one = [*keys, "object"]
    taken = materialize(occupied.select(*keys, *XYZ).distinct(), "taken")
    named = shapes.select(*keys, F.col("object").cast("long").alias("object"), *XYZ)
    forms = named.groupBy(*one).agg(F.collect_list(F.struct(*XYZ)).alias("_form"), *((F.max(v) + 1).alias(f"size_{v}") for v in XYZ))
    open_ = materialize(forms.where(F.greatest(*(f"size_{v}" for v in XYZ)) <= resolution), "shapes")
    found: list[DataFrame] = []
    for turn in range(rounds):
        free = lambda v: F.lit(resolution) - F.col(f"size_{v}") + 1
        choices = {"vx": free("vx"), "vy": free("vy"), "vz": F.least(free("vz"), F.lit(storeys))}
        drawn = open_.select(*one, "_form", *(draw(seed, F.col("object"), turn, v, n).alias(f"d{v[1]}") for v, n in choices.items()))
        at = lambda form: F.inline(F.transform(form, lambda p: F.struct(*((p[v] + F.col(f"d{v[1]}")).alias(v) for v in XYZ))))
        bottom = F.filter("_form", lambda p: p["vz"] == 0)
        under = taken.select(*keys, "vx", "vy", (F.col("vz") + 1).alias("vz"))
        stands = drawn.where("dz > 0").select(*one, at(bottom)).join(under, [*keys, *XYZ], "left_semi").groupBy(*one).agg(F.count("*").alias("_held"))
        held = F.when(F.col("dz") == 0, F.size(bottom)).otherwise(F.coalesce("_held", F.lit(0)))
        held_up = materialize(drawn.join(stands, one, "left").where(held >= support * F.size(bottom)).drop("_held"), "held_up")
        hits = held_up.select(*one, at(F.col("_form"))).join(taken, [*keys, *XYZ], "left_semi").select(*one).distinct()
        fit = materialize(held_up.join(hits, one, "left_anti"), "fit")
        own = fit.select(*one, at(F.col("_form")))
        first = own.groupBy(*keys, *XYZ).agg(F.min("object").alias("_first"))
        late = own.join(first, [*keys, *XYZ]).where(F.col("object") > F.col("_first")).select(*one).distinct()
        sound = fit.drop("_form").join(late, one, "left_anti")
        room = sound.withColumn("_have", F.lit(0))
        if found:
            have = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.count("*").alias("_have"))
            room = sound.join(have, keys, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
        place_ = F.row_number().over(W.partitionBy(*keys).orderBy("object"))
        kept = room.withColumn("_place", place_).where(F.col("_place") <= most).where(F.col("_place") <= most - F.col("_have"))
        kept = materialize(kept.select(*one, F.lit(turn).alias("turn"), "dx", "dy", "dz"), "placed")
        found.append(kept)
        taken = materialize(taken.unionByName(own.join(kept.select(*one), one, "left_semi").select(*keys, *XYZ)), "taken")
        full = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.count("*").alias("_have")).where(F.col("_have") >= most)
        open_ = materialize(open_.join(kept.select(*one), one, "left_anti").join(full, keys, "left_anti"), "open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def placed_rows(rows: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, object, vx, vy, vz and others) of the objects that found a place, moved there; what they are of stays beside them."""
    moved = rows.join(places, [*keys, "object"])
    return moved.withColumns({v: F.col(v) + F.col(f"d{v[1]}") for v in XYZ}).drop("turn", "dx", "dy", "dz")
