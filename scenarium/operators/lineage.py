"""Manifests and assets: reconciliation, ordered lookups, audits, merges of parts and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.operators.ranking import first_per_group


def reconcile(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` missing or extra."""
    a = wanted.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = present.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full").where("_a is null or _b is null")
    return both.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def pending(items: DataFrame, outputs: DataFrame, key: str, variants: int) -> DataFrame:
    """Items that don't have all their variants yet."""
    done = outputs.groupBy(key).agg(F.countDistinct("variant").alias("n")).where(F.col("n") >= variants)
    return items.join(done, key, "left_anti")


def keep_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return first_per_group(rows, keys, [position])


def conflicts(rows: DataFrame, keys: list[str], record: list[str]) -> DataFrame:
    """Keys under which different records are found."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*record)).alias("n")).where("n > 1")


def merge_parts(parts: DataFrame, key: str, part: str, on_disk: DataFrame) -> DataFrame:
    """The record of the last part wins; ids found only on disk come in with null fields."""
    last = first_per_group(parts, [key], [F.desc(part)])
    extra = on_disk.select(key).distinct().join(last, key, "left_anti")
    return last.unionByName(extra, allowMissingColumns=True)


def ordered_candidates(items: DataFrame, candidates: list[Column], metadata: DataFrame, key: str, order: str) -> DataFrame:
    """Each item's first candidate key that the metadata has; of repeated metadata keys the last row counts."""
    last = first_per_group(metadata, [key], [F.desc(order)])
    offered = items.select("*", F.posexplode(F.array(*candidates)).alias("_n", key)).where(F.col(key).isNotNull())
    found = offered.join(last, key)
    return found


def lookup_status(items: DataFrame, explicit: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """found, missing or ambiguous: an explicit entry wins, else the number of candidates decides."""
    named = explicit.select(key).distinct().withColumn("_e", F.lit(1))
    count = candidates.groupBy(key).agg(F.count("*").alias("n"))
    rows = items.join(named, key, "left").join(count, key, "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("_e").isNotNull() | (n == 1), "found").when(n == 0, "missing").otherwise("ambiguous")
    return rows.select(*items.columns, n.alias("n_candidates"), status.alias("status"))


def coalesced(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge in which the left value wins unless it is null."""
    fields = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    a, b = left.alias("a"), right.alias("b")
    pick = lambda c: F.coalesce(*([F.col(f"a.{c}")] if c in left.columns else []), *([F.col(f"b.{c}")] if c in right.columns else [])).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *map(pick, fields))


def checksum_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state): ok, wrong or absent, from the SHA-256 of the contents."""
    rows = manifest.join(files, "path", "left")
    state = F.when(F.col("content").isNull(), "absent").when(F.sha2("content", 256) == F.col("sha256"), "ok").otherwise("wrong")
    return rows.select("path", state.alias("state"))


def contract_faults(rows: DataFrame, values: str, input_resolution: int, latent_resolution: int, channels: int, digests: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``fault``, the first rule of the contract that a latent breaks, null if none.

    A latent is a row with its ``values`` and the recorded input_resolution, latent_resolution, latent_channels and occupied_count; in this order: the number of
    values, each recorded size, an occupied count of 0 to the cube of the input resolution, values that are null or no numbers. With ``digests``
    (artifact, sha256) the recorded artifact must be known and its encoder_sha256 equal, whatever the case of the letters.
    """
    length = channels * latent_resolution**3
    broken = F.size(F.filter(values, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))) > 0
    differs = lambda c, want: F.col(c).isNull() | (F.col(c) != want)
    rules = [
        ("values", F.col(values).isNull() | (F.size(values) != length)),
        ("input_resolution", differs("input_resolution", input_resolution)),
        ("latent_resolution", differs("latent_resolution", latent_resolution)),
        ("latent_channels", differs("latent_channels", channels)),
        ("occupied_count", F.col("occupied_count").isNull() | ~F.col("occupied_count").between(0, input_resolution**3)),
        ("not finite", broken),
    ]
    if digests is not None:
        known = digests.select("artifact", F.lower("sha256").alias("_sha"))
        rows = rows.join(known, "artifact", "left")
        rules += [("artifact", F.col("_sha").isNull()), ("encoder", F.col("encoder_sha256").isNull() | (F.lower("encoder_sha256") != F.col("_sha")))]
    fault = F.coalesce(*(F.when(broken_, name) for name, broken_ in rules))
    return rows.withColumn("fault", fault).drop("_sha")
