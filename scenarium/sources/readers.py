"""Readers with the checks that a manifest or metadata file needs; all through Spark, so that any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scenarium.functions.semantics import rotation_from_quaternion
from scenarium.plans.materialize import materialize

FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text"}


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By the extension; CSV has a header and takes its columns as text unless a schema is given."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").format(FORMATS[kind]).load(path)


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, length)`` of all files under ``root`` that match, without reading them; none is an error when collected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, value)``: text lines with their number from 1 in their file, blank ones counted.

    A file may be read in many parts: a line knows the byte at which its part begins and its place in it, and the lines of the parts before are added,
    a row for each part. The lines are written once, so that both look at the same parts.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    rows = materialize(rows, "lines")
    parts = rows.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("path", "_start", "_first", before.alias("_before"))
    return rows.join(parts, ["path", "_start"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def read_manifest(spark: SparkSession, path: str, schema: StructType, tag: str) -> DataFrame:
    """JSON lines of the given ``schema`` tag; a line that isn't JSON or has another tag is an error that shows its file, its number and the line."""
    fields = StructType([*schema.fields, *([] if "schema" in schema.names else [StructField("schema", StringType())])])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", fields).alias("r"), "path", "line", "value")
    place = F.concat(F.regexp_extract("path", "[^/]*$", 0), F.lit(":"), F.col("line").cast("string"))
    sound = F.when(F.col("r.schema") == tag, F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"not a line of {tag}: "), place, F.lit(": "), F.substring("value", 1, 200))).cast(fields))
    return rows.select(sound.alias("r")).select("r.*").drop("schema")


def write_metrics(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order; metrics that are missing are empty."""
    present = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*present).write.option("header", "true").mode("overwrite").csv(path)


def write_lines(rows: DataFrame, path: str, blank_every: int = 0) -> None:
    """JSON lines with sorted keys and nulls left out; ``blank_every`` puts an empty line after so many, as hand-written manifests have them."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    if blank_every:
        line = F.when(F.pmod(F.xxhash64(line), F.lit(blank_every)) == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    rows.select(line.alias("value")).write.text(path)


BOX_FIELDS = "rotation array<double>, rotation_quat_wxyz array<double>, rotation_xyzw array<double>, largest_scale double, scale string"


def unwrapped_boxes(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``rotation`` (nine numbers, row by row) and ``scale`` (the largest) of the box that the JSON in ``text`` has, wrapped as obb_world or world or not.

    Rotations are quaternions, real part first or last, or nine numbers; a scale is one number or three; a negative one is an error.
    """
    inner = F.coalesce(*(F.get_json_object(text, f"$.{w}") for w in ("obb_world", "world")), F.col(text))
    rows = rows.withColumn("_inner", inner).withColumn("_b", F.from_json("_inner", BOX_FIELDS))
    last = F.col("_b.rotation_xyzw")
    rows = rows.withColumn("_q", F.coalesce("_b.rotation_quat_wxyz", F.concat(F.slice(last, 4, 1), F.slice(last, 1, 3))))
    turned = F.array(*(c for row in rotation_from_quaternion(*(F.col("_q")[i] for i in range(4))) for c in row))
    scale = F.coalesce("_b.largest_scale", F.array_max(F.from_json("_b.scale", "array<double>")), F.col("_b.scale").try_cast("double"))
    rows = rows.withColumns({"rotation": F.when(F.col("_b.rotation").isNotNull(), F.col("_b.rotation")).when(F.col("_q").isNotNull(), turned), "scale": scale})
    checked = F.when(F.col("scale") < 0, F.raise_error(F.lit("a box has a negative scale")).cast("double")).otherwise(F.col("scale"))
    return rows.withColumn("scale", checked).drop("_inner", "_b", "_q")
