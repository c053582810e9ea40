"""Lineage cuts that survive lost executors: tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNER: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("owner", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of SparkContext.setCheckpointDir.

    Where neither is set, a session on this machine alone (``local[...]``, as in tests) gets a temporary folder. On a
    cluster that is an error: each executor would write to a folder of its own, and rows would vanish.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        with contextlib.suppress(Exception):  # a Connect session has no context
            root = spark.sparkContext.getCheckpointDir()
    if not root and re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    The written files replace the lineage, so that a lost executor costs a re-read and not a
    recomputation, and an iterative plan stays small. Within ``temporary_tables`` they go at its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if (owner := _OWNER.get()) is not None:
        owner.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``df``, which another table has replaced: nothing may read it any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables materialised within are removed at the end: write what is to stay before."""
    own: list[tuple[SparkSession, str]] = []
    token = _OWNER.set(own)
    try:
        yield
    finally:
        _OWNER.reset(token)
        for spark, path in own:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
