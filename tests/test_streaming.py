from pyspark.sql import functions as F

from scenarium.streaming.incremental import last_n, process_new, windowed_counts


def test_repeated_input_is_not_worked_on_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "item long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("item long").parquet(source)
        process_new(stream, "item", lambda df: df.withColumn("done", F.lit(True)), out, str(tmp_path / f"check{n}")).awaitTermination()
    assert sorted(r["item"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_ring_buffer_is_null_until_full(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "k string, t long, v double")
    assert [r.last_n for r in last_n(rows, "k", ["t"], "v", 3).orderBy("t").collect()] == [None, None, 1.0, 2.0]


def test_windows_on_a_stream(spark, tmp_path):
    e = spark.sql("select timestamp_ntz'2024-01-01 00:01:00' as ts, 'x' as event_type, 1.0D as value")
    e.write.parquet(str(tmp_path / "events"))
    stream = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(1, 1.0)]


def test_rings_of_a_restarted_stream_equal_those_of_the_table(spark, tmp_path):
    """Two runs from one checkpoint, of three batches each with rows of all keys."""
    import random

    from scenarium.streaming.ring import ring_over_stream, ring_over_table

    rng, source, out, t = random.Random(1), str(tmp_path / "ring_in"), str(tmp_path / "ring_out"), 0
    schema = "k string, t long, x double, y double"
    for _ in range(2):
        for _ in range(3):
            rows = []
            for _ in range(rng.randrange(5, 15)):
                rows.append((rng.choice("ab"), t, rng.choice((1.0, 2.0, rng.random() * 9)), rng.choice((rng.random(), rng.random(), None, float("nan"), float("inf")))))
                t += 1
            rng.shuffle(rows)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(source)
        rings = ring_over_stream(stream, "k", ["t"], "x", "y", 4, 3, 0.9)
        rings.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ring_check")).trigger(availableNow=True).start().awaitTermination()
    plain = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("k", "t", "x", "y", "limit", "slope", "intercept").collect())
    got, want = plain(spark.read.parquet(out)), plain(ring_over_table(spark.read.parquet(source), "k", ["t"], "x", "y", 4, 3, 0.9))
    assert got == want and any(r[4] is not None for r in want) and any(r[5] is not None for r in want)
