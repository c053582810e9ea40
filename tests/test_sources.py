import pytest
from pyspark.sql.types import LongType, StructField, StructType

from scenarium.operators.lineage import contract_faults
from scenarium.sources.readers import discover, numbered_lines, read, read_manifest, write_metrics


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"schema": "v1", "a": 1}\n\n{"schema": "v1", "a": 2}\n')
    schema = StructType([StructField("a", LongType())])
    assert sorted(r.a for r in read_manifest(spark, str(tmp_path / "m.jsonl"), schema, "v1").collect()) == [1, 2]
    with pytest.raises(Exception, match="not a line of v2"):
        read_manifest(spark, str(tmp_path / "m.jsonl"), schema, "v2").collect()
    assert [r.path.rsplit("/", 1)[1] for r in discover(spark, str(tmp_path), "*.jsonl").collect()] == ["m.jsonl"]
    assert read(spark, str(tmp_path / "m.jsonl"), schema).count() >= 2
    with pytest.raises(ValueError, match="no reader"):
        read(spark, "x.bin")


def test_metric_columns_keep_their_order(spark, tmp_path):
    out = str(tmp_path / "m.csv")
    write_metrics(spark.createDataFrame([(1.0, "s")], "f1 double, scene string"), out, ["scene", "cd", "f1"])
    got = read(spark, out)
    assert got.columns == ["scene", "cd", "f1"] and got.first().cd is None


def test_lines_know_their_number_in_a_file_of_many_parts(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name, rows in (("a.jsonl", 700), ("b.jsonl", 40)):
        (tmp_path / "m" / name).write_text("".join(f'{{"schema": "v1", "a": {n}}}\n' + "\n" * (n % 3 == 0) for n in range(rows)) + ("oops\n" if name == "a.jsonl" else ""))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        got = numbered_lines(spark, str(tmp_path / "m"))
        assert got.select("path").distinct().count() == 2 and spark.read.text(str(tmp_path / "m")).rdd.getNumPartitions() > 10
        for name in ("a.jsonl", "b.jsonl"):
            lines = (tmp_path / "m" / name).read_text().split("\n")[:-1]
            assert [tuple(r) for r in got.where(got.path.endswith(name)).select("line", "value").orderBy("line").collect()] == list(enumerate(lines, 1))
        with pytest.raises(Exception, match=f"not a line of v1: a.jsonl:{700 + 234 + 1}: oops"):
            read_manifest(spark, str(tmp_path / "m"), StructType([StructField("a", LongType())]), "v1").collect()
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), held, strict=True):
            spark.conf.set(k, v)


def test_contract_faults_in_order(spark):
    good = ([0.5] * 64, 8, 2, 8, 512, "x", "AB")
    odd = {0: [0.5] * 63, 1: 16, 2: 4, 3: None, 4: 513, 5: "y", 6: "cd"}
    rows = [(0, *good), (1, [float("nan")] * 64, *good[1:]), (2, None, *good[1:])] + [(10 + k, *good[:k], v, *good[k + 1 :]) for k, v in odd.items()]
    frame = spark.createDataFrame(rows, "i int, v array<double>, input_resolution int, latent_resolution int, latent_channels int, occupied_count int, artifact string, encoder_sha256 string")
    digests = spark.createDataFrame([("x", "ab")], "artifact string, sha256 string")
    got = {r["i"]: r["fault"] for r in contract_faults(frame, "v", 8, 2, 8, digests).collect()}
    assert got == {0: None, 1: "not finite", 2: "values", 10: "values", 11: "input_resolution", 12: "latent_resolution", 13: "latent_channels", 14: "occupied_count", 15: "artifact", 16: "encoder"}
