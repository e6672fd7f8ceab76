"""Files in and out, streaming refresh and the entry module."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickflow.operators import clean
from wickflow.sources import bars as sources
from wickflow.sources import sinks

HEAD = "timestamps,open,high,low,close,volume,amount\n"


@pytest.fixture
def folder(tmp_path):
    for name, close in (("AAA", 10), ("BBB", 20)):
        lines = "".join(f"2024-01-0{d} 00:00:00,1,2,1,{close + d},5,NaN\n" for d in (1, 2, 3))
        (tmp_path / f"{name}.csv").write_text(HEAD + lines)
    return tmp_path


def test_read_bars(spark, folder):
    rows = sources.read_bars(spark, str(folder))
    assert rows.count() == 6 and {r[0] for r in rows.select("symbol").collect()} == {"AAA", "BBB"}
    assert rows.where("amount is not null").count() == 0
    one = sources.read_bars(spark, f"{folder}/AAA.csv")
    assert one.count() == 3
    repaired = clean.normalize_schema(one).orderBy("ts").collect()
    assert repaired[0]["amount"] == 5 * (1 + 2 + 1 + 11) / 4
    assert sources.count_files(spark, str(folder)) == 2


def test_feather(spark, tmp_path):
    frame = pd.DataFrame({"timestamps": pd.to_datetime(["2024-01-01"]), **{c: [1.0] for c in ("open", "high", "low", "close", "volume", "amount")}})
    frame.to_feather(tmp_path / "CCC.feather")
    row = sources.read_feather(spark, str(tmp_path)).first()
    assert row["symbol"] == "CCC" and row["close"] == 1.0


def test_hashes_lists_and_choices(spark, folder):
    got = {r["file"]: r["sha256"] for r in sources.hash_artifacts(spark, str(folder)).collect()}
    assert got == {f"{n}.csv": hashlib.sha256((folder / f"{n}.csv").read_bytes()).hexdigest() for n in ("AAA", "BBB")}
    assert sources.hash_artifacts(spark, str(folder), ("AAA.csv",)).count() == 1
    files = sources.list_files(spark, str(folder), "*.csv")
    assert {r["name"] for r in files.collect()} == {"AAA", "BBB"}
    assert sources.prefer_file(files, "BBB.csv").first()["path"].endswith("BBB.csv")
    assert sources.prefer_file(files, "none.csv").first()["path"].endswith("AAA.csv")
    a = spark.createDataFrame([("A", 1)], "symbol string, v int")
    b = spark.createDataFrame([("A", 2), ("B", 2)], "symbol string, v int")
    assert {tuple(r) for r in sources.prefer_source(a, b).collect()} == {("A", 1), ("B", 2)}


def test_metric_tables_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("da", "validation", 1.0), ("da", "test", 2.0), ("mw_da", "validation", 3.0), ("mw_da", "test", 4.0)], "metric string, split string, value double")
    sinks.write_metrics(long, f"{tmp_path}/m")
    assert {tuple(r) for r in sources.read_metrics(spark, f"{tmp_path}/m").collect()} == {tuple(r) for r in long.collect()}
    days = spark.createDataFrame([("2024-01-01", 50.0, 0.1, ["A", "B"])], "date string, da double, rank_ic double, long_symbols array<string>")
    sinks.write_per_date(days.withColumn("date", F.to_date("date")), f"{tmp_path}/d")
    assert sources.read_per_date(spark, f"{tmp_path}/d").first()["long_symbols"] == ["A", "B"]
    errors = spark.createDataFrame([("v1", "open", 1.0), ("v2", "open", 2.0)], "model string, feature string, mape double")
    sinks.write_recon(errors, f"{tmp_path}/r", "mape")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").columns == ["feature", "v1", "v2"]


def test_predictions_overwrite_their_dates_only(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, "m", "2024-01-01"), ("A", 2, "m", "2024-01-02")], "symbol string, v int, model string, asof_date string")
    sinks.write_predictions(rows, f"{tmp_path}/p")
    sinks.write_predictions(rows.where("v = 2").withColumn("v", F.lit(3)), f"{tmp_path}/p")
    kept = spark.read.parquet(f"{tmp_path}/p")
    assert {r["v"] for r in kept.collect()} == {1, 3}
    assert {r["v"] for r in sources.latest_predictions(kept, model="m").collect()} == {3}
    sinks.write_manifest(rows.agg(F.collect_list(F.struct("symbol", "v")).alias("all")), f"{tmp_path}/j")
    assert len(spark.read.json(f"{tmp_path}/j").first()["all"]) == 2


def test_entry_module(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60
    rows = entry.entry(spark)
    assert rows.columns == ["symbol", "n", "da", "mw_da"] and rows.count() == 25


def test_headers_are_read_and_checked(spark, tmp_path):
    names = "timestamps,open,high,low,close,volume,amount"
    (tmp_path / "a.csv").write_text(f"{names}\n2024-01-01,1,1,1,1,1,1\n" * 3)
    (tmp_path / "b.csv").write_text("timestamps,close,open,high,low,volume,amount\n")
    (tmp_path / "c.csv").write_text("date,close\n1,2\n")
    heads = sources.read_headers(spark, str(tmp_path))
    assert {r["file"]: r["header"] for r in heads.collect()}["a.csv"] == names
    got = {r["file"]: (r["same_columns"], r["same_order"]) for r in clean.column_order(heads).collect()}
    assert got == {"a.csv": (True, True), "b.csv": (True, False), "c.csv": (False, False)}


def test_the_first_folder_with_files_is_taken(spark, tmp_path):
    for name in ("empty", "full"):
        (tmp_path / name).mkdir()
    (tmp_path / "full" / "A.csv").write_text("x\n")
    folders = [str(tmp_path / n) for n in ("missing", "empty", "full")]
    assert sources.first_folder(spark, folders) == folders[2]
    assert sources.first_folder(spark, folders[:2]) == folders[0]


def write_batches(path, batches, rows=1000):
    import pyarrow as pa

    names = ["timestamps", "open", "high", "low", "close", "volume", "amount", "note"]
    kinds = [pa.timestamp("ns"), *[pa.float64()] * 6, pa.string()]
    schema = pa.schema(list(zip(names, kinds)))
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for b in range(batches):
            at = list(range(b * rows, (b + 1) * rows))
            values = [pa.array([x * 1_000_000_000 for x in at], pa.timestamp("ns")), *(pa.array([float(x + k) if x % 7 else None for x in at]) for k in range(5)), pa.array([float("nan")] * rows), pa.array(["n"] * rows)]
            writer.write_batch(pa.record_batch(values, schema=schema))


def test_a_feather_file_is_read_by_several_tasks(spark, tmp_path):
    write_batches(tmp_path / "AAA.feather", 10)
    write_batches(tmp_path / "BBB.feather", 1, 3)
    rows = sources.read_feather(spark, str(tmp_path), part_bytes=100_000)
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("s"), F.min("timestamps").alias("t")).collect()
    assert len(found) > 4 and all(r["s"] == 1 and (r["n"] % 1000 == 0 or r["n"] == 3) for r in found)
    assert sum(r["n"] for r in found) == 10_003 and rows.where("amount is not null").count() == 0
    total = rows.where("symbol = 'AAA'").agg(F.sum("close"), F.count("close"), F.countDistinct("timestamps")).first()
    kept = [x for x in range(10_000) if x % 7]
    assert tuple(total) == (float(sum(x + 3 for x in kept)), len(kept), 10_000)


def test_feather_columns_endings_and_missing_files(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from wickflow.sources.feather import BatchRange, FeatherReader

    write_batches(tmp_path / "AAA.feather", 2, 5)
    two = StructType.fromDDL("symbol string, close double")
    reader = FeatherReader(two, str(tmp_path), 1 << 20)
    assert reader.partitions() == [BatchRange(f"{tmp_path}/AAA.feather", 0, 1)]
    batch = next(reader.read(reader.partitions()[0]))
    assert batch.schema.names == ["symbol", "close"] and batch.num_rows == 5
    assert [sum(b.num_rows for b in reader.read(BatchRange(f"{tmp_path}/AAA.feather", k, 3))) for k in range(3)] == [0, 5, 5]
    with pytest.raises(ValueError, match="no column other"):
        list(FeatherReader(StructType.fromDDL("other int"), str(tmp_path), 1).read(BatchRange(f"{tmp_path}/AAA.feather", 0, 1)))
    with pytest.raises(FileNotFoundError):
        FeatherReader(two, f"{tmp_path}/none", 1).partitions()
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(ValueError, match="not a Feather file"):
        reader.partitions()
    assert pa.__version__


def test_large_and_oddly_named_files_are_hashed_in_pieces(spark, tmp_path):
    """A sparse file of 3 GB, beyond what one cell can hold, and names that a URI has to escape."""
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "a b%20#.csv").write_text("x")
    (tmp_path / "empty").write_text("")
    got = {r["file"].rsplit("/", 1)[-1]: r["sha256"] for r in sources.hash_artifacts(spark, str(tmp_path)).collect()}
    digest, piece = hashlib.sha256(), bytes(1 << 24)
    for _ in range(192):
        digest.update(piece)
    assert got["large.bin"] == digest.hexdigest() and got["empty"] == hashlib.sha256(b"").hexdigest()
    assert hashlib.sha256(b"x").hexdigest() in got.values() and len(got) == 3
