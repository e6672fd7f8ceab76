"""Bar files, file lists and small reference tables as DataFrames."""

from __future__ import annotations

import hashlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wickflow.schema import BAR_SCHEMA
from wickflow.sources.feather import PART_BYTES, FeatherSource

#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 22


def read_bars(spark: SparkSession, path: str, schema=BAR_SCHEMA) -> DataFrame:
    """Bars of one CSV file or of all in a folder; symbol is the file name without its ending. NaN becomes NULL."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    symbol = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    doubles = [f.name for f in schema.fields if f.dataType.typeName() == "double"]
    return rows.select(symbol.alias("symbol"), *(F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in schema.names))


def read_feather(spark: SparkSession, path: str, schema=BAR_SCHEMA, part_bytes: int = PART_BYTES) -> DataFrame:
    """Bars of Feather files, each read by as many tasks as its size asks for; only the schema's columns are read. NaN becomes NULL."""
    spark.dataSource.register(FeatherSource)
    columns = StructType([StructField("symbol", StringType()), *schema.fields])
    rows = spark.read.format("feather").schema(columns).option("part_bytes", part_bytes).load(path)
    doubles = [f.name for f in schema.fields if f.dataType.typeName() == "double"]
    return rows.select("symbol", *(F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in schema.names))


def list_files(spark: SparkSession, path: str, ending: str = "*") -> DataFrame:
    """Path, name without ending, change time, bytes and a readable size; contents are not read."""
    size = F.col("length").cast("double")
    shown = (
        F.when(size < 1024, F.concat(F.col("length").cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / 1024**2))
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ending).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", name.alias("name"), "modificationTime", "length", shown.alias("size_text"))


def count_files(spark: SparkSession, path: str, ending: str = "*.csv") -> int:
    return list_files(spark, path, ending).count()


def hash_artifacts(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, sha256) of every file below a root, keyed by its path relative to the root.

    Tasks get paths and read files in pieces, so a file of any size takes a few megabytes. Where only Spark's readers know
    the store, contents go through them, which holds one file of at most 2 GB at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    paths = [unquote(p) for p in files.inputFiles()]  # with empty files, which a scan skips
    if not paths:
        return spark.createDataFrame([], "file string, sha256 string")
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    below = F.substring_index("path", root.rstrip("/") + "/", -1).alias("file")
    wanted = listed.select("path", below).where(~F.col("file").isin(*exclude) if exclude else F.lit(True))
    if not _readable(paths[0]):
        whole = files.select(below, F.sha2("content", 256).alias("sha256"))
        return wanted.join(whole, "file", "left").select("file", F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"))
    parts = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return wanted.repartition(parts).mapInArrow(_hash_files, "file string, sha256 string")


def _open(path: str):
    """A stream of a file's bytes as they are; paths come as Spark shows them, not escaped."""
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(name, compression=None)


def _readable(path: str) -> bool:
    """Whether tasks can open such paths themselves."""
    try:
        _open(path).close()
        return True
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False


def _hash_files(batches):
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _open(path) as stream:
                while piece := stream.read(HASH_BYTES):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string())], ["file", "sha256"])


def prefer_file(files: DataFrame, preferred: str) -> DataFrame:
    """One row: the preferred name if it is there, else the first path."""
    other = ~F.col("path").endswith("/" + preferred)
    return files.agg(F.min(F.struct(other.alias("other"), "path")).alias("best")).select("best.path")


def first_folder(spark: SparkSession, folders: list[str], ending: str = "*.csv") -> str:
    """The first folder that has such files, or the first of all where none has."""
    for folder in folders:
        try:
            if not list_files(spark, folder, ending).isEmpty():
                return folder
        except AnalysisException:  # it is not there
            continue
    return folders[0]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each text file, for clean.column_order. Only the first block of a file is read."""
    lines = spark.read.text(path, recursiveFileLookup=True).where("_metadata.file_block_start = 0")
    lines = lines.select(F.col("_metadata.file_name").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def prefer_source(primary: DataFrame, fallback: DataFrame, key: str = "symbol") -> DataFrame:
    """All rows of primary, and those of fallback whose key primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, split, value) from a wide table Metric, Validation, Test."""
    wide = spark.read.schema("Metric string, Validation double, Test double").option("header", True).csv(path)
    return wide.unpivot("Metric", ["Validation", "Test"], "split", "value").select(
        F.col("Metric").alias("metric"), F.lower("split").alias("split"), "value"
    )


def read_per_date(spark: SparkSession, path: str) -> DataFrame:
    """Per-date metrics; the list of long symbols is an array."""
    rows = spark.read.schema("date date, da double, rank_ic double, long_symbols string").option("header", True).csv(path)
    return rows.withColumn("long_symbols", F.split("long_symbols", ","))


def latest_predictions(predictions: DataFrame, **parameters) -> DataFrame:
    """The rows of the latest asof_date among those made with these parameters."""
    same = predictions
    for name, value in parameters.items():
        same = same.where(F.col(name).eqNullSafe(F.lit(value)))
    latest = same.agg(F.max("asof_date").alias("asof_date"))
    return same.join(F.broadcast(latest), "asof_date", "left_semi")
