"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.storage import checkpoint, shared_folder  # noqa: F401

#: White space that parts words: blank and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which drop_tables() can remove."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove what write_table() wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null or blank texts; no Python."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0) without keeping the words."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def named(df: DataFrame, *names: str) -> list[Column]:
    """Columns by exact name, whatever other columns or dots in names there are."""
    return [df[f"`{n}`"] for n in names]


#: A key of more than this share of all rows is joined by broadcast; there are fewer of them.
HOT = 1024


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with a table of one row for each key and the number n of its rows; very frequent keys don't move the rows.

    At most HOT keys have more than total / HOT rows; these rows of the table are broadcast, the others join by a shuffle.
    """
    often = F.col("n") > total / HOT
    hot = F.broadcast(table.where(often).drop("n"))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~often).drop("n"), keys)
    return cold.unionByName(rows.join(hot, keys))
