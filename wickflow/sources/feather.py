"""Feather files (Arrow files of record batches) as a Spark data source that splits a file by its batches.

    spark.dataSource.register(FeatherSource)
    spark.read.format("feather").schema("symbol string, close double").load(folder)

Only the columns of the schema are read from a file. symbol is the file name without its ending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a file for each partition (about): a file has as many partitions as its size asks for, of whole batches.
PART_BYTES = 64 << 20
ENDING = ".feather"


@dataclass
class BatchRange(InputPartition):
    """The k-th of n parts of a file's record batches."""

    path: str
    k: int
    n: int


def _opened(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FeatherSource(DataSource):
    """Options: path, a file or a folder; part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        raise ValueError("feather files are read with a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatherReader(schema, self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class FeatherReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, part_bytes: int):
        self.columns, self.path, self.part_bytes = schema, path, part_bytes

    def partitions(self) -> list[BatchRange]:
        """Parts of each file by its size; files are listed, not opened. Names with another ending are an error."""
        system, path = _opened(self.path)
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        other = [f.path for f in files if not f.path.endswith(ENDING)]
        if other:
            raise ValueError(f"not a Feather file: {other[0]}")
        prefix = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        sizes = [(f.path, max(1, -(-f.size // self.part_bytes))) for f in files]
        return [BatchRange(prefix + p, k, n) for p, n in sizes for k in range(n)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        system, path = _opened(partition.path)
        symbol = path.rsplit("/", 1)[-1].removesuffix(ENDING)
        want = to_arrow_schema(self.columns)
        with system.open_input_file(path) as source:
            there = pa.ipc.open_file(source).schema
            missing = [n for n in want.names if n != "symbol" and n not in there.names]
            if missing:
                raise ValueError(f"{path} has no column {', '.join(missing)}")
            fields = [there.get_field_index(n) for n in want.names if n != "symbol" or n in there.names]
            file = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=fields))
            count = file.num_record_batches
            for i in range(count * partition.k // partition.n, count * (partition.k + 1) // partition.n):
                batch = file.get_batch(i)
                columns = [batch.column(f.name) if f.name in batch.schema.names else pa.array([symbol] * batch.num_rows) for f in want]
                yield pa.RecordBatch.from_arrays([c.cast(f.type, safe=False) for c, f in zip(columns, want)], schema=want)
