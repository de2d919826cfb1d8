"""SRC-4: Arrow IPC files as a Spark data source; a partition for each run of record batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(pa.memory_map(path.removeprefix("file://")))


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Dictionaries decoded, lists of one kind, times in microseconds: what Spark takes."""

    def kind(t: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(t):
            return kind(t.value_type)
        if pa.types.is_fixed_size_list(t) or pa.types.is_large_list(t) or pa.types.is_list(t):
            return pa.list_(kind(t.value_type))
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, kind(f.type), f.nullable) for f in t])
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        if pa.types.is_uint8(t) or pa.types.is_uint16(t) or pa.types.is_uint32(t) or pa.types.is_uint64(t):
            return pa.int64()
        if pa.types.is_large_string(t) or pa.types.is_string_view(t):
            return pa.string()
        return pa.date32() if pa.types.is_date64(t) else t

    fields = [pa.field(f.name, kind(f.type), f.nullable) for f in batch.schema]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, fields, strict=True)], schema=pa.schema(fields))


class _Run(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, runs: int) -> None:
        self.path, self.runs = path, runs

    def partitions(self) -> list[InputPartition]:
        n = _open(self.path).num_record_batches
        step = max(1, -(-n // self.runs))
        return [_Run(a, min(n, a + step)) for a in range(0, n, step)] or [_Run(0, 0)]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        f = _open(self.path)
        for i in range(partition.first, partition.last):
            yield _plain(f.get_batch(i))


class ArrowIpc(DataSource):
    """``spark.read.format("arrow_ipc").load(path)``; the path must be one that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        empty = _plain(pa.RecordBatch.from_pylist([], schema=_open(self.options["path"]).schema))
        return from_arrow_schema(empty.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("runs", "64")))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowIpc)
    return spark.read.format("arrow_ipc").load(path)
