"""SRC-3: the native column file of the event table, read by row ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import EVENTS

# The file starts with these bytes and this version; all numbers are little-endian.
MAGIC, VERSION = b"DREMCOL1", 1
#: Columns in file order with their width; three dictionary columns hold their words before 4-byte codes.
LAYOUT = [("event_id", "<i8"), ("user_id", "<i8"), ("timestamp", "<i8"), ("country", "words"), ("device", "words"), ("event_type", "words"), ("duration_ms", "<i8"), ("bytes", "<i8"), ("score", "<f8"), ("success", "u1"), ("campaign_id", "<i8"), ("campaign_valid", "u1")]


def _plan(path: str) -> tuple[int, dict[str, tuple[int, list[str] | None]]]:
    """Rows, and where each column's values start, with the words of a dictionary."""
    with open(path.removeprefix("file://"), "rb") as f:
        head = f.read(20)
        if head[:8] != MAGIC or len(head) < 20 or struct.unpack_from("<I", head, 8)[0] != VERSION:
            raise ValueError(f"{path} is not a column file of version {VERSION}")
        (rows,) = struct.unpack_from("<Q", head, 12)
        out: dict[str, tuple[int, list[str] | None]] = {}
        for name, kind in LAYOUT:
            words = None
            if kind == "words":
                (n,) = struct.unpack("<I", f.read(4))
                words = [f.read(struct.unpack("<I", f.read(4))[0]).decode() for _ in range(n)]
            out[name] = (f.tell(), words)
            f.seek(rows * (4 if words is not None else np.dtype(kind).itemsize), 1)
        end = f.tell()
        if f.seek(0, 2) < end:
            raise ValueError(f"{path} ends early")
    return rows, out


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.size = path, rows

    def partitions(self) -> list[InputPartition]:
        n, _ = _plan(self.path)
        return [_Range(a, min(n, a + self.size)) for a in range(0, n, self.size)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        _, places = _plan(self.path)
        n, got = partition.last - partition.first, {}
        for name, kind in LAYOUT:
            at, words = places[name]
            dtype = np.dtype("<u4" if words is not None else kind)
            values = np.fromfile(self.path.removeprefix("file://"), dtype=dtype, count=n, offset=at + partition.first * dtype.itemsize)
            got[name] = pa.DictionaryArray.from_arrays(pa.array(values.astype(np.int32)), pa.array(words, pa.string())).dictionary_decode() if words is not None else pa.array(values)
        valid = got.pop("campaign_valid").to_numpy() == 0
        got["campaign_id"] = pa.array(got["campaign_id"].to_numpy(), mask=valid)
        got["success"] = got["success"].cast(pa.bool_())
        yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))


class ColumnFile(DataSource):
    """``spark.read.format("column_file").load(path)``; the path must be one that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "column_file"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", "1000000")))


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ColumnFile)
    return spark.read.format("column_file").load(path)


def write_columns(rows: list[dict], path: str) -> None:
    """A column file from rows of the event table; for tests and small extracts."""
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<IQ", VERSION, len(rows)))
        for name, kind in LAYOUT:
            if kind == "words":
                words = sorted({r[name] for r in rows})
                f.write(struct.pack("<I", len(words)))
                for w in words:
                    f.write(struct.pack("<I", len(w.encode())) + w.encode())
                f.write(np.array([words.index(r[name]) for r in rows], dtype="<u4").tobytes())
            elif name == "campaign_valid":
                f.write(np.array([r["campaign_id"] is not None for r in rows], dtype="u1").tobytes())
            else:
                f.write(np.array([r[name] if r[name] is not None else 0 for r in rows], dtype=kind).tobytes())
