"""SRC-10, SRC-11: scans of nested Parquet files by dotted paths and row groups; shapes are kept, nothing is exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratal.plans.errors import AnalysisError


def _pruned(t: T.DataType, paths: list[tuple[str, ...]], said: str) -> T.DataType:
    """The part of a type that the paths reach; an empty path takes all. Lists and map values are gone through."""
    if any(not p for p in paths):
        return t
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_pruned(t.elementType, paths, said), t.containsNull)
    if isinstance(t, T.MapType):
        if any(p[0] not in ("key", "value") for p in paths):
            raise AnalysisError(f"unknown path {said}")
        inner = [p[1:] for p in paths if p[0] == "value"]
        return T.MapType(t.keyType, _pruned(t.valueType, inner, said) if inner else t.valueType, t.valueContainsNull)
    if not isinstance(t, T.StructType):
        raise AnalysisError(f"unknown path {said}")
    for p in paths:
        if p[0] not in t.fieldNames():
            raise AnalysisError(f"unknown path {'.'.join(p)} in {said}")
    return T.StructType([T.StructField(f.name, _pruned(f.dataType, mine, f.name), f.nullable) for f in t.fields if (mine := [p[1:] for p in paths if p[0] == f.name])])


def pruned_schema(schema: T.StructType, columns: Sequence[str]) -> T.StructType:
    """The schema's leaves under the dotted paths, in the file's order; overlapping paths count once."""
    out = _pruned(schema, [tuple(c.split(".")) for c in columns], "the file")
    assert isinstance(out, T.StructType)
    return out


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, row_groups: Sequence[int] | None = None) -> DataFrame:
    """A Parquet file's columns (all if None) of the row groups named (all if None; an empty list gives no rows)."""
    df = spark.read.parquet(path)
    schema = df.schema
    if columns is not None:
        if not columns:
            raise AnalysisError("a scan needs a column")
        schema = pruned_schema(schema, columns)
        df = spark.read.schema(schema).parquet(path)
    if row_groups is None:
        return df
    if not row_groups:
        return df.limit(0)
    first = _starts(spark, path)
    if len(set(row_groups)) < len(row_groups) or any(not 0 <= g < len(first) - 1 for g in row_groups):
        raise AnalysisError(f"row groups must be distinct and below {len(first) - 1}")
    index = F.col("_metadata.row_index")
    wanted = F.lit(False)
    for g in row_groups:
        wanted = wanted | ((index >= first[g]) & (index < first[g + 1]))
    return df.where(wanted).select(*[F.col(f"`{c}`") for c in schema.names])


def _starts(spark: SparkSession, path: str) -> list[int]:
    """Where each row group of one file starts, then its end. The footer is read through Spark's file system."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    tail = spark.read.format("binaryFile").load(path)
    if tail.count() != 1:
        raise AnalysisError("row groups can be chosen of a single file only")
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    local = path.removeprefix("file://") if fs.getScheme() == "file" else None
    meta = pq.read_metadata(local) if local else pq.read_metadata(pa.BufferReader(tail.select("content").first()[0]))
    out = [0]
    for g in range(meta.num_row_groups):
        out.append(out[-1] + meta.row_group(g).num_rows)
    return out


def summary(spark: SparkSession, path: str) -> list[dict]:
    """SNK-5: each leaf's path and levels, from the footer of a local file."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path.removeprefix("file://"))
    return [{"path": (c := meta.schema.column(i)).path, "definition": c.max_definition_level, "repetition": c.max_repetition_level, "type": c.physical_type} for i in range(meta.num_columns)]
