"""SNK-1: results as typed NDJSON, a JSON array for each row."""

from __future__ import annotations

import datetime
import json
import math
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_EPOCH = datetime.datetime(1970, 1, 1)


def _value(v: object, t: T.DataType) -> str:
    """i: whole numbers and times as seconds, d: decimals as text, f: doubles with 17 digits, b, s, struct, list."""
    if v is None:
        return "null"
    if isinstance(t, T.BooleanType):
        return f'{{"t":"b","v":{"true" if v else "false"}}}'
    if isinstance(t, T.IntegralType):
        return f'{{"t":"i","v":{v}}}'
    if isinstance(t, T.DecimalType):
        return f'{{"t":"d","v":"{v:.2f}"}}'
    if isinstance(t, T.FractionalType):
        if not math.isfinite(v):
            return f'{{"t":"f","v":"{"NaN" if v != v else "inf" if v > 0 else "-inf"}"}}'
        return f'{{"t":"f","v":{v:.16e}}}'
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        at = v.replace(tzinfo=None)
        return f'{{"t":"i","v":{(at - _EPOCH) // datetime.timedelta(seconds=1)}}}'
    if isinstance(t, T.DateType):
        return f'{{"t":"s","v":"{v.isoformat()}"}}'
    if isinstance(t, T.StructType):
        return '{"t":"struct","v":{' + ",".join(f"{json.dumps(f.name)}:{_value(v[f.name] if isinstance(v, dict) else v[i], f.dataType)}" for i, f in enumerate(t.fields)) + "}}"
    if isinstance(t, T.ArrayType):
        return '{"t":"list","v":[' + ",".join(_value(x, t.elementType) for x in v) + "]}"
    return f'{{"t":"s","v":{json.dumps(str(v), ensure_ascii=False)}}}'


def lines(df: DataFrame) -> Iterator[str]:
    """A line for each row, fetched partition by partition. The session's time zone must be UTC."""
    kinds = [f.dataType for f in df.schema.fields]
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield "[" + ",".join(_value(v, t) for v, t in zip(row, kinds, strict=True)) + "]"


def write_ndjson(df: DataFrame, out: IO[str], max_rows: int | None = None) -> int:
    """Writes the rows as they come; the number written. With max_rows an error once there are more."""
    from stratal.plans.errors import ResourceExhausted

    n = 0
    for line in lines(df if max_rows is None else df.limit(max_rows + 1)):
        if max_rows is not None and n == max_rows:
            raise ResourceExhausted(f"the result has more than {max_rows} rows")
        out.write(line + "\n")
        n += 1
    return n


def typed_lines(df: DataFrame) -> DataFrame:
    """The same lines as a column ``value``, made by the executors, in the order and partitions of df."""
    kinds = [f.dataType for f in df.schema.fields]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                columns = [c.to_pylist() for c in batch.slice(at, 4096).columns]
                told = ["[" + ",".join(_value(v, t) for v, t in zip(row, kinds, strict=True)) + "]" for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.string())], names=["value"])

    return df.mapInArrow(made, "value string")


def write_ndjson_folder(df: DataFrame, path: str) -> None:
    """A folder of NDJSON files, a file for each task: results of any size, without the driver."""
    typed_lines(df).write.text(path)
