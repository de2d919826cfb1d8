"""SNK-2, SRC-7: results in batches while the query runs; no more than one partition is held."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.pandas.types import to_arrow_schema

from stratal.plans.errors import ResourceExhausted


def rows(df: DataFrame, size: int = 4096) -> Iterator[list[Row]]:
    """Lists of at most ``size`` rows, in the order of the query; LIMIT and OFFSET are the query's."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def record_batches(df: DataFrame, size: int = 65536) -> Iterator[pa.RecordBatch]:
    """The same as Arrow record batches of at most ``size`` rows. Executors make them; the driver only passes them on."""
    schema = to_arrow_schema(df.schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as writer:
                    writer.write_batch(batch.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(row[0]):
            yield batch if batch.schema.equals(schema) else batch.cast(schema)


def must_stream(df: DataFrame) -> DataFrame:
    """df, if its rows can be had before all are made; STREAMING_UNSUPPORTED where it ends in a sort or an aggregate."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset"):
        plan = plan.children().head()
    if plan.nodeName() in ("Sort", "Aggregate", "Window", "Distinct"):
        raise ResourceExhausted(f"STREAMING_UNSUPPORTED: {plan.nodeName()} needs all rows first")
    return df
