"""DataFrame forms of the dialect's operators, for pipelines that use no SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sorted by (column, ascending): nulls last ascending, first descending; ties by all columns, nulls first."""
    cols = [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in keys]
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if c not in {k for k, _ in keys}]
    return df.orderBy(*cols, *rest)


def top_k(df: DataFrame, keys: Sequence[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """SORT-5: the rows from offset on of the order, at most limit; each task keeps limit + offset rows."""
    return ordered(df, keys).offset(offset).limit(limit)


def running(df: DataFrame, name: str, value: Column, partition: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """WIN-7: an aggregate over the rows up to the current one, counted by rows whatever ties there are."""
    keys = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order]
    w = Window.partitionBy(*partition).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, value.over(w))


def unnest(df: DataFrame, path: str, how: str = "inner", on: Callable[[Column, Column], Column] | None = None, names: tuple[str, str | None] = ("value", None)) -> DataFrame:
    """NEST-3 to 6: a row for each element; on sees the element and its place (from 1) before anything is dropped.

    how: ``inner``, or ``left`` for one row with nulls where nothing matches.
    """
    numbered = F.transform(F.col(path), lambda v, i: F.struct(v.alias("v"), (i + 1).cast("bigint").alias("o")))
    if on is not None:
        numbered = F.filter(numbered, lambda e: on(e["v"], e["o"]))
    explode = F.explode_outer if how == "left" else F.explode
    out = df.select("*", explode(numbered).alias("__element"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    extra = [F.col("__element.o").alias(names[1])] if names[1] else []
    return out.select(*kept, F.col("__element.v").alias(names[0]), *extra)


def exact_sum(value: Column) -> Column:
    """AGG-3: a sum of BIGINT that tolerates passing 64 bits on the way and is NULL only if the sum does not fit."""
    return F.sum(value.cast("decimal(38,0)")).try_cast("bigint")


def nest(events: DataFrame) -> DataFrame:
    """Events as one document for each user: names (event types) with languages (their values in order)."""
    typed = events.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    inner = F.struct(F.col("event_type").alias("url"), F.transform("v", lambda x: F.struct(x["value"].alias("code"))).alias("languages"))
    return typed.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("event_type", inner.alias("n")))).alias("n")).select("doc_id", F.transform("n", lambda x: x["n"]).alias("names"))
