"""NEST-14: nested lists striped into single values with repetition and definition levels, and put together again.

Documents are doc_id and names, a list of structs whose field languages is a list of structs with a field code.
Repetition is 0 for a document's first entry, 1 for the first of another name, 2 for another language. Definition
counts what is there: 0 no names, 1 a name without languages, 2 a language without a code, 3 a code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shred(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the name), inner (of the language), value, repetition, definition. Empty lists count as none."""
    names = docs.select("doc_id", F.posexplode_outer("names").alias("place", "name"))
    each = names.select("doc_id", "place", F.posexplode_outer("name.languages").alias("inner", "language"))
    repetition = F.when(F.coalesce("inner", F.lit(0)) > 0, 2).when(F.coalesce("place", F.lit(0)) > 0, 1).otherwise(0)
    definition = F.when(F.col("place").isNull(), 0).when(F.col("inner").isNull(), 1).when(F.col("language.code").isNull(), 2).otherwise(3)
    return each.select("doc_id", "place", "inner", F.col("language.code").alias("value"), repetition.alias("repetition"), definition.alias("definition"))


def assemble(striped: DataFrame) -> DataFrame:
    """doc_id and names (a list of lists of codes) from what shred returns; a document without names has an empty list."""
    there = F.when(F.col("definition") >= 2, F.struct("inner", "value"))
    inner = striped.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list(there)).alias("codes"), F.max("definition").alias("d"))
    name = F.when(F.col("d") > 0, F.struct("place", F.transform("codes", lambda x: x["value"]).alias("codes")))
    outer = inner.groupBy("doc_id").agg(F.array_sort(F.collect_list(name)).alias("names"))
    return outer.select("doc_id", F.transform("names", lambda x: x["codes"]).alias("names"))
