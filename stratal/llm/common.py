"""What the corpus operators share: words, row keys and tables written between steps."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def text_of(name: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words in the order of the text, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != "")


#: This process's own folder, in local mode without a shared one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only in local mode without such a setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("folder", f"file://{tempfile.mkdtemp(prefix='stratal-')}")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors take nothing with them."""
    path = f"{shared_folder(df.sparkSession)}/stratal/{name}-{uuid.uuid4().hex}"
    forget(df.sparkSession)
    with _without_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner find shuffles that no table needs any more, so that their files go before more are written."""
    gc.collect()  # frames in cycles hold on to plans
    spark.sparkContext._jvm.System.gc()


#: Whether the shuffle files of a query go when it ends, rather than when its plan is collected as garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files: what they made stands in the shared folder, and nothing reads
    those files again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def placed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As written, and bucketed by key into as many parts as shuffles have: joins on it later move only their other side."""
    spark = df.sparkSession
    table = f"stratal_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _without_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/stratal/{table}").bucketBy(parts, key).saveAsTable(table)
    return spark.table(table)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
