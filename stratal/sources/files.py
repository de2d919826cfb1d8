"""SRC-1, 2, 5 to 8: the event table and its dimensions from CSV, and any table from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns in file order.
EVENTS = "event_id bigint, user_id bigint, timestamp bigint, country string, device string, event_type string, duration_ms bigint, bytes bigint, score double, success boolean, campaign_id bigint"
USERS = "user_id bigint, segment string, signup_date date, lifetime_value decimal(18,2), region string, active boolean"
CAMPAIGNS = "campaign_id bigint, campaign_name string, budget decimal(18,2), start_date date, end_date date, channel string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a header and no quoting; an empty field is NULL, a value that does not fit is an error."""
    return spark.read.schema(schema).options(header=True, quote="", nullValue="", mode="FAILFAST").csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV, column file, Arrow or Parquet, by suffix; seconds become TIMESTAMP."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".arrow"):
        from .arrow_ipc import read_arrow

        df = read_arrow(spark, path)
    elif path.endswith(".csv"):
        df = read_csv(spark, path, EVENTS)
    else:
        from .column_file import read_columns

        df = read_columns(spark, path)
    if dict(df.dtypes).get("timestamp") == "bigint":
        df = df.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    return df


def read_star(spark: SparkSession, events: str) -> dict[str, DataFrame]:
    """The events table and the dimensions that stand beside it: ``events`` in the file's name replaced by theirs."""
    folder, _, name = events.rpartition("/")
    out = {"events": read_events(spark, events)}
    for other, schema in (("users", USERS), ("campaigns", CAMPAIGNS)):
        path = f"{folder}/{name.replace('events', other)}"
        out[other] = read_csv(spark, path, schema) if path.endswith(".csv") else read_events(spark, path)
    return out
