"""The dialect's types, and how Spark's columns become them.

Simple types are words; a STRUCT is ("struct", ((name, type), ...)), a LIST ("list", type). Anything else is
("unsupported", text) and may only stand unreferenced in a table.
"""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {"int": "bigint", "double": "double", "decimal": "decimal(18,2)", "string": "string", "bool": "boolean", "date": "date", "timestamp": "timestamp", "interval": "bigint", "null": "void"}
NUMERIC = ("int", "decimal", "double")


def of_spark(t: T.DataType):
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(t, T.DecimalType) and t.precision == 20 and t.scale == 0:
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, T.DecimalType) and t.scale == 2 and t.precision <= 18:
        return "decimal"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.StructType):
        return ("struct", tuple((f.name.lower(), of_spark(f.dataType)) for f in t.fields))
    if isinstance(t, T.ArrayType):
        return ("list", of_spark(t.elementType))
    return ("unsupported", t.simpleString())


def to_spark(t) -> str:
    """Spark's type as SQL text."""
    if isinstance(t, str):
        return SIMPLE[t]
    if t[0] == "struct":
        return "struct<" + ", ".join(f"`{n}`: {to_spark(k)}" for n, k in t[1]) + ">"
    return f"array<{to_spark(t[1])}>"


def supported(t) -> bool:
    if isinstance(t, str):
        return True
    if t[0] == "unsupported":
        return False
    return all(supported(k) for _, k in t[1]) if t[0] == "struct" else supported(t[1])


def is_list(t) -> bool:
    return isinstance(t, tuple) and t[0] == "list"


def is_struct(t) -> bool:
    return isinstance(t, tuple) and t[0] == "struct"


def shown(t) -> str:
    return t.upper() if isinstance(t, str) else to_spark(t).upper() if supported(t) else t[1]


def common(a, b):
    """The type both sides widen to, or None: INT to DECIMAL to DOUBLE, NULL to anything, containers not at all."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in NUMERIC and b in NUMERIC:
        return max(a, b, key=NUMERIC.index)
    return None
