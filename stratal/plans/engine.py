"""Tables by name, and queries over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import syntax
from .compiler import Compiler
from .errors import AnalysisError, ResourceExhausted
from .types import of_spark, supported, to_spark


def normalised(df: DataFrame, timestamps: str = "strict") -> DataFrame:
    """Columns in the dialect's types: whole numbers as BIGINT, floats as DOUBLE, names in lower case.

    timestamps: what becomes of fractions of seconds: ``strict`` raises when one is met, ``cut`` drops them.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise AnalysisError("column names differ in case only")
    out = []
    for f, name in zip(df.schema.fields, names, strict=True):
        t, c = of_spark(f.dataType), F.col(f"`{f.name}`")
        if supported(t):
            kind = to_spark(t)
            if f.dataType.simpleString().lower() != kind.replace("`", "").replace(": ", ":").replace(", ", ","):
                c = c.cast(kind)  # only where it must: under a cast Spark reads whole structs
            if t == "timestamp":
                whole = F.date_trunc("second", c)
                c = whole if timestamps == "cut" else F.when(c.isNull() | (whole == c), c).otherwise(F.raise_error(F.lit(f"{name}: a timestamp has a fraction of a second")).cast("timestamp"))
        out.append(c.alias(name))
    return df.select(*out)


class _Asked(dict):
    """Tables by name, with the names that were asked for."""

    def __init__(self, tables: dict) -> None:
        super().__init__(tables)
        self.names: set[str] = set()

    def __contains__(self, name: object) -> bool:
        self.names.add(name)
        return super().__contains__(name)

    def __getitem__(self, name: str) -> tuple[str, list[tuple[str, object]]]:
        self.names.add(name)
        return super().__getitem__(name)

    def get(self, name: str, default: object = None) -> object:
        self.names.add(name)
        return super().get(name, default)


class Prepared:
    """A parsed query, tied to the fields of the tables that it reads. Tables registered anew under the same name with
    the same fields are read as they are then."""

    def __init__(self, engine: Engine, text: str) -> None:
        self.engine, self.text, self.tree = engine, text, syntax.parse(text)
        self.columns, self.fields = None, {}
        self._compiled()

    def _compiled(self) -> str:
        for name, cols in self.fields.items():
            if name not in self.engine.tables or self.engine.tables[name][1] != cols:
                raise AnalysisError("query input schema changed")
        asked = _Asked(self.engine.tables)
        sql, self.columns, _ = Compiler(asked).query(self.tree)
        self.fields = {n: list(self.engine.tables[n][1]) for n in asked.names if n in self.engine.tables}
        return sql

    @property
    def output_schema(self) -> list[tuple[str, str]]:
        return [(n, to_spark(t)) for n, t in self.columns]

    def execute(self, max_rows: int | None = None) -> DataFrame:
        """The result; with max_rows it is fetched now, and an error if it has more rows than that."""
        df = self.engine.spark.sql(self._compiled())
        if max_rows is None:
            return df
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ResourceExhausted(f"the result has more than {max_rows} rows")
        return self.engine.spark.createDataFrame(rows, df.schema)

    def explain(self, mode: str = "formatted") -> str:
        plan = self.engine.spark.sql(self._compiled())
        return plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), mode)


class Engine:
    """A catalog of any number of tables that one dialect queries."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, tuple[str, list[tuple[str, object]]]] = {}

    def register(self, name: str, table: DataFrame | str, timestamps: str = "strict") -> Engine:
        """A DataFrame, or the path of a Parquet file or folder."""
        df = normalised(self.spark.read.parquet(table) if isinstance(table, str) else table, timestamps)
        view = f"stratal_{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        if name.lower() in self.tables:
            self.spark.catalog.dropTempView(self.tables[name.lower()][0])
        self.tables[name.lower()] = (view, [(f.name, of_spark(f.dataType)) for f in df.schema.fields])
        return self

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def sql(self, text: str, max_rows: int | None = None) -> DataFrame:
        return self.prepare(text).execute(max_rows)

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.prepare(text).explain(mode)
