"""Command line: ``python -m stratal query|scan|serve``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame

from stratal.plans.engine import Engine
from stratal.plans.errors import DialectError, ResourceExhausted
from stratal.plans.serving import Server, admitted
from stratal.plans.stats import told
from stratal.session import build_session
from stratal.sinks.arrow_file import write_arrow
from stratal.sinks.ndjson import write_ndjson
from stratal.sources.files import read_events, read_star
from stratal.sources.nested_scan import scan, summary


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratal", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "serve"):
        q = sub.add_parser(name)
        q.add_argument("--data", required=True, help="the events file, or with --table any Arrow or Parquet file")
        q.add_argument("--table", help="the name under which --data is the only table")
        q.add_argument("--threads", type=int, default=4)
        q.add_argument("--spill-dir", help="where Spark spills")
        q.add_argument("--memory-limit-mb", type=int, default=0, help="largest size that a plan may be expected to read")
        q.add_argument("--query-memory-limit-mb", type=int, default=0, help="memory of the Spark driver")
        q.add_argument("--max-result-rows", type=int, default=0)
        if name == "query":
            q.add_argument("--sql")
            q.add_argument("--explain", action="store_true")
            q.add_argument("--stats", action="store_true")
            q.add_argument("--stream-results", action="store_true", help="rows as they come; they always do")
    s = sub.add_parser("scan")
    s.add_argument("--data", required=True)
    s.add_argument("--columns", help="dotted paths, separated by commas")
    s.add_argument("--row-groups", help="numbers separated by commas, or none")
    s.add_argument("--batch-size", type=int, default=4096)
    s.add_argument("--output", help="an Arrow IPC file; it must not exist")
    return p


def _engine(a: argparse.Namespace) -> Engine:
    conf = {"spark__local__dir": a.spill_dir or tempfile.gettempdir()}
    if a.query_memory_limit_mb:
        conf["spark__driver__memory"] = f"{max(512, a.query_memory_limit_mb)}m"
    spark = build_session(f"local[{a.threads}]", shuffle_partitions=a.threads * 2, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    tables: dict[str, DataFrame] = {a.table: read_events(spark, a.data)} if a.table else read_star(spark, a.data)
    for name, df in tables.items():
        engine.register(name, df)
    return engine


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    try:
        if a.command == "scan":
            spark = build_session("local[4]")
            spark.sparkContext.setLogLevel("ERROR")
            groups = None if a.row_groups is None else [] if a.row_groups == "none" else [int(x) for x in a.row_groups.split(",")]
            df = scan(spark, a.data, a.columns.split(",") if a.columns else None, groups)
            rows = write_arrow(df, a.output) if a.output else df.count()
            print(json.dumps({"rows": rows, "columns": df.columns, "row_groups": groups, "bytes": os.path.getsize(a.data) if os.path.isfile(a.data) else None, "leaves": summary(spark, a.data) if os.path.isfile(a.data) else None}))
            return 0
        engine = _engine(a)
        if a.command == "serve":
            Server(engine).serve(sys.stdin, sys.stdout)
            return 0
        prepared = engine.prepare(a.sql or f"SELECT COUNT(*) FROM {a.table or 'events'}")
        if a.explain:
            print(prepared.explain())
            return 0
        df = prepared.execute()
        df = admitted(df, a.memory_limit_mb) if a.memory_limit_mb else df
        began = time.perf_counter()
        rows = write_ndjson(df, sys.stdout, a.max_result_rows or None)
        if a.stats:
            print(json.dumps(told(df, rows, time.perf_counter() - began)), file=sys.stderr)
        return 0
    except (DialectError, ResourceExhausted, FileExistsError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
