"""SNK-4: what a query was planned to read and how, beside what it made."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .serving import scan_size


def told(df: DataFrame, rows: int, seconds: float) -> dict:
    """rows and seconds as measured by the caller, expected bytes, scans and the number of operators."""
    lines = [x.strip(" :+-*()0123456789") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return {"rows": rows, "seconds": round(seconds, 4), "plan_bytes": scan_size(df), "scans": [x[:300] for x in lines if x.startswith(("FileScan", "BatchScan"))], "operators": sum(bool(x) for x in lines)}
