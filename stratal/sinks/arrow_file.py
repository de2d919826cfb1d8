"""SNK-3: a result as one Arrow IPC file that appears whole or not at all and never replaces another."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from stratal.streaming.batches import record_batches


def write_arrow(df: DataFrame, path: str) -> int:
    """Rows written. The file is made under another name beside it, then linked to its own."""
    if os.path.exists(path):
        raise FileExistsError(path)
    staged, n = f"{path}.{uuid.uuid4().hex}.part", 0
    try:
        writer = None
        for batch in record_batches(df):
            if writer is None:
                writer = pa.ipc.new_file(staged, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is None:
            writer = pa.ipc.new_file(staged, df.limit(0).toArrow().schema)
        writer.close()
        os.link(staged, path)
    finally:
        if os.path.exists(staged):
            os.unlink(staged)
    return n
