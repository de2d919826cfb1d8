"""Texts in blocks of bounded size, and questions that blocks put to buckets of keys.

A block is one row: its number, its rows' keys and its texts, compressed. Written once, it is the same block in every
later pass, whatever task reads it; the table is bucketed by block, so that answers come to the blocks and not the
other way round. In a round each block deals keys out to buckets by hash, sorted and each key once;
a bucket's task sees all blocks' keys of that bucket and answers each block in the block's own order. So the shuffle
holds each key once for a block, without row overhead, and answers need no keys at all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, text_of
from .lean import lean

Answer = dict[int, bytes]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed where that helps."""
    head = struct.pack("<i", len(arrays))
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        head += struct.pack("<4sq", raw.dtype.str[1:].encode().ljust(4), len(raw))
        out.append(raw.tobytes())
    return head + b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, kinds = struct.unpack_from("<i", data), 4, []
    for _ in range(n):
        kinds.append(struct.unpack_from("<4sq", data, at))
        at += 12
    out = []
    for kind, size in kinds:
        dtype = np.dtype(kind.decode().strip())
        out.append(np.frombuffer(data, dtype=dtype, count=size, offset=at))
        at += size * dtype.itemsize
    return out


def _cutter(limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            data = squeeze.compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["ids", "lengths", "data"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and size + len(raw) > limit:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield block()

    return cut


def in_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """docs (doc_id, text) as a written table of blocks of about ``limit`` bytes: block, ids, lengths, data."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cut = rows.mapInArrow(lean(_cutter(limit)), "ids array<bigint>, lengths array<bigint>, data binary")
    return placed(cut.withColumn("block", F.monotonically_increasing_id()), "blocks", "block")


class Block:
    """One block's rows: ids (with None), starts of the texts and then their end, and the joined bytes."""

    def __init__(self, ids: list[int | None], lengths: list[int], data: bytes) -> None:
        self.ids = ids
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.bytes = zstandard.ZstdDecompressor().decompress(data) if self.starts[-1] else b""


def _asker(ask: Callable[[Block, list[bytes]], list[tuple[int, bytes]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("answers").to_pylist() if "answers" in batch.schema.names else [None] * batch.num_rows
            for i, number in enumerate(batch.column("block").to_pylist()):
                block = Block(batch.column("ids")[i].as_py(), batch.column("lengths")[i].as_py(), batch.column("data")[i].as_py())
                out = ask(block, {a["round_bucket"]: a["payload"] for a in told[i] or ()})
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "block", "payload"])

    return run


def _answerer(answer: Callable[[list[bytes]], list[bytes]]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out = answer(table.column("payload").to_pylist())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())}, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())]))

    return run


def asked(blocks: DataFrame, ask: Callable[[Block, Answer], list[tuple[int, bytes]]]) -> DataFrame:
    """What blocks send to buckets: bucket, block, payload."""
    return blocks.mapInArrow(lean(_asker(ask)), "bucket int, block long, payload binary")


def answered(requests: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each bucket's answers, one for each payload in the order given: block, bucket, payload."""
    return requests.groupBy("bucket").applyInArrow(_answerer(answer), "block long, bucket int, payload binary")


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """blocks with a column answers; blocks without any keep an empty one."""
    told = answers.groupBy("block").agg(F.collect_list(F.struct(F.col("bucket").alias("round_bucket"), "payload")).alias("answers"))
    return blocks.drop("answers").join(told, "block", "left")


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys by bucket and within, and where each bucket starts in it (then the end)."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
