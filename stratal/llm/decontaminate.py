"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are put into classes by their number of distinct five-word shingles, each class twice as large as the one
before. For a class, documents are seen as windows of at most four times the class's least size, each overlapping half
of the next, so that an item stands against a window not much larger than itself and high containment means a high
Jaccard similarity whatever the document's length. Items and windows have MinHash signatures of ``perms`` values; one
equal value makes a pair of document and item a candidate. At containment 0.8 the similarity is 0.19 at least, and a
pair is missed with a probability below 1e-11. Candidates are verified on words: the share of the item's shingles
that the whole document has must reach the threshold.

An equal MinHash value means that item and window share the very shingle that has it. Windows without a shingle that
is some item's minimum can therefore have no equal value, and no signature is worked out for them.

The items are small beside the documents; they are sent to the executors in parts of at most ``part_bytes`` of text,
each part with one pass over the documents. Documents are neither shuffled nor collected.

Nulls and odd rows: null and empty texts, of documents or items, hold nothing and match nothing. An item of fewer than
five words is one shingle of that length, found where the document has those words in a row. Items that repeat an
item_id or a text are each answered; repeated documents too. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .lean import lean
from .shingles import hashed, joined, mix, pieces, shingled, words

SIZE = 5


def _seeds(perms: int) -> np.ndarray:
    return mix(np.arange(1, perms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each permutation, the shingle that comes first."""
    return h[np.argmin(mix(h[None, :] ^ seeds[:, None]), axis=1)]


class _Index:
    """The items of one part: signatures by size class, and a table that tells most other shingles apart."""

    def __init__(self, items: list[tuple[int, str]], perms: int) -> None:
        self.seeds = _seeds(perms)
        self.items: list[tuple[int, set[tuple[bytes, ...]], int]] = []
        by_class: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            size = min(SIZE, len(ws))
            raw = text.encode("utf-8", "surrogatepass")
            h, _ = shingled(*hashed(raw, np.array([0, len(raw)])), size)
            h = np.unique(h)
            by_class[size, int(math.log2(len(h)))].append((len(self.items), _least(h, self.seeds)))
            self.items.append((item_id, {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}, size))
        self.classes = {}
        self.mask: dict[int, np.ndarray] = {}
        for (size, level), entries in sorted(by_class.items()):
            keys = np.concatenate([self._keyed(sig) for _, sig in entries])
            who = np.repeat([i for i, _ in entries], perms)
            order = np.argsort(keys, kind="stable")
            self.classes[size, level] = (keys[order], who[order])
            least = np.unique(np.concatenate([sig for _, sig in entries]))
            if size not in self.mask:
                self.mask[size] = np.zeros(1 << 22, dtype=bool)
            self.mask[size][(least & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _keyed(self, sig: np.ndarray) -> np.ndarray:
        return mix(sig + self.seeds)

    def candidates(self, h: np.ndarray, near: np.ndarray, size: int) -> set[int]:
        """Items with a MinHash value equal to that of a window of one document. near: places that the table marks."""
        found: set[int] = set()
        for (s, level), (keys, who) in self.classes.items():
            if s != size:
                continue
            half = 1 << (level + 1)
            first = np.unique(np.concatenate([near // half, np.maximum(near // half - 1, 0)]))
            for w in first:
                sig = self._keyed(_least(h[w * half : (w + 2) * half], self.seeds))
                lo, hi = np.searchsorted(keys, sig, "left"), np.searchsorted(keys, sig, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                    found.update(who[a:b].tolist())
        return found


def _searcher(shared, threshold: float, schema: T.StructType):
    names = [f.name for f in schema.fields if f.name != "leaks"]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in pieces(batches, "__text"):
            flat, starts = hashed(*joined(part.column("__text")))
            leaks: list[list[dict]] = [[] for _ in range(part.num_rows)]
            cand: dict[int, set[int]] = defaultdict(set)
            for size, mask in index.mask.items():
                h, own = shingled(flat, starts, size, whole=False)
                hits = np.flatnonzero(mask[(h & np.uint64(len(mask) - 1)).astype(np.int64)])
                begin = np.searchsorted(own, np.arange(part.num_rows + 1))
                for d in np.unique(own[hits]):
                    near = hits[(hits >= begin[d]) & (hits < begin[d + 1])] - begin[d]
                    cand[d] |= index.candidates(h[begin[d] : begin[d + 1]], near, size)
            for d, items in cand.items():
                ws, sets = words(part.column("__text")[int(d)].as_py()), {}
                for i in sorted(items):
                    item_id, shingles, size = index.items[i]
                    if size not in sets:
                        sets[size] = {tuple(ws[j : j + size]) for j in range(len(ws) - size + 1)}
                    n = len(shingles & sets[size])
                    if n and n >= threshold * len(shingles) - 1e-9:
                        leaks[d].append({"item_id": item_id, "n_shingles": len(shingles), "n_found": n})
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(leaks, kind)], names=[*names, "leaks"])

    return search


LEAKS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "n_shingles", "n_found")]))


def with_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, perms: int = 128, part_bytes: int = 1 << 24) -> DataFrame:
    """docs with leaks, an array of item_id, n_shingles (of the item) and n_found for items that reach the threshold."""
    spark = docs.sparkSession
    own = [f for f in docs.schema.fields if f.name not in ("leaks", "__text", "__leaks")]
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where(F.col("text") != "")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = math.ceil(total / part_bytes) or 1
    found = docs.select(*[F.col(f"`{f.name}`") for f in own])
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        index = _Index([(r[0], r[1]) for r in mine.collect()], perms)  # at most about part_bytes of text
        shared = spark.sparkContext.broadcast(index)
        before = [T.StructField("__leaks", LEAKS)] if part else []
        rows = found.withColumnRenamed("leaks", "__leaks") if part else found
        kind = T.StructType([*own, *before, T.StructField("leaks", LEAKS)])
        found = rows.withColumn("__text", text_of()).mapInArrow(lean(_searcher(shared, threshold, kind)), kind)
        if part:
            found = found.withColumn("leaks", F.concat("__leaks", "leaks")).drop("__leaks")
    return found


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, perms: int = 128, part_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment of all pairs that reach the threshold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_leaks(rows, items, threshold, perms, part_bytes).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
