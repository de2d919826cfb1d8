"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it.

A tokenizer's pattern cuts a text into pre-tokens, each encoded on its own. A tree's leaves are runs of pre-tokens
with their numbers of characters and tokens; every inner node has the sums of its two children. An edit finds its
first leaf by the sums of characters, steps back where the pattern may have looked past the leaf's end (``CONTEXT``
characters), and cuts the new text from there until a pre-token ends where an old leaf ended behind the edit. From there
on nothing has changed. Only the leaves between are encoded again; their sums are replaced along the paths to the root.
Leaves that have grown are split and the tree laid out again from known sums.

Nulls and odd rows: a null text is the empty text, of no tokens. An edit replaces code points start to end
(exclusive); places outside the text mean its ends, a reversed range nothing but an insertion at its start, null edits
and null replacements nothing. Edits of one document apply one after another. Rows that repeat are each counted;
empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .lean import lean
from .shingles import pieces

# Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past a pre-token's end that the pattern may look at.
CONTEXT = 3
#: Pre-tokens in a leaf.
LEAF = 32

TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class Counter:
    """Tokens of single pre-tokens, the common ones remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, bound: int = 200_000) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.bound, self.known = regex.compile(pattern), bound, {}

    def counts(self, parts: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return np.fromiter(map(known.__getitem__, parts), dtype=np.int32, count=len(parts))


def _leaves(parts: list[str], counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of runs of LEAF pre-tokens."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(0, len(parts), LEAF)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.add.reduceat(lengths, at), np.add.reduceat(counter.counts(parts).astype(np.int64), at)


class Tree:
    """Sums of characters and tokens over a document's leaves; node 1 is the root, 2n and 2n + 1 are n's children."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, (max(1, self.n) - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.width), dtype=np.int64)
        self.sums[0, self.width : self.width + self.n] = chars
        self.sums[1, self.width : self.width + self.n] = tokens
        level = self.width
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2
        self.recounted = 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        return cls(*_leaves(counter.pattern.findall(text), counter))

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> np.ndarray:
        return self.sums[:, self.width : self.width + self.n]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (or the last), and the place where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.sums[0, node] <= place and self.sums[0, node + 1]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def edit(self, text: str, start: int, end: int, replacement: str, counter: Counter) -> str:
        """The edited text; the tree follows."""
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        new = text[:start] + replacement + text[end:]
        shift = len(new) - len(text)
        leaf, at = self.find(max(0, start - CONTEXT)) if self.n else (0, 0)
        while leaf and at + CONTEXT > start:  # the leaf before may have looked past its end
            leaf -= 1
            at -= int(self.sums[0, self.width + leaf])
        last, until, parts, place = leaf, at, [], at
        if self.n:
            until += int(self.sums[0, self.width + leaf])
        for m in counter.pattern.finditer(new, at):
            parts.append(m[0])
            place = m.end()
            while last < self.n - 1 and (until < end or until + shift < place):
                last += 1
                until += int(self.sums[0, self.width + last])
            if until >= end and place == until + shift and place >= start + len(replacement):
                break
        else:
            last = self.n - 1
        self.recounted += place - at
        chars, tokens = _leaves(parts, counter)
        held = max(1, last - leaf + 1)
        if self.n and len(chars) <= held:
            for i in range(held):
                self._set(leaf + i, *((int(chars[i]), int(tokens[i])) if i < len(chars) else (0, 0)))
        else:
            old, done = self.leaves(), self.recounted
            self.__init__(np.concatenate([old[0, :leaf], chars, old[0, last + 1 :]]), np.concatenate([old[1, :leaf], tokens, old[1, last + 1 :]]))
            self.recounted = done
        return new


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _builder(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for part in pieces(batches, text):
            leaves = [_leaves(counter.pattern.findall(t), counter) for t in part.column(text).to_pylist()]
            tree = pa.StructArray.from_arrays([pa.array([x[n] for x in leaves], pa.list_(pa.int32())) for n in (0, 1)], names=["chars", "tokens"])
            total = pa.array([int(x[1].sum()) for x in leaves], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, tree, total], names=[*part.schema.names, "tree", "n_tokens"])

    return run


def _editor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for part in pieces(batches, "text"):
            texts, trees, counts, work = [], [], [], []
            for text, tree, edits in zip(part.column("text").to_pylist(), part.column("tree"), part.column("edits").to_pylist(), strict=True):
                t = Tree(tree["chars"].values.to_numpy(), tree["tokens"].values.to_numpy())
                for e in edits or ():
                    if e and None not in e.values():
                        text = t.edit(text, e["start"], e["end"], e["replacement"], counter)
                texts.append(text)
                trees.append(t.leaves())
                counts.append(t.tokens)
                work.append(t.recounted)
            keep = [n for n in part.schema.names if n not in ("text", "tree", "edits", "n_tokens")]
            tree = pa.StructArray.from_arrays([pa.array([x[n] for x in trees], pa.list_(pa.int32())) for n in (0, 1)], names=["chars", "tokens"])
            cols = [pa.array(texts, pa.string()), tree, pa.array(counts, pa.int64()), pa.array(work, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], *cols], names=[*keep, "text", "tree", "n_tokens", "recounted"])

    return run


def with_trees(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """docs with tree (the leaves' sums) and n_tokens."""
    own = [f for f in docs.schema.fields if f.name not in ("tree", "n_tokens")]
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    rows = docs.select(*[text_of().alias("text") if f.name == "text" else F.col(f"`{f.name}`") for f in own])
    return rows.mapInArrow(lean(_builder(shared, "text")), T.StructType([*own, T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType())]))


def edited(rows: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """rows of with_trees with a column edits (EDITS): the edited text, its tree and n_tokens, and recounted, the
    characters that were encoded again."""
    own = [f for f in rows.schema.fields if f.name not in ("text", "tree", "edits", "n_tokens", "recounted")]
    shared = rows.sparkSession.sparkContext.broadcast((ranks, pattern))
    out = [*own, T.StructField("text", T.StringType()), T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType()), T.StructField("recounted", T.LongType())]
    cols = [text_of().alias("text") if f.name == "text" else F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in ("n_tokens", "recounted")]
    return rows.select(*cols).mapInArrow(lean(_editor(shared)), T.StructType(out))
