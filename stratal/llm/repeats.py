"""Repeated byte strings: bucket-pointer refinement of all positions of all texts, dealt over many tasks.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed. As in bucket-pointer
refinement of suffixes, positions first share a bucket if they have the same q-gram, buckets of one member are done, and
the others are refined by what stands at other offsets until their members agree on ``length`` bytes. Here

1. a window's first bucket is its least q-gram (by a hash): it depends on the window alone, and windows that share
   it come in runs, so that runs, not positions, are sorted. A run's identifier is that of the whole string its windows
   cover. Runs with equal identifiers repeat each other; a bucket with a single identifier is done.
2. In the other buckets the run's single windows are sorted by their own identifiers. Of runs that repeat each other
   one takes part, and the outcome of the first step is used for the rest.

Identifiers are 64-bit fingerprints instead of ranks in one array, so tasks need not agree on ranks; two windows count
as equal when theirs are. Texts stay in their blocks; only identifiers travel, each once for a block (see ``blocks``).

Nulls and odd rows: a null text is empty. Strings never cross from one text to another. Texts shorter than ``length``
keep all bytes; rows that repeat, with or without the same doc_id, repeat each other's strings. Removing may cut a
UTF-8 character, so what is kept is binary. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Answer, Block, answered, asked, by_bucket, in_blocks, pack, unpack, with_answers
from .common import written
from .lean import lean
from .shingles import BASE, INVERSE, VALUES, mix, powers

LENGTH, GRAM = 200, 48


class Prints:
    """64-bit fingerprints of any substrings of one byte string, from sums of its prefixes."""

    def __init__(self, data: bytes) -> None:
        x = VALUES[np.frombuffer(data, dtype=np.uint8)]
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        x *= powers(BASE, len(x))
        np.cumsum(x, out=self.sums[1:])
        self.down = powers(INVERSE, len(x) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """Of every substring of that length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, by minima from both ends of runs of that width."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stripes(prints: Prints, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows that share their least q-gram: first and last window, the q-gram, and whether it is tied.

    A window is a string of ``length`` bytes inside one text. Its least q-gram depends on the window alone.
    """
    n, width = int(starts[-1]), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = prints.all(gram)
    least = _least(grams, width)  # of the windows 0 to n - length
    inside = np.zeros(n - length + 2, dtype=np.int32)
    long = np.diff(starts) >= length
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - length + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    first_of_text = np.zeros(len(least), dtype=bool)
    first_of_text[starts[:-1][long]] = True
    begin = np.flatnonzero(ok & (new | first_of_text))
    change = new | first_of_text | ~ok
    ends = np.flatnonzero(change)
    nxt = np.searchsorted(ends, begin, side="right")
    last = np.where(nxt < len(ends), ends[np.minimum(nxt, len(ends) - 1)] - 1, len(least) - 1)
    keys = least[begin]
    return begin, last, keys, np.isin(keys, _tied(least, grams, ok, width))


def _tied(least: np.ndarray, grams: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Least q-grams that stand twice within reach of one run: its windows may repeat each other."""
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = ~_least(~np.concatenate([edge, np.where(ok, least, 0).astype(np.uint64), edge]), width)[: len(grams)]
    at = np.flatnonzero(grams == most)
    order = np.lexsort((at, grams[at]))
    v, x = grams[at][order], at[order]
    return np.unique(v[1:][(v[1:] == v[:-1]) & (np.diff(x) <= 2 * width)])


#: Answers of the first round: the run's windows all repeat; its single windows take part in the second round.
COVERED, OPEN = 1, 2


class _Runs:
    """A block's runs in the order in which the first round asks for them, and then its windows."""

    def __init__(self, block: Block, length: int, gram: int, buckets: int) -> None:
        self.length, self.buckets = length, buckets
        self.prints = Prints(block.bytes)
        first, last, keys, tied = stripes(self.prints, block.starts, length, gram)
        ids = self.prints.of(first, last + length)
        order = np.lexsort((ids, keys))
        self.first, self.last = first[order], last[order]
        keys, ids, tied = keys[order], ids[order], tied[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        self.group = np.cumsum(new) - 1  # of each run: which distinct one it is
        self.heads = np.flatnonzero(new)
        self.keys, self.ids = keys[new], ids[new]
        self.flags = np.minimum(np.diff(np.append(self.heads, len(keys))), 2).astype(np.uint8)
        self.flags |= np.where(tied[new], 4, 0).astype(np.uint8)
        self.order, self.cuts = by_bucket(self.keys, buckets)

    def questions(self) -> list[tuple[int, bytes]]:
        out = []
        for b in np.flatnonzero(np.diff(self.cuts)):
            some = self.order[self.cuts[b] : self.cuts[b + 1]]
            out.append((int(b), pack(self.keys[some], self.ids[some], self.flags[some])))
        return out

    def told(self, answers: Answer) -> np.ndarray:
        """The first round's answer for each distinct run."""
        status = np.zeros(len(self.keys), dtype=np.uint8)
        for b, payload in answers.items():
            if b >= 0:
                status[self.order[self.cuts[b] : self.cuts[b + 1]]] = np.frombuffer(payload, dtype=np.uint8)
        return status

    def windows(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and identifiers of the single windows of open runs: of all runs that aren't covered, of one other."""
        take = (status[self.group] & OPEN) > 0
        dup = np.ones(len(self.group), dtype=bool)
        dup[self.heads] = False
        take &= ~(dup & ((status[self.group] & COVERED) > 0))
        at = _spread(self.first[take], self.last[take] + 1)
        return at, self.prints.of(at, at + self.length)


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges."""
    n = end - start
    total = np.cumsum(n)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - n - start, n)


def _first_answers(payloads: list[bytes]) -> list[bytes]:
    parts = [unpack(p) for p in payloads]
    keys, ids, flags = (np.concatenate([p[i] for p in parts]) for i in range(3))
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((source, ids, keys))
    k, d, f = keys[order], ids[order], flags[order]
    new_key = np.ones(len(k), dtype=bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= d[1:] != d[:-1]
    run, bucket = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    times = np.bincount(run, weights=f & 3)
    kinds = np.bincount(bucket[new])
    tied = np.bincount(bucket, weights=(f & 4) > 0) > 0
    status = np.where(times[run] >= 2, COVERED, 0).astype(np.uint8)
    # one block's run for each identifier takes part: the first
    status |= np.where(((kinds > 1) | tied)[bucket] & (new | (status == 0)), OPEN, 0).astype(np.uint8)
    out = np.empty(len(k), dtype=np.uint8)
    out[order] = status
    return [x.tobytes() for x in np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])]


def _second_answers(payloads: list[bytes]) -> list[bytes]:
    parts = [unpack(p) for p in payloads]
    ids, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, where = np.unique(ids, return_inverse=True)
    again = np.bincount(where, weights=times)[where] >= 2
    return [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(p[0]) for p in parts])[:-1])]


def _window_questions(ids: np.ndarray, buckets: int):
    """Distinct identifiers by bucket, with the payload of each bucket."""
    distinct, where, times = np.unique(ids, return_inverse=True, return_counts=True)
    order, cuts = by_bucket(distinct, buckets)
    some = [(int(b), order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts))]
    return where, [(b, o, pack(distinct[o], np.minimum(times[o], 2).astype(np.uint8))) for b, o in some], len(distinct)


def _finisher(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "lengths", "data")))
                answers = {a["round_bucket"]: a["payload"] for a in batch.column("answers")[i].as_py() or ()}
                runs = _Runs(block, length, gram, buckets)
                status = runs.told(answers)
                at, ids = runs.windows(status)
                where, questions, n = _window_questions(ids, buckets)
                again = np.zeros(n, dtype=bool)
                for b, o, _ in questions:
                    if -b - 1 in answers:
                        again[o] = np.unpackbits(np.frombuffer(answers[-b - 1], dtype=np.uint8), count=len(o)).astype(bool)
                change = np.zeros(len(block.bytes) + 1, dtype=np.int32)
                whole = (status[runs.group] & COVERED) > 0
                np.add.at(change, runs.first[whole], 1)
                np.add.at(change, runs.last[whole] + length, -1)
                if len(at):
                    at = at[again[where]]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                yield _result(block, gone)

    return run


def _result(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    data, spans, kept = np.frombuffer(block.bytes, dtype=np.uint8), [], []
    for a, b in zip(block.starts[:-1], block.starts[1:], strict=True):
        g = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
        spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
        kept.append(data[a:b][~g].tobytes())
    lengths = pa.array(np.diff(block.starts), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), lengths, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


RESULT = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, end exclusive) and kept (the remaining bytes)."""
    blocks = in_blocks(docs, block_bytes)
    buckets = max(8, blocks.count() // 4)

    def first(block: Block, _: Answer) -> list[tuple[int, bytes]]:
        return _Runs(block, length, gram, buckets).questions()

    def second(block: Block, answers: Answer) -> list[tuple[int, bytes]]:
        runs = _Runs(block, length, gram, buckets)
        _, ids = runs.windows(runs.told(answers))
        return [(-b - 1, payload) for b, _, payload in _window_questions(ids, buckets)[1]]

    one = written(answered(asked(blocks, first), _first_answers), "runs")
    two = answered(asked(with_answers(blocks, one), second), _second_answers)
    return with_answers(blocks, one.unionAll(two)).select("ids", "lengths", "data", "answers").mapInArrow(lean(_finisher(length, gram, buckets)), RESULT)
