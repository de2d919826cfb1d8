"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The piece file is read without training anything. Pieces of a unigram model keep their log scores; a model that
orders its pieces by merges has ranks for scores, from which log scores follow by Zipf's rule: minus the logarithm of
rank + 2.7. Spaces become markers, one is put in front; the best segmentation of a text is the one with the highest
sum of scores, among equals the one whose later pieces are longest. A character that no piece covers costs ten more
than the worst piece and becomes its UTF-8 bytes as byte pieces; so do marker characters of the text itself, which
makes decoding return every text unchanged.

No piece crosses from another character to a marker, so texts fall into chunks of markers and what follows them,
each segmented on its own; chunks met before are remembered up to a bound. New chunks are segmented together: all
places of all of them walk the trie at once, a byte a step, and the best sums are passed on from place to place in
step. Chunks of more than ``_LONG`` characters are segmented one by one, to the same result. A model with pieces that do
cross is segmented as a whole. Of the model's normaliser only the dummy prefix is read: no character is changed, no
white space removed, so that decoding gives back the text.

Nulls and odd rows: a null text counts as the empty text; both have no ids and decode to the empty text. Ids outside
the model raise an error in decoding, control ids decode to nothing, bytes that are not UTF-8 to the replacement
character. Repeated rows are each encoded; empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .lean import lean
from .shingles import pieces as cut

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
_LONG = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces with log scores and kinds, by id."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    #: Tells models apart; without one a codec is not kept.
    key: str = ""

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        out, unigram = cls([], [], [], key=hashlib.sha256(model).hexdigest()), False
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append(f.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                out.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                out.dummy_prefix = bool(dict(_fields(value)).get(3, 1))
        if not unigram:
            first = next((i for i, k in enumerate(out.kinds) if k == NORMAL), 0)
            out.scores = [-float(np.log(max(0, i - first) + 2.7)) for i in range(len(out.pieces))]
        return out


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        place, free, todo = {0: 0}, 1, [0]
        top = 0  # the highest place taken
        check[0] = 0
        while todo:
            node = todo.pop()
            s = place[node]
            value[s] = ends[node]
            if not children[node]:
                continue
            labels = sorted(children[node])
            while check[free] != -1:
                free += 1
            # an only child fills the first hole; several try a few places near the top, then go beyond it
            b = free - labels[0] - 1
            if len(labels) > 1:
                b = max(0, top - 48 - labels[0])
                b = next((x for x in range(b, b + 48) if x + labels[-1] + 1 < size and all(check[x + y + 1] == -1 for y in labels)), max(0, top - labels[0]))
            top = max(top, b + labels[-1] + 1)
            if top + 600 > size:
                base += [0] * (top + 600)
                check += [-1] * (top + 600)
                value += [-1] * (top + 600)
                size = len(base)
            base[s] = b
            for x in labels:
                check[b + x + 1] = s
                place[children[node][x]] = b + x + 1
                todo.append(children[node][x])
        check[0] = -2  # nothing leads back to the root
        # every look-up stays inside: base is -256 at least, and a negative place is one of the last
        self.base, self.check, self.value = base + [0] * 258, check + [-1] * 258, value + [-1] * 258


class Codec:
    """Encodes and decodes single texts; remembers chunks up to ``bound`` of them."""

    def __init__(self, vocabulary: Vocabulary, bound: int = 200_000) -> None:
        v = self.vocabulary = vocabulary
        usable = {i: p for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.usable = usable
        self.scores = v.scores
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], dtype=np.int32)
        self.lost = min(v.scores[i] for i in usable) - 10.0
        self.crosses = any(MARK in p.lstrip(MARK) for p in usable.values())
        # what each id decodes to: control ids nothing, the unknown id a replacement character
        spelt = {NORMAL: lambda p: p.replace(MARK, " ").encode(), USER: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: "�".encode()}
        self.spelt = pa.array([spelt.get(k, lambda p: b"")(p) for p, k in zip(v.pieces, v.kinds, strict=True)], pa.large_binary())
        self.bound, self.known = bound, {}

    @cached_property
    def trie(self) -> DoubleArray:
        return DoubleArray({p.encode(): i for i, p in self.usable.items()})

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The trie's base, check and value, and the scores."""
        t = self.trie
        return *(np.array(x, dtype=np.int32) for x in (t.base, t.check, t.value)), np.array(self.scores, dtype=np.float64)

    def _arcs(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every piece in joined chunks, -1 for a character without one. stop: of each byte, the
        end of its chunk."""
        base, check, value, _ = self.arrays
        first = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(first[1:], len(data))
        starts, state, at = first, np.zeros(len(first), dtype=np.int32), first
        single, found = np.zeros(len(data) + 1, dtype=bool), []
        last = np.zeros(len(data) + 1, dtype=np.int64)
        last[first] = ends
        while len(starts):
            to = base[state] + data[at] + 1
            ok = check[to] == state
            starts, state, at = starts[ok], to[ok], at[ok] + 1
            piece = value[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((starts[hit], at[hit], piece[hit]))
            single[starts[hit][last[starts[hit]] == at[hit]]] = True
            go = at < stop[starts]
            starts, state, at = starts[go], state[go], at[go]
        bare = first[~single[first]]
        found.append((bare, last[bare], np.full(len(bare), -1, dtype=np.int32)))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _best_of_each(self, chunks: list[str]) -> list[bytes]:
        """Viterbi over many chunks, whose spaces stand for markers: the ids of each as 32-bit integers."""
        raws = [self._raw(c) for c in chunks]
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        data, ends = np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum(sizes)
        chunk = np.repeat(np.arange(len(raws)), sizes)
        start, end, piece = self._arcs(data, ends[chunk])
        place = start - (ends - sizes)[chunk[start]]
        order = np.argsort(place.astype(np.uint16), kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        gain = np.where(piece >= 0, self.arrays[3][piece], self.lost)
        # each chunk has a place more than bytes, so that its end is not the next one's start
        a, b = start + chunk[start], end + chunk[start]
        best, back = np.full(len(data) + len(raws), -1e300), np.full(len(data) + len(raws), -1, dtype=np.int64)
        best[ends - sizes + np.arange(len(raws))] = 0.0
        cuts = np.searchsorted(place, np.arange(int(place[-1]) + 2 if len(place) else 1))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            # arcs from the same place of a chunk end in different places
            to, sums = b[x:y], best[a[x:y]] + gain[x:y]
            better = np.flatnonzero(sums > best[to])
            best[to[better]], back[to[better]] = sums[better], better + x
        here, whose, steps = ends + np.arange(len(raws)), np.arange(len(raws)), []
        while len(whose):
            arc = back[here]
            go = arc >= 0
            arc, whose = arc[go], whose[go]
            steps.append((whose, arc))
            here = a[arc]
        whose, arc = (np.concatenate([s[i] for s in steps]) for i in range(2))
        order = np.argsort(whose, kind="stable")
        whose, arc = whose[order][::-1], arc[order][::-1]  # chunks backwards, pieces forwards
        order = np.argsort(whose, kind="stable")
        whose, arc = whose[order], arc[order]
        width = np.where(piece[arc] >= 0, 1, end[arc] - start[arc])
        ids = np.repeat(piece[arc], width)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            which = np.repeat(np.arange(len(arc)), width)[bare]
            at = start[arc[which]] + bare - (np.cumsum(width) - width)[which]
            raw = data[at].copy()
            mark = np.frombuffer(MARK.encode(), dtype=np.uint8)
            own = data[start[arc[which]]] == 0xF5
            raw[own] = mark[(at - start[arc[which]])[own]]
            ids[bare] = self.byte_ids[raw]
        out, cut = ids.astype("<i4").tobytes(), 4 * np.concatenate([[0], np.cumsum(np.bincount(whose, weights=width, minlength=len(raws)))]).astype(np.int64)
        cut = cut.tolist()
        return [out[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]

    @staticmethod
    def _raw(chunk: str) -> bytes:
        # a marker of the text itself becomes bytes that no piece has
        if MARK in chunk:
            return b"\xf5\x80\x80".join(x.replace(" ", MARK).encode("utf-8", "surrogatepass") for x in chunk.split(MARK))
        return chunk.replace(" ", MARK).encode("utf-8", "surrogatepass")

    def _best(self, chunk: str) -> list[int]:
        """Viterbi over one chunk, whose spaces stand for markers."""
        base, check, value, scores, lost = self.trie.base, self.trie.check, self.trie.value, self.scores, self.lost
        raw = self._raw(chunk)
        n = len(raw)
        best, start, piece = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            lead = raw[i]
            if 0x80 <= lead < 0xC0:
                continue
            at, state, j = best[i], 0, i
            end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 or lead == 0xF5 else 4)
            single = False
            while j < n:
                to = base[state] + raw[j] + 1
                if check[to] != state:
                    break
                state = to
                j += 1
                k = value[to]
                if k >= 0:
                    if j == end:
                        single = True
                    s = at + scores[k]
                    if s > best[j]:
                        best[j], start[j], piece[j] = s, i, k
            if not single and at + lost > best[end]:
                best[end], start[end], piece[end] = at + lost, i, -1
        out: list[int] = []
        while n:
            i, k = start[n], piece[n]
            if k >= 0:
                out.append(k)
            else:
                out += [self.bytes[b] for b in reversed(MARK.encode() if raw[i] == 0xF5 else raw[i:n])]
            n = i
        out.reverse()
        return out

    def encode(self, text: str | None) -> bytes:
        """The text's ids as 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        prefix = " " if self.vocabulary.dummy_prefix else ""
        if self.crosses:
            return [np.array(self._best(prefix + t), dtype=np.int32).tobytes() if t else b"" for t in texts]
        known, cut = self.known, [self._chunks(prefix + t) if t else [] for t in texts]
        if len(known) > self.bound:
            known.clear()
        new = list(set().union(*cut).difference(known))
        short = [c for c in new if len(c) <= _LONG]
        known.update(zip(short, self._best_of_each(short), strict=True)) if short else None
        long = {c: np.array(self._best(c), dtype=np.int32).tobytes() for c in new if len(c) > _LONG}
        if long:
            return [b"".join([long.get(c) or known[c] for c in chunks]) for chunks in cut]
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Runs of spaces with what follows them; what stands before the first space is a chunk of its own."""
        if "  " not in text and text[0] == " ":
            return [" " + x for x in text[1:].split(" ")]
        return _CHUNK.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of joined ids; ends: where each text's ids begin, and the end of the last."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.spelt)):
            raise ValueError("an id is outside the model")
        if not len(ids):
            return [""] * (len(ends) - 1)
        spelt = self.spelt.take(pa.array(ids))
        places, data = np.frombuffer(spelt.buffers()[1], dtype=np.int64)[spelt.offset :], spelt.buffers()[2]
        whole, cut = (data.to_pybytes() if data is not None else b""), places[ends].tolist()
        skip = self.vocabulary.dummy_prefix
        return [whole[a + 1 if skip and whole[a:b].startswith(b" ") else a : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary.read(f.read())


#: The codec of the model that this worker used last, with the chunks that it remembers.
_KEPT: dict[str, Codec] = {}


def codec_of(vocabulary: Vocabulary) -> Codec:
    if vocabulary.key not in _KEPT:
        _KEPT.clear()
        codec = Codec(vocabulary)
        if not vocabulary.key:
            return codec
        _KEPT[vocabulary.key] = codec
    return _KEPT[vocabulary.key]


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for part in cut(batches, "__text"):
            ids = codec.encode_all(part.column("__text").to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            keep = [n for n in part.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], lists], names=[*keep, "ids"])

    return run


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = pa.array(codec.decode_all(flat[ends[0] : ends[-1]], ends - ends[0]), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with a column ids, an array of integers."""
    own = [f for f in docs.schema.fields if f.name not in ("ids", "__text")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], text_of().alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return rows.mapInArrow(lean(_encoder(shared)), T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows with a column decoded, the text of the column ids; null ids count as none."""
    own = [f for f in rows.schema.fields if f.name != "decoded"]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.select(*[F.coalesce("ids", F.array().cast("array<int>")).alias("ids") if f.name == "ids" else F.col(f"`{f.name}`") for f in own])
    return rows.mapInArrow(lean(_decoder(shared)), T.StructType([*own, T.StructField("decoded", T.StringType())]))


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with ids and decoded, both made in one pass of one worker."""
    own = [f for f in docs.schema.fields if f.name not in ("ids", "decoded", "__text")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], text_of().alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoder(shared)(_encoder(shared)(batches))

    return rows.mapInArrow(lean(run), T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
