"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers something about; beyond, it starts afresh.
CACHE = 250_000
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased, split at the space and the control characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step % (1 << 64)
    return out[:n]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A value for each byte, the same for upper and lower case of A-Z.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = VALUES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Powers that have been worked out, up and down.
_KNOWN: list[np.ndarray] = [powers(BASE, 1), powers(INVERSE, 1)]
_RUN = 1 << 20


def hashed(data: bytes | np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of joined texts, and where each text's words begin among them (then the end).

    starts: where each text begins in data, then the end. A hash is the sum of the bytes' values times powers of a base,
    from sums over a run of texts, so no word becomes an object. Texts are taken in runs of about a megabyte.
    """
    flat = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    out, counts, at, n = [np.zeros(0, np.uint64)], [], 0, len(starts) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _RUN, side="right")) - 1)
        h, c = _hashed_run(flat[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
        out.append(h)
        counts.append(c)
        at = to
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype(np.int64)


def _hashed_run(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(flat)
    if len(_KNOWN[0]) <= size:
        _KNOWN[:] = [powers(BASE, size + size // 4 + 1), powers(INVERSE, size + size // 4 + 1)]
    word = np.zeros(size + 2, dtype=bool)
    word[1:-1] = _WORD[flat]
    edge = np.zeros(size + 1, dtype=bool)  # a text begins here
    edge[starts] = True
    first = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_LOWER[flat] * _KNOWN[0][:size], out=sums[1:])
    h = mix((sums[end] - sums[first]) * _KNOWN[1][first] + (end - first).astype(np.uint64))
    return h, np.diff(np.searchsorted(first, starts))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and where each text begins in them (then the end); nulls are empty."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]] if len(ends) else flat[:0], ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def shingled(h: np.ndarray, starts: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of concatenated texts and the text that each belongs to.

    h: word hashes of all texts; starts: where each text begins, then the end. whole: a text of fewer words than
    size is one shingle.
    """
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(h) - size + 1
    if n > 0:
        x = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            x = (x + h[j : j + n]) * (_M + np.uint64(2 * j))
        inside = owner[:n] == owner[size - 1 :]
        out, own = mix(x[inside]), owner[:n][inside]
    else:
        out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths < size)) if whole else ()
    if len(short):
        extra = []
        for d in short:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for j, v in enumerate(h[starts[d] : starts[d + 1]]):
                    x = (x + v) * (_M + np.uint64(2 * j))
            extra.append(x ^ np.uint64(size - int(lengths[d])))
        out, own = np.concatenate([out, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text each; one text is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
