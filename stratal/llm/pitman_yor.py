"""Language-model scoring: a hierarchical Pitman-Yor model of words after two words, its seatings sampled by Gibbs.

Restaurants stand on four levels. Every pair of context words has one, whose customers are the words that follow; the
tables of all pairs with the same second word are customers of that word's restaurant, which they share as parent; the
tables of all of these are customers of one restaurant for the whole corpus; its tables come from the base, uniform
over the known words and one more. Pairs whose second word is common (``common`` of all tokens or more) share one of
``PARTS`` parents, by hash of the first word, so that no family of restaurants grows with the corpus unsplit.

Gibbs sampling draws the number of tables of every dish from its conditional distribution, with the seatings of the
dish's customers summed out: t tables of c customers weigh S(c, t) times (discount * x) ** t times the parent's
probabilities of t draws, where S are generalised Stirling numbers. x, a Gamma variable of shape strength / discount +
tables, makes the dishes of one restaurant independent without changing the distribution of their tables: the
restaurant's factor of its number of tables is the integral over x. So all dishes are drawn at once, and each draw
is as if its customers had been seated one by one. Levels take turns: pairs given their parents' predictive (without
the dish's own customers), then the parents given the corpus restaurant's. While these are sampled that one predicts a
word's share of all training tokens; then it is sampled itself, from the tables of all others. After ``burn`` sweeps,
predictive probabilities are averaged over ``samples`` sweeps, level by level; on the second level weighted by the
customers there. S comes from its recursion up to ``ROWS`` customers and from the contour integral of its generating
function beyond.

Random numbers are hashes of words, contexts and sweeps, and all sums are of whole numbers: scores do not depend on the
order of rows, the blocks or the number of buckets.

Counts are gathered from all training documents: blocks of text deal their distinct word triples out by the parent (see
``blocks``) and get each restaurant's averages back. Words are counted first, over all blocks, and numbered: by hash into
``SHARDS``, and within each by frequency, so that numbers are the same in every layout and frequent words have small ones.
A word's share travels as a logarithm in 8 bits, within five percent; the base score and the probabilities use whole counts.

Nulls and odd rows: a null or empty text is the end token alone. Documents outside the training fold are scored
only. Without any training document all probabilities are the base's. Rows that repeat are counted and scored each;
other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Answer, Block, answered, asked, in_blocks, pack, unpack, with_answers
from .common import forget, written
from .lean import lean
from .shingles import hashed, mix

PARTS = 64
ROWS = 2048
NODES = 64
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_OFFSET = 1 << 24  # numbers of the second round's buckets are below minus this
_STEP = 0.1  # of the logarithm of a word's share
SHARDS = 4096
_ID = 5  # bytes of a word's number
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(*arrays))


def _spread_out(data: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(data))


def _planes(x: np.ndarray, n: int = 5) -> np.ndarray:
    """Whole numbers as their lowest bytes, then the next, up to n: what small numbers compress well in."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).ravel()


def _whole(x: np.ndarray, n: int = 5) -> np.ndarray:
    planes = x.reshape(n, -1)
    out = planes[0].astype(np.int64)
    for k in range(1, n):
        if planes[k].any():
            out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _packed(x: np.ndarray, low: int) -> np.ndarray:
    """Sorted numbers that hold a value, and in their lowest bits its place. Sorting them takes a fraction of the time
    of sorting places by value."""
    out = x << np.uint64(low)
    out |= np.arange(len(x), dtype=np.uint64)
    out.sort()
    return out


def _order(x: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of whole numbers from 0 to 2 ** bits - 1."""
    low = max(1, len(x).bit_length())
    if bits + low > 64:
        return np.argsort(x, kind="stable")
    out = _packed(x.astype(np.uint64, copy=False), low)
    out &= np.uint64((1 << low) - 1)
    return out.view(np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct whole numbers of 0 or more in order, where each first stands, and each number's place among them. Where
    value and place need more than 64 bits, the highest bits of the value are tried first."""
    if not len(x):
        return x, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    u = x.view(np.uint64)
    low = max(1, len(x).bit_length())
    drop = max(0, int(u.max()).bit_length() + low - 64)
    order = _packed(u >> np.uint64(drop) if drop else u, low)
    found = None if drop else order >> np.uint64(low)
    order &= np.uint64((1 << low) - 1)
    order = order.view(np.int64)
    if found is None:
        found = u[order]
        if (found[1:] < found[:-1]).any():  # values that differ in their lowest bits alone
            order = np.argsort(u, kind="stable")
            found = u[order]
    new = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    inverse = np.empty(len(x), dtype=np.int64)
    place = np.cumsum(new)
    place -= 1
    inverse[order] = place
    return found[new].view(x.dtype), order[new], inverse


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


# random draws


def uniform(key: np.ndarray, n: int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, that follow from keys; n tells several of one key apart."""
    return ((mix(key + np.uint64(n * int(_GOLD) % 2**64)) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variables of shapes of 1 or more, by squeezing a cubed normal one."""
    d = shape - 1 / 3
    out, todo, n = np.zeros(len(shape)), np.arange(len(shape)), 1
    while len(todo):
        k = key[todo]
        x = np.sqrt(-2 * np.log(uniform(k, n))) * np.cos(2 * np.pi * uniform(k, n + 1))
        v = (1 + x / np.sqrt(9 * d[todo])) ** 3
        positive = np.maximum(v, 1e-300)
        ok = (v > 0) & (np.log(uniform(k, n + 2)) < 0.5 * x * x + d[todo] * (1 - v + np.log(positive)))
        out[todo[ok]] = d[todo[ok]] * v[ok]
        todo, n = todo[~ok], n + 3
    return out


@lru_cache(maxsize=2)
def stirling(discount: float) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers: row c holds those of 1 to c tables."""
    rows = [np.zeros(0), np.zeros(1)]
    for c in range(1, ROWS):
        with np.errstate(divide="ignore"):
            stay = np.append(rows[c] + np.log(c - discount * np.arange(1, c + 1)), -np.inf)
        rows.append(np.logaddexp(stay, np.concatenate([[-np.inf], rows[c]])))
    return rows


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def stirling_far(c: int | np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same for many customers (one number, or one for each t), as the integral of the generating function
    (1 - (1 - z) ** discount) ** t along the parabola 1 - z = e * (1 + iu) ** 2 through its saddle point, or further from
    the branch at 1 for few tables."""
    c = np.broadcast_to(np.asarray(c, dtype=float), t.shape)
    want = np.log(np.maximum(c / t, 1 + 1e-12))
    # s = -log(1 - z); the mean size of a table at the saddle point is c / t
    log_mean = lambda s: np.log(discount) + np.log(-np.expm1(-s)) + s * (1 - discount) - np.log(-np.expm1(-discount * s))
    low, high = np.full(len(t), 1e-12), (want + math.log(2 / discount)) / (1 - discount) + 5
    for _ in range(36):  # any point near it will do
        s = (low + high) / 2
        more = log_mean(s) < want
        low, high = np.where(more, s, low), np.where(more, high, s)
    s = np.minimum(s, np.log(c / 4))  # few tables: the power of z falls off at about 1 / c
    mean, e, z = np.exp(log_mean(s)), np.exp(-s), -np.expm1(-s)
    spread = np.maximum(t * mean * (1 + (1 - discount) * np.expm1(s) - mean), 1e-9)
    width = np.minimum(z / (2 * e * np.sqrt(spread)), 1 / np.sqrt(2 * c * e))
    step = 14 * width / NODES
    v = 1 + 1j * step[:, None] * np.arange(NODES)
    at_saddle = t * np.log(-np.expm1(-discount * s)) - (c + 1) * np.log(z)
    f = t[:, None] * np.log(1 - (e**discount)[:, None] * v ** (2 * discount)) - (c + 1)[:, None] * np.log(1 - e[:, None] * v * v)
    real = (np.exp(f - at_saddle[:, None]) * v).real
    total = (real.sum(axis=1) - 0.5 * real[:, 0]) * step * 2 * e / np.pi
    return _LGAMMA(c + 1) - _LGAMMA(t + 1) - t * math.log(discount) + at_saddle + np.log(np.maximum(total, 1e-300))


def _far(c: int, log_a: float, log_h: float, alpha: float, beta: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables of a dish of many customers, and the sums of their weights; see drawn. beta below 0: no alpha."""
    return next(_far_each(*(np.array([x]) for x in (c, log_a, log_h, alpha, beta)), discount))


def _far_each(c: np.ndarray, log_a: np.ndarray, log_h: np.ndarray, alpha: np.ndarray, beta: np.ndarray, discount: float, known: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_far for each of many dishes. known: rows of Stirling numbers that earlier calls met in their search."""
    for x in range(0, len(c), 256):
        yield from _far_at_once(*(y[x : x + 256].astype(float) for y in (c, log_a, log_h, alpha, beta)), discount, {} if known is None else known)


def _far_at_once(c: np.ndarray, log_a: np.ndarray, log_h: np.ndarray, alpha: np.ndarray, beta: np.ndarray, discount: float, known: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    def numbers(t: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Stirling numbers for rows of t between the same ends, with those that are not known yet added."""
        keys = list(zip(c[some].tolist(), t[:, 0].tolist(), t[:, -1].tolist(), [t.shape[1]] * len(some), strict=True))
        new = np.array([i for i, k in enumerate(keys) if k not in known], dtype=np.int64)
        if len(new):
            rows = stirling_far(np.repeat(c[some[new]], t.shape[1]), t[new].ravel(), discount).reshape(-1, t.shape[1])
            known.update((keys[i], row) for i, row in zip(new.tolist(), rows, strict=True))
        return np.array([known[k] for k in keys]).ravel()

    def weight(t: np.ndarray, some: np.ndarray, search: bool = False) -> np.ndarray:
        """A row of numbers of tables for each of some dishes."""
        each = np.repeat(some, t.shape[1])
        flat, h, a, b = t.ravel(), log_h[each], alpha[each], beta[each]
        plain = b < 0
        out = (numbers(t, some) if search else stirling_far(c[each], flat, discount)) + flat * log_a[each] + h
        out[plain] += (flat[plain] - 1) * h[plain]
        flat, a, b = flat[~plain], a[~plain], b[~plain]
        if len(flat):
            out[~plain] += _LGAMMA(a + flat) - _LGAMMA(a + 1) - _LGAMMA(b + flat) + _LGAMMA(b + 1)
        return out.reshape(t.shape)

    low, high = np.ones(len(c)), c.copy()
    todo = np.flatnonzero(high - low > 64)
    while len(todo):  # the weights have one peak
        t = np.linspace(low[todo], high[todo], 17, axis=1)
        k, row = np.argmax(weight(t, todo, True), axis=1), np.arange(len(todo))
        low[todo], high[todo] = t[row, np.maximum(0, k - 1)], t[row, np.minimum(16, k + 1)]
        wide = high[todo] - low[todo]
        todo = todo[(wide >= 0.02 * high[todo]) & (wide > 64)]
    every = np.arange(len(c))
    top = (low + high) / 2
    step = np.maximum(1.0, 0.01 * top)
    bend = -(weight(np.stack([np.maximum(1.0, top - step), top, np.minimum(c, top + step)], axis=1), every, True) @ np.array([1, -2, 1.0])) / step**2
    reach = 9 / np.sqrt(np.maximum(bend, 1e-12)) + (high - low) + 20
    first, last = np.maximum(1.0, np.floor(top - reach)), np.minimum(c, np.ceil(top + reach))
    # the logarithms are smooth: a polynomial through 25 of them gives the others, where there are more than 64
    half = (last - first) / 2
    nodes = np.polynomial.chebyshev.chebpts1(25)
    fits = np.polynomial.chebyshev.chebvander(nodes, 24).T @ weight(first[:, None] + half[:, None] * (nodes + 1), every).T * (2 / 25)
    fits[0] /= 2
    for i in every:
        t = np.arange(first[i], last[i] + 1)
        w = np.polynomial.chebyshev.chebval((t - t[0]) / half[i] - 1, fits[:, i]) if len(t) > 64 else weight(t[None, :], every[i : i + 1])[0]
        yield t, np.cumsum(np.exp(w - w.max()))


def _pick(found: tuple[np.ndarray, np.ndarray], u: np.ndarray | float) -> np.ndarray:
    t, total = found
    return t[np.minimum(np.searchsorted(total, u * total[-1]), len(t) - 1)].astype(np.int64)


def drawn(c: np.ndarray, log_a: np.ndarray, log_h: np.ndarray, alpha: np.ndarray | None, beta: np.ndarray | None, u: np.ndarray, discount: float) -> np.ndarray:
    """The number of tables of each dish of c customers. log_a: of discount times x; log_h: of the parent's probability of
    the dish; the parent's i-th draw after the first one has (alpha + i) / (beta + i), or log_h again without them."""
    out, rows = np.ones(len(c), dtype=np.int64), stirling(discount)
    order = _order(c, int(c.max(initial=0)).bit_length())
    first = _runs(c[order])
    sizes, ends = c[order][first].tolist(), np.append(first[1:], len(c)).tolist()
    first, k = first.tolist(), 0
    while k < len(sizes):
        n, a, b = sizes[k], first[k], ends[k]
        k += 1
        if n < 2:
            continue
        if n > ROWS:
            i = order[a:]
            none = np.zeros(len(i)), np.full(len(i), -1.0)
            found = _far_each(c[i], log_a[i], log_h[i], none[0] if alpha is None else alpha[i], none[1] if beta is None else beta[i], discount)
            out[i] = [int(_pick(f, x)) for f, x in zip(found, u[i], strict=True)]
            break
        if n > 8:  # sizes that are almost the same go together, as none has many dishes
            while k < len(sizes) and sizes[k] <= min(ROWS, n + n // 4) and ends[k] - a <= 1_000_000 // sizes[k]:
                b, k = ends[k], k + 1
        top = sizes[k - 1]
        for x in range(a, b, max(1, 1_000_000 // top)):
            i = order[x : min(b, x + max(1, 1_000_000 // top))]
            out[i] = _drawn_alike(c[i], top, log_a[i], log_h[i], None if alpha is None else alpha[i], None if beta is None else beta[i], u[i], rows)
    return out


def _drawn_alike(c: np.ndarray, top: int, log_a: np.ndarray, log_h: np.ndarray, alpha: np.ndarray | None, beta: np.ndarray | None, u: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """drawn for dishes in the order of their customers, of which none has more than top."""
    if top <= 8:  # dishes of one size, one number of tables after the other
        w, total = [log_h + log_a], []
        for t in range(1, top):
            w.append(w[-1] + ((log_h if beta is None else np.log((alpha + t) / (beta + t))) + log_a))
        w = [x + y for x, y in zip(w, rows[top], strict=True)]
        best = np.maximum.reduce(w)
        for x in w:
            x = np.exp(x - best)
            total.append(total[-1] + x if total else x)
        bound = u * total[-1]
        return sum((x < bound).astype(np.int64) for x in total) + 1
    t = np.arange(1, top + 1)
    w = np.empty((len(c), top))
    w[:, 0] = log_h
    if beta is None:
        w[:, 1:] = log_h[:, None]
    else:
        w[:, 1:] = np.log((alpha[:, None] + t[:-1]) / (beta[:, None] + t[:-1]))
    w = np.cumsum(w + log_a[:, None], axis=1)
    begin = _runs(c)
    for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(c)], strict=True):
        w[x:y, : c[x]] += rows[c[x]]
        w[x:y, c[x] :] = -np.inf
    total = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    return (total < u[:, None] * total[:, -1:]).sum(axis=1) + 1


class Families:
    """Restaurants of pairs of context words, with the parents that they share.

    c2: customers of each dish of a pair's restaurant; dish: the same dish of the parent; pair: the restaurant. family:
    the parent of each of its dishes; share: what the corpus restaurant predicts for it. Keys tell dishes and
    restaurants apart, whatever else is in the same task. A dish without customers has no tables.
    """

    def __init__(self, c2: np.ndarray, dish: np.ndarray, pair: np.ndarray, family: np.ndarray, share: np.ndarray, keys: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], strength: float, discount: float) -> None:
        self.c2, self.dish, self.pair, self.family, self.share = c2, dish, pair, family, share
        self.keys, self.strength, self.discount = keys, strength, discount
        self.pairs, self.families = (int(x.max()) + 1 if len(x) else 0 for x in (pair, family))
        self.guests2 = np.bincount(pair, weights=c2, minlength=self.pairs)
        self.t2 = np.minimum(c2, 1)
        self.arrived()
        self.t1 = np.minimum(self.c1, 1)
        self.many = np.flatnonzero(c2 >= 2)  # a single customer has one table whatever happens
        self.busy = np.unique(pair[self.many])

    def arrived(self) -> None:
        """The parents' customers are the tables of the pairs."""
        self.held2 = np.bincount(self.pair, weights=self.t2, minlength=self.pairs)
        self.c1 = np.bincount(self.dish, weights=self.t2, minlength=len(self.family)).astype(np.int64)
        self.guests1 = np.bincount(self.family, weights=self.c1, minlength=self.families)

    def sweep(self, number: int) -> None:
        """Draws all tables once: pairs given their parents, then the parents."""
        d, s, many, busy = self.discount, self.strength, self.many, self.busy
        held1 = np.bincount(self.family, weights=self.t1, minlength=self.families)
        if len(many):
            x = np.zeros(self.pairs)
            x[busy] = gamma(s / d + self.held2[busy], self.keys[0][busy] + np.uint64(2 * number))
            at, f = self.dish[many], self.family[self.dish[many]]
            # the parent without this dish's own customers there
            own, c1, t1 = self.t2[many], self.c1[at], self.t1[at]
            left = c1 - own
            tables = np.where(left > 0, np.clip(t1 * left / np.maximum(c1, 1), 1, None), 0.0)
            others = held1[f] - (t1 - tables)
            guests = self.guests1[f] - own
            h = (left - d * tables + (s + d * others) * self.share[at]) / (s + guests)
            alpha = left - d * np.maximum(tables, 1) + (s + d * (others + (tables == 0))) * self.share[at]
            self.t2[many] = drawn(self.c2[many], np.log(d * x[self.pair[many]]), np.log(h), alpha, s + guests, uniform(self.keys[1][many], number), d)
            self.arrived()
        self.t1 = np.minimum(np.maximum(self.t1, self.c1 > 0), self.c1)
        held1 = np.bincount(self.family, weights=self.t1, minlength=self.families)
        some = np.flatnonzero(self.c1 >= 2)
        if len(some):
            x = gamma(s / d + held1, self.keys[2] + np.uint64(2 * number))
            self.t1[some] = drawn(self.c1[some], np.log(d * x[self.family[some]]), np.log(self.share[some]), None, None, uniform(self.keys[3][some], number), d)

    def sampled(self, burn: int, samples: int) -> dict[str, np.ndarray]:
        """Sums over the samples of tables (t2, t1), of the parents' customers (c1), and of both by restaurant."""
        for n in range(burn):
            self.sweep(n)
        out = {k: np.zeros(n, dtype=np.int64) for k, n in (("t2", len(self.c2)), ("held2", self.pairs), ("c1", len(self.family)), ("t1", len(self.family)), ("guests1", self.families), ("held1", self.families))}
        for n in range(samples):
            self.sweep(burn + n)
            held1 = np.bincount(self.family, weights=self.t1, minlength=self.families)
            for k, x in (("t2", self.t2), ("held2", self.held2), ("c1", self.c1), ("t1", self.t1), ("guests1", self.guests1), ("held1", held1)):
                out[k] += x.astype(np.int64)
        return out


def corpus_tables(customers: np.ndarray, words: np.ndarray, strength: float, discount: float, burn: int, samples: int) -> np.ndarray:
    """The corpus restaurant's mean number of tables for words of so many customers; words: how many there are of each."""
    known, rng, total, met = float(words.sum()), np.random.default_rng(1), np.zeros(len(customers)), {}
    held = known
    for n in range(burn + samples):
        log_a = math.log(discount * rng.gamma(strength / discount + held)) - math.log(known + 1)
        mean = np.ones(len(customers))
        large = customers[customers > ROWS]
        far = _far_each(large, np.full(len(large), log_a), np.zeros(len(large)), np.zeros(len(large)), np.full(len(large), -1.0), discount, met)
        for i, (c, k) in enumerate(zip(customers.tolist(), words.tolist(), strict=True)):
            if 1 < c <= ROWS:
                t = np.arange(1, c + 1)
                w = stirling(discount)[c] + t * log_a
                w = np.exp(w - w.max())
                mean[i] = rng.multinomial(k, w / w.sum()) @ t / k
            elif c > ROWS:
                mean[i] = _pick(next(far), rng.random(k)).mean()
        held = float(mean @ words)
        if n >= burn:
            total += mean
    return total / max(1, samples)


def shard_of(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(36)) % np.uint64(SHARDS)).astype(np.int64)


class _Words:
    """A block's distinct words, with the word of each token."""

    def __init__(self, block: Block, buckets: int, modulus: int, held_out: int) -> None:
        of_words, begin = hashed(block.bytes, block.starts)
        self.lengths = np.diff(begin) + 1
        # each text as two starts, its words and an end
        starts = np.concatenate([[0], np.cumsum(self.lengths + 2)]).astype(np.int64)
        h = np.full(starts[-1], _END, dtype=np.uint64)
        h[starts[:-1]] = _START
        h[starts[:-1] + 1] = _START
        h[np.arange(len(of_words)) + 3 * np.repeat(np.arange(len(self.lengths)), np.diff(begin)) + 2] = of_words
        self.held_out = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == held_out for i in block.ids], dtype=bool)
        self.words, _, self.place = _distinct(h)
        cur = np.ones(len(h), dtype=bool)
        cur[starts[:-1]] = False
        cur[starts[:-1] + 1] = False
        self.at = np.flatnonzero(cur)
        self.token = self.place[self.at]  # of each token, the word
        self.train, self.buckets = np.repeat(~self.held_out, self.lengths), buckets
        self.word_count = np.bincount(self.token, weights=self.train, minlength=len(self.words)).astype(np.int64)
        self.word_bucket = shard_of(self.words) % buckets
        self.word_order = _order(self.word_bucket, SHARDS.bit_length())
        self.word_cuts = np.searchsorted(self.word_bucket[self.word_order], np.arange(buckets + 1))

    def count_questions(self) -> list[tuple[int, bytes]]:
        every = np.bincount(self.token, minlength=len(self.words))
        out = []
        for b in np.flatnonzero(np.diff(self.word_cuts)):
            some = self.word_order[self.word_cuts[b] : self.word_cuts[b + 1]]
            out.append((int(b), _squeezed(self.words[some], _planes(self.word_count[some]), _planes(every[some]))))
        return out

    def counts_told(self, answers: Answer) -> tuple[np.ndarray, np.ndarray]:
        """The training tokens of each word in all blocks, and its number."""
        count, number = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64)
        for b, payload in answers.items():
            some = self.word_order[self.word_cuts[b] : self.word_cuts[b + 1]]
            c, n, _ = _spread_out(payload)
            count[some], number[some] = _whole(c), _whole(n)
        return count, number * SHARDS + shard_of(self.words)


class _Triples(_Words):
    """A block's distinct triples of a parent, a word and a first context word, with the triple of each token.

    They are in the order of their parents' buckets, then parents, words and first context words.
    """

    def __init__(self, block: Block, hot: np.ndarray, buckets: int, modulus: int, held_out: int) -> None:
        super().__init__(block, buckets, modulus, held_out)
        bits = len(self.words).bit_length()
        first, second = self.place[self.at - 2].astype(np.int64), self.place[self.at - 1].astype(np.int64)
        part = np.where(np.isin(self.words, hot)[second], (self.words[first] % np.uint64(PARTS)).astype(np.int64) + 1, 0)
        families, _, family = _distinct(second * (PARTS + 1) + part)
        keys = mix(mix(self.words[families // (PARTS + 1)]) + (families % (PARTS + 1)).astype(np.uint64))
        dealt = ((keys >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        order = _order(dealt, buckets.bit_length())
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.families, dealt = families[order], dealt[order]
        dishes, _, dish = _distinct((rank[family] << bits) | self.token)
        triples, _, self.triple = _distinct((dish << bits) | first)
        self.count = np.bincount(self.triple, weights=self.train, minlength=len(triples)).astype(np.int64)
        self.dish, self.first = triples >> bits, triples & ((1 << bits) - 1)
        self.family, self.right = dishes >> bits, dishes & ((1 << bits) - 1)
        edges = np.arange(buckets + 1)
        self.dish_cuts = np.searchsorted(dealt[self.family], edges)
        self.triple_cuts = np.searchsorted(dealt[self.family[self.dish]], edges)

    def _part(self, b: int) -> tuple[slice, slice]:
        return slice(self.dish_cuts[b], self.dish_cuts[b + 1]), slice(self.triple_cuts[b], self.triple_cuts[b + 1])

    def questions(self, count: np.ndarray, number: np.ndarray, n: float) -> list[tuple[int, bytes]]:
        """count: the training tokens of each word in all blocks, of n; number: the word's."""
        shares = np.rint(-np.log(np.maximum(count, 1e-9) / max(n, 1.0)) / _STEP).clip(0, 255).astype(np.uint8)
        out = []
        for b in np.flatnonzero(np.diff(self.dish_cuts)):
            dishes, triples = self._part(b)
            family, w, c = self.family[dishes], self.right[dishes], self.count[triples]
            heads, each = _runs(family), np.bincount(self.dish[triples] - dishes.start)
            second, part = np.divmod(self.families[family[heads]], PARTS + 1)
            out.append((int(b), _squeezed(_planes(number[second], _ID), part.astype(np.uint8), _planes(np.diff(np.append(heads, len(family)))), _planes(number[w], _ID), shares[w], _planes(each), _planes(number[self.first[triples]], _ID), _planes(c))))
        return out

    def told(self, answers: Answer, strength: float, discount: float, samples: int) -> tuple[np.ndarray, np.ndarray]:
        """For each triple its probability without the corpus restaurant's part, and that part's weight."""
        own, weight = np.zeros(len(self.dish)), np.ones(len(self.dish))
        for b, payload in answers.items():
            if b < 0:
                continue
            dishes, triples = self._part(b)
            low, high, c2, t2, guests2, held2, low1, high1, c1, t1, guests1, held1 = _spread_out(payload)
            c2, t2, guests2, held2, c1, t1 = (_whole(x).astype(float) for x in (c2, t2, guests2, held2, c1, t1))
            code, code1 = (x.astype(np.int64) | (y.astype(np.int64) << 8) for x, y in ((low, high), (low1, high1)))
            family = self.family[dishes]
            heads = _runs(family)
            sizes = np.diff(np.append(heads, len(family)))
            guests1, held1 = (np.repeat(_whole(x).astype(float), sizes) for x in (guests1, held1))
            total1 = samples * strength + guests1
            here = self.dish[triples] - dishes.start
            a1, b1 = (c1 - discount * t1)[code1] / total1, (samples * strength + discount * held1) / total1
            total2 = samples * (strength + guests2)
            a2, b2 = ((samples * c2 - discount * t2) / total2)[code], ((samples * strength + discount * held2) / total2)[code]
            own[triples], weight[triples] = a2 + b2 * a1[here], b2 * b1[here]
        return own, weight

    def words_told(self, answers: Answer) -> tuple[np.ndarray, np.ndarray]:
        count, guests = np.zeros(len(self.words)), np.zeros(len(self.words), dtype=np.int64)
        for b, payload in answers.items():
            if b <= -_OFFSET:
                k = -b - _OFFSET
                some = self.word_order[self.word_cuts[k] : self.word_cuts[k + 1]]
                count[some], guests[some] = (_whole(x) for x in _spread_out(payload))
        return count, guests


def _coded(usual: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of whole numbers and each row's number among them. usual: rows that are all the same."""
    odd = np.flatnonzero(~usual)
    code, high = np.zeros(len(odd), dtype=np.int64), 0
    for c in columns:
        mine = c[odd]
        more = int(mine.max(initial=0))
        if (high + 1) * (more + 1) >= 1 << 40:  # numbers instead of values, which are smaller
            _, _, code = _distinct(code)
            _, _, mine = _distinct(mine)
            high, more = int(code.max(initial=0)), int(mine.max(initial=0))
        code, high = code * (more + 1) + mine, high * (more + 1) + more
    _, first, code = _distinct(code)
    times = np.bincount(code)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order)) + 1
    first = odd[first]
    first = np.append(np.argmax(usual), first[order])  # the row that is usual stands first, if there is one
    out = np.zeros(len(usual), dtype=np.int64)
    out[odd] = rank[code]
    return [c[first] for c in columns], out


def _answer_codes(tables: list[np.ndarray], code: np.ndarray) -> list[np.ndarray]:
    """The codes that a block needs, in two planes, and what they stand for."""
    times = np.bincount(code, minlength=1)
    known = np.flatnonzero(times)
    place = np.zeros(len(times), dtype=np.int64)
    place[known] = np.arange(len(known))
    mine = place[code]
    return [mine.astype(np.uint8), (mine >> 8).astype(np.uint16), *[_planes(t[known]) for t in tables]]


def _seater(strength: float, discount: float, burn: int, samples: int, buckets: int):
    """Answers to blocks, and by bucket of words what all its parents' tables are for the corpus restaurant."""

    def answer(payloads: list[bytes]) -> tuple[list[bytes], list[tuple[int, bytes]]]:
        parts = [_spread_out(p) for p in payloads]
        parts = [[_whole(p[0], _ID), p[1].astype(np.int64), _whole(p[2]), _whole(p[3], _ID), p[4], _whole(p[5]), _whole(p[6], _ID), _whole(p[7])] for p in parts]
        sizes = [(len(p[0]), len(p[3]), len(p[6])) for p in parts]
        second, part, long, right, level, each, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts  # here and below: what is not needed in the sweeps is not held there
        families, _, here = _distinct(second * (PARTS + 1) + part)
        of = np.repeat(here, long)
        # words and first context words get numbers of this task, so that a pair of numbers fits into one
        words, _, w = _distinct(right)
        numbers, _, first = _distinct(first)
        dishes, heads, dish = _distinct(of * len(words) + w)
        family = of[heads]
        right = dishes - family * len(words)
        word = words[right]
        share = np.exp(-_STEP * level[heads].astype(float))
        kinds, _, triple = _distinct(np.repeat(dish, each) * len(numbers) + first)
        c2 = np.bincount(triple, weights=count, minlength=len(kinds)).astype(np.int64)
        del second, part, long, level, each, first, count, of, w, heads
        at = kinds // len(numbers)
        contexts, _, pair = _distinct(family[at] * len(numbers) + (kinds - at * len(numbers)))
        key1, key_word, key_first = mix(families.astype(np.uint64)), mix(word.astype(np.uint64)), mix(numbers.astype(np.uint64) + _GOLD)
        key_dish, key_pair = mix(key1[family] + key_word), mix(key1[contexts // len(numbers)] + key_first[contexts % len(numbers)])
        del kinds, dishes, word, key_word, key_first
        run = Families(c2, at, pair, family, share, (key_pair, mix(key_pair[pair] + key_dish[at]), key1, key_dish), strength, discount)
        got = run.sampled(burn, samples)
        held2, guests2 = got["held2"][pair], run.guests2.astype(np.int64)[pair]
        table2, code2 = _coded((c2 == 1) & (guests2 == 1), c2, got["t2"], guests2, held2)
        table1, code1 = _coded((got["c1"] == samples) & (got["t1"] == samples), got["c1"], got["t1"])
        out, a, b, f = [], 0, 0, 0
        for of_families, of_dishes, of_triples in sizes:
            mine, those, mine_families = slice(a, a + of_dishes), slice(b, b + of_triples), here[f : f + of_families]
            a, b, f = mine.stop, those.stop, f + of_families
            out.append(_squeezed(*_answer_codes(table2, code2[triple[those]]), *_answer_codes(table1, code1[dish[mine]]), _planes(got["guests1"][mine_families]), _planes(got["held1"][mine_families])))
        tables = np.bincount(right, weights=run.t1, minlength=len(words)).astype(np.int64)
        words, tables = words[tables > 0], tables[tables > 0]
        bucket = words % SHARDS % buckets
        order = _order(bucket, SHARDS.bit_length())
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        passed = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[b] : cuts[b + 1]]
            passed.append((b, _squeezed(_planes(np.diff(words[some], prepend=0), _ID), _planes(tables[some]))))
        return out, passed

    return answer


def _seated(requests: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes], list[tuple[int, bytes]]]]) -> DataFrame:
    """As answered, and with the first row of a bucket what it passes on to others: passed, of bucket and payload."""
    passes = pa.list_(pa.struct([("bucket", pa.int32()), ("payload", pa.binary())]))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out, passed = answer(table.column("payload").to_pylist())
        passed = pa.array([[{"bucket": b, "payload": p} for b, p in passed]] + [None] * (len(out) - 1), passes)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary()), "passed": passed}, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("passed", passes)]))

    return requests.groupBy("bucket").applyInArrow(run, "block long, bucket int, payload binary, passed array<struct<bucket int, payload binary>>")


def _counter(payloads: list[bytes], common: float, buckets: int) -> list[bytes]:
    parts = [_spread_out(p) for p in payloads]
    words, _, kind = _distinct(np.concatenate([p[0] for p in parts]))
    count, every = (np.bincount(kind, weights=np.concatenate([_whole(p[k]) for p in parts]), minlength=len(words)) for k in (1, 2))
    # words with a share of all tokens have it of this bucket's too
    some = np.flatnonzero((every > 0) & (every >= common * every.sum()))
    head = [np.array([count.sum(), (count > 0).sum(), every.sum()]), words[some], every[some]]
    shard, number = shard_of(words), np.empty(len(words), dtype=np.int64)
    order = np.lexsort((words, -every, shard))
    number[order] = np.arange(len(words)) - np.searchsorted(shard[order], shard[order])
    out, at = [], 0
    for n, p in enumerate(parts):
        mine = kind[at : at + len(p[0])]
        at += len(p[0])
        out.append(pack(np.frombuffer(_squeezed(_planes(count[mine]), _planes(number[mine]), _planes(shard[mine] // buckets, 2)), dtype=np.uint8), *(head if n == 0 else [np.zeros(0)] * 3)))
    return out


def _word_adder(bucket: int, buckets: int, counts: list[bytes], passed: list[bytes]) -> list[bytes]:
    """For each block's answer from _counter training tokens and customers of the corpus restaurant by word, from what
    was passed to this bucket; the first answer has numbers of words by customers."""
    parts = [_spread_out(p) for p in passed]
    words, _, kind = _distinct(np.concatenate([np.zeros(0, dtype=np.int64), *(np.cumsum(_whole(p[0], _ID)) for p in parts)]))
    guests = np.bincount(kind, weights=np.concatenate([np.zeros(0), *(_whole(p[1]) for p in parts)]), minlength=len(words))
    customers, times = np.unique(guests.astype(np.int64), return_counts=True)
    words, guests = np.append(words, 1 << 62), np.append(guests, 0)
    out = []
    for n, p in enumerate(counts):
        count, number, turn = _spread_out(unpack(p)[0].tobytes())
        asked_for = _whole(number) * SHARDS + bucket + _whole(turn, 2) * buckets
        at = np.searchsorted(words, asked_for)
        some = slice(None) if n == 0 else slice(0)
        out.append(pack(np.frombuffer(_squeezed(count, _planes(np.where(words[at] == asked_for, guests[at], 0))), dtype=np.uint8), customers[some], times[some]))
    return out


def _words_added(counts: DataFrame, seatings: DataFrame, buckets: int) -> DataFrame:
    """The answers of _word_adder, in buckets below minus _OFFSET."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket, rows = table.column("bucket")[0].as_py(), list(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out = _word_adder(bucket, buckets, [p for b, p in rows if b >= 0], [p for b, p in rows if b < 0])
        return pa.table({"block": pa.array([b for b, _ in rows if b >= 0], pa.int64()), "bucket": pa.array([-_OFFSET - bucket] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    passed = seatings.select(F.explode("passed").alias("p")).select(F.lit(-1).cast("long").alias("block"), "p.bucket", "p.payload")
    return counts.unionByName(passed).groupBy("bucket").applyInArrow(run, "block long, bucket int, payload binary")


def _plain(answers: Answer) -> Answer:
    """Answers without what their bucket says in sum."""
    return {b: unpack(x)[0].tobytes() if b <= -_OFFSET else x for b, x in answers.items()}


def _totals_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without a word for each bucket's training tokens, known words and tokens, and one for each frequent word."""
    for batch in batches:
        for p in batch.column("payload").to_pylist():
            _, head, words, every = unpack(p)
            if len(head):
                cols = [[None, *words.view(np.int64).tolist()], *([x] + [0.0] * len(words) for x in head[:2]), [head[2], *every.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.float64()] * 3), strict=True)], names=["word", "n", "v", "every"])


def counted(blocks: DataFrame, buckets: int, modulus: int, held_out: int, common: float = 0.001) -> tuple[DataFrame, float, float, np.ndarray]:
    """Answers with each word's training tokens, their sum, the number of known words, and the words with that share
    of all tokens or more."""
    answers = written(answered(asked(blocks, lambda block, _: _Words(block, buckets, modulus, held_out).count_questions()), lambda payloads: _counter(payloads, common, buckets)), "counts")
    totals = answers.select("payload").mapInArrow(lean(_totals_of_counts), "word long, n double, v double, every double")
    n, v, every = (x or 0.0 for x in totals.where("word IS NULL").agg(F.sum("n"), F.sum("v"), F.sum("every")).first())
    found = totals.where(F.col("word").isNotNull() & (F.col("every") >= common * every)).select("word").collect()
    return answers, n, v, np.unique(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def _by_customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.column("payload").to_pylist():
            _, customers, times = unpack(p)
            if len(customers):
                yield pa.RecordBatch.from_arrays([pa.array(customers), pa.array(times.astype(np.int64))], names=["customers", "words"])


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1, strength: float = 1.0, discount: float = 0.75, burn: int = 2, samples: int = 3, common: float = 0.001, block_bytes: int = 5_000_000, by_token: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts; with
    by_token also those of the tokens in order, as token_scores."""
    blocks = in_blocks(docs, block_bytes)
    buckets = max(8, blocks.count())
    zeroth, tokens, known_words, hot = counted(blocks, buckets, modulus, held_out, common)

    def triples(block: Block) -> _Triples:
        return _Triples(block, hot, buckets, modulus, held_out)

    def ask_triples(block: Block, answers: Answer) -> list[tuple[int, bytes]]:
        p = triples(block)
        return p.questions(*p.counts_told({b: unpack(x)[0].tobytes() for b, x in answers.items()}), tokens)

    first = written(_seated(asked(with_answers(blocks, zeroth), ask_triples), _seater(strength, discount, burn, samples, buckets)), "seatings")
    second = written(_words_added(zeroth, first, buckets), "words")
    # numbers of customers that differ are fewer than the root of twice their sum
    by_customers = second.select("payload").mapInArrow(lean(_by_customers), "customers long, words long").groupBy("customers").agg(F.sum("words").alias("words")).orderBy("customers").collect()
    customers, words = (np.array([r[i] for r in by_customers], dtype=np.int64) for i in range(2))
    tables = corpus_tables(customers, words, strength, discount, burn, samples)
    guests, held = float(customers @ words), float(tables @ words)
    with_base = (np.maximum(np.append(customers, 0) - discount * np.append(tables, 0.0), 0) + (strength + discount * held) / (known_words + 1)) / (strength + guests)
    shared = docs.sparkSession.sparkContext.broadcast((np.append(customers, 0), with_base))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, with_base = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "lengths", "data")))
                answers = _plain({a["round_bucket"]: a["payload"] for a in batch.column("answers")[i].as_py() or ()})
                p = triples(block)
                own, weight = p.told(answers, strength, discount, samples)
                count, g = p.words_told(answers)
                corpus = with_base[np.where(g > 0, np.searchsorted(customers[:-1], g), len(customers) - 1)]
                logs = np.log10(own + weight * corpus[p.right][p.dish])[p.triple]
                base = np.log10((count + 0.5) / (tokens + 0.5 * (known_words + 1)))[p.token]
                ends = np.concatenate([[0], np.cumsum(p.lengths)])
                add = lambda x: np.add.reduceat(x, ends[:-1]) if len(ends) > 1 else np.zeros(0)  # noqa: B023, E731
                known = add((count[p.token] > 0).astype(np.int64))
                cols = [pa.array(block.ids, pa.int64()), pa.array(p.held_out), pa.array(p.lengths), pa.array(known.astype(np.int64)), pa.array(np.full(len(p.lengths), int(tokens)), pa.int64()), pa.array(add(base)), pa.array(add(logs))]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                if by_token:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(logs))], [*names, "token_scores"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    forget(docs.sparkSession)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + (", token_scores array<double>" if by_token else "")
    return with_answers(blocks, first.drop("passed").unionAll(second)).select("ids", "lengths", "data", "answers").mapInArrow(lean(finish), kind)
