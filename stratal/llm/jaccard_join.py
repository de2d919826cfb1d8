"""N-gram Jaccard join: a size-aware heavy-light join of the documents' shingle sets.

Sets are taken in a common order of shingles: by hash, those in more than ``dense`` of all documents last. Sets that
are similar to at least ``threshold`` (in hundredths) share a shingle among the first n - ceil(threshold n / 100) + 1 of
each, and a subset of two among one more. Small sets enumerate these subsets of two as their keys, large ones put single
shingles on inverted lists; small sets within the threshold of the boundary do both. The boundary is the size at
which subsets of two begin to cost more than lists of the length that is found in the corpus.

Sets that are equal are one class and take part once. Keys met by one set only end there. On the others' lists, pairs
are told apart by size and by a bound that parity bitmaps give: the bits in which two bitmaps differ are at most the
elements in which the sets differ. Pairs that this leaves open hold groups of sets together. Within a group the links
are found exactly, by counting common shingles on inverted lists: each set that is reached scans the lists of those not
reached yet. Groups too large for one task are dealt into slices, in which all sets meet a few of the group first; those
that this leaves outside the group's largest component then meet all others. So no link is lost, and no pairs of a group
are ever written as rows.

Dense shingles can number at most the mean set size over ``dense``, whatever the corpus: that bounds what is broadcast.

Nulls and odd rows: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle. Rows that repeat a text share its component. A null doc_id is the largest. Equal
sets are told by a 64-bit hash of their sorted shingle hashes together with their size. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Answer, Block, answered, asked, by_bucket, in_blocks, pack, unpack, with_answers
from .common import text_of, words_of, written
from .components import components
from .lean import lean
from .shingles import hashed, mix, shingled

SIZE = 5
PIVOTS = 16


class _Sets:
    """The distinct shingles of each text of a block, ascending; the first text with each set."""

    def __init__(self, block: Block, only: list[int] | None = None) -> None:
        data, starts = block.bytes, block.starts
        if only is not None:
            texts = [data[starts[i] : starts[i + 1]] for i in only]
            data, starts = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, own = shingled(*hashed(data, starts), SIZE)
        cuts = np.searchsorted(own, np.arange(len(starts)))
        self.sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in self.sets], dtype=np.uint64).view(np.int64)


def _prefix(s: np.ndarray, dense: np.ndarray, threshold: int, more: int) -> np.ndarray:
    """The first shingles in the common order: as many as may all be missing from a similar set, and ``more``."""
    n = len(s)
    k = n - (threshold * n + 99) // 100 + more
    if len(dense):
        at = np.searchsorted(dense, s)
        last = dense[np.minimum(at, len(dense) - 1)] == s
        if last.any():
            return np.concatenate([s[~last], s[last]])[:k]
    return s[:k]


def _keys(s: np.ndarray, dense: np.ndarray, threshold: int, boundary: int) -> np.ndarray:
    n, out = len(s), []
    if n == 0:
        return np.zeros(0, np.uint64)
    small = 2 <= n <= boundary and (threshold * n + 99) // 100 >= 2
    if small:
        first = _prefix(s, dense, threshold, 2)
        pairs = np.array(list(combinations(np.sort(first).tolist(), 2)), dtype=np.uint64)
        out.append(mix(pairs[:, 0] * np.uint64(3) + mix(pairs[:, 1])))
    if not small or 100 * n >= threshold * boundary:
        out.append(_prefix(s, dense, threshold, 1))
    return np.unique(np.concatenate(out))


def _parity(s: np.ndarray) -> bytes:
    """A bitmap of about as many bits as elements; each element turns one over."""
    bits = 1 << min(14, max(6, int(len(s)).bit_length()))
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differ(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many elements are in one set only."""
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _first(batches: Iterator[pa.RecordBatch], dense: float) -> Iterator[pa.RecordBatch]:
    """First pass: a block's documents with their sets, its totals, and the shingles that many of its texts have."""
    for batch in batches:
        for i, number in enumerate(batch.column("block").to_pylist()):
            block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "lengths", "data")))
            sets = _Sets(block)
            keys, times = np.unique(np.concatenate([*sets.sets, np.zeros(0, np.uint64)]), return_counts=True)
            often = times >= max(3, 0.5 * dense * len(sets.sets))
            texts = np.array([xxhash.xxh64_intdigest(block.bytes[a:b], seed=42) for a, b in zip(block.starts[:-1], block.starts[1:], strict=True)], dtype=np.uint64)
            lists = (block.ids, [len(s) for s in sets.sets], sets.ids().tolist(), texts.view(np.int64).tolist(), keys[often].view(np.int64).tolist(), times[often].tolist(), [int(times.sum()), len(keys), len(sets.sets)])
            names = ["doc_ids", "sizes", "sets", "hashes", "often", "times", "totals"]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in lists]], names=["block", *names])


FIRST = "block long, doc_ids array<bigint>, sizes array<bigint>, sets array<bigint>, hashes array<bigint>, often array<bigint>, times array<bigint>, totals array<bigint>"


def _entries(shared, threshold: int, buckets: int):
    """Third pass: for each bucket the sets with keys that others have too, with their bitmaps."""

    def entries(block: Block, answers: Answer) -> list[tuple[int, bytes]]:
        sets = _Sets(block)
        ids, keys, owner, order, cuts = _asked_keys(sets, *shared.value, threshold, buckets)
        met = np.zeros(len(keys), dtype=bool)
        for b, payload in answers.items():
            met[order[cuts[b] : cuts[b + 1]]] = np.unpackbits(np.frombuffer(payload, dtype=np.uint8), count=int(cuts[b + 1] - cuts[b])).astype(bool)
        maps, rows = {int(d): _parity(sets.sets[d]) for d in np.unique(owner[met])}, []
        for b in np.flatnonzero(np.diff(cuts)):
            some = order[cuts[b] : cuts[b + 1]]
            some = some[met[some]]
            if len(some):
                who, local = np.unique(owner[some], return_inverse=True)
                own = [maps[int(d)] for d in who]
                local = local.astype(np.uint16 if len(who) < 65536 else np.uint32)
                rows.append((int(b), pack(keys[some], local, ids[who], np.array([len(sets.sets[d]) for d in who], dtype=np.int32), np.array([len(m) for m in own], dtype=np.int32), np.frombuffer(b"".join(own), dtype=np.uint8))))
        return rows

    return entries


def _asked_keys(sets: _Sets, dense: np.ndarray, boundary: int, threshold: int, buckets: int):
    """A block's keys, those of the first text with each set, and their order by bucket."""
    ids = sets.ids()
    _, first = np.unique(ids, return_index=True)
    per = [_keys(sets.sets[d], dense, threshold, boundary) for d in first]
    keys = np.concatenate([*per, np.zeros(0, np.uint64)])
    owner = np.repeat(first, [len(k) for k in per])
    order, cuts = by_bucket(keys, buckets)
    return ids, keys, owner, order, cuts


def _met(payloads: list[bytes]) -> list[bytes]:
    """For each key asked for, whether another set has it; equal sets of several blocks are told apart later."""
    parts = [unpack(p)[0] for p in payloads]
    _, where, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return [np.packbits(x).tobytes() for x in np.split(times[where] > 1, np.cumsum([len(p) for p in parts])[:-1])]


def _may_link(na: int, nb: int, a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether sizes and bitmaps leave the similarity open: with d elements in one set only it is (s - d) / (s + d)."""
    if 100 * min(na, nb) < threshold * max(na, nb):
        return False
    return 100 * (na + nb - _differ(a, b)) >= threshold * (na + nb + _differ(a, b))


def _stars(parent: dict[int, int]) -> list[tuple[int, int]]:
    """Each group of two or more as pairs of its least member and another."""
    groups: dict[int, list[int]] = {}
    for x in parent:
        groups.setdefault(_root(parent, x), []).append(x)
    return [(least, x) for g in groups.values() if len(g) > 1 for least in [min(g)] for x in g if x != least]


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _grouped(threshold: int):
    """Groups of a bucket's sets that pairs which may link hold together, as stars."""

    def run(table: pa.Table) -> pa.Table:
        at: dict[int, tuple[int, np.ndarray]] = {}
        keys, members = [], []
        for payload in table.column("payload").to_pylist():
            k, local, ids, sizes, lengths, maps = unpack(payload)
            for s, n, e, m in zip(ids.tolist(), sizes.tolist(), np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                at.setdefault(s, (n, maps[e - m : e]))
            keys.append(k)
            members.append(ids[local])
        keys, members = np.concatenate(keys), np.concatenate(members)
        order = np.lexsort((members, keys))
        keys, members = keys[order], members[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
        parent = {s: s for s in at}
        tried: set[tuple[int, int]] = set()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row = sorted(set(members[a:b].tolist()), key=lambda s: (at[s][0], s))
            if len(row) > 1:
                _joined(row, at, parent, tried, threshold)
                if len(tried) > 300_000:
                    tried.clear()
        pairs = _stars(parent)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _joined(row: list[int], at: dict, parent: dict[int, int], tried: set, threshold: int) -> None:
    """Joins the groups of a list's sets (in order of size) where a pair of them may link."""
    groups: dict[int, list[int]] = {}
    for s in row:
        n, own = at[s]
        mine = _root(parent, s)
        for root in list(groups):
            if root == mine or root not in groups:
                continue
            for t in reversed(groups[root]):
                if 100 * at[t][0] < threshold * n:
                    break  # and so are all before it
                pair = (s, t) if s < t else (t, s)
                if pair not in tried:
                    if _may_link(at[t][0], n, at[t][1], own, threshold):
                        parent[root] = mine
                        groups[mine] = sorted(groups.pop(root) + groups.get(mine, []), key=lambda x: (at[x][0], x))
                        break
                    tried.add(pair)
        groups.setdefault(mine, []).append(s)


def _fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts that are wanted of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            wanted = batch.column("wanted")[i].as_py()
            block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "lengths", "data")))
            places = sorted({w["place"] for w in wanted})
            for at in range(0, len(places), 256):
                some = places[at : at + 256]
                data = dict(zip(some, [s.tobytes() for s in _Sets(block, some).sets], strict=True))
                mine = [w for w in wanted if w["place"] in data]
                yield pa.RecordBatch.from_arrays([*[pa.array([w[c] for w in mine], pa.int64()) for c in ("part", "root", "set")], pa.array([data[w["place"]] for w in mine], pa.binary())], names=["part", "root", "set", "data"])


def _linker(threshold: int):
    """Exact links among the sets of each group of a part, as stars."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, list[int]] = {}
        for i, root in enumerate(table.column("root").to_pylist()):
            groups.setdefault(root, []).append(i)
        ids, data, pairs = table.column("set").to_pylist(), table.column("data"), []
        for rows in groups.values():
            sets = [np.frombuffer(data[i].as_py(), dtype=np.uint64) for i in rows]
            for one in _linked_sets(sets, threshold):
                if len(one) > 1:
                    members = sorted(ids[rows[x]] for x in one)
                    pairs += [(members[0], m) for m in members[1:]]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _linked_sets(sets: list[np.ndarray], threshold: int) -> list[list[int]]:
    """Components of the sets under links: each set met scans the inverted lists of those that are not met yet."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, out = np.ones(len(sets), dtype=bool), []
    owner = np.repeat(np.arange(len(sets)), sizes)
    n_keys = int(flat.max()) + 1

    def lists(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, o = flat[keep[owner]], owner[keep[owner]]
        order = np.argsort(f, kind="stable")
        return o[order], np.concatenate([[0], np.cumsum(np.bincount(f, minlength=n_keys))])

    who, cuts = lists(left)
    listed = len(sets)
    while left.any():
        first = int(np.flatnonzero(left)[0])
        left[first] = False
        todo, one = [first], [first]
        while todo and left.any():
            if left.sum() * 2 < listed:
                who, cuts = lists(left)
                listed = int(left.sum())
            x = todo.pop()
            keys = flat[starts[x] : starts[x + 1]]
            lo, n = cuts[keys], cuts[keys + 1] - cuts[keys]
            both = np.zeros(len(sets), dtype=np.int64)
            ends = np.cumsum(n)
            first_key = 0
            while first_key < len(keys):  # at most about two million entries at a time
                last_key = max(first_key + 1, int(np.searchsorted(ends, (ends[first_key - 1] if first_key else 0) + 2_000_000, side="right")))
                lo_some, n_some = lo[first_key:last_key], n[first_key:last_key]
                total = np.cumsum(n_some)
                at = np.arange(total[-1]) - np.repeat(total - n_some - lo_some, n_some)
                both += np.bincount(who[at], minlength=len(sets))
                first_key = last_key
            hit = np.flatnonzero(left & (100 * both >= threshold * (sizes + sizes[x] - both)))
            left[hit] = False
            todo += hit.tolist()
            one += hit.tolist()
        out.append(one)
    return out


def _parts(rows: DataFrame, most: int, shared: int) -> DataFrame:
    """part, root, set: in which parts the sets of groups are met. rows: node, root and open, whether links of the set
    may still be missing. Groups of at most ``most`` sets are dealt over ``shared`` parts. A larger one is dealt into slices; every set is
    sent where a slice of the open ones is, so that each open set meets all others, and two that are closed need not."""
    slices = lambda n: F.greatest(F.lit(1), F.ceil(n / (most / 2))).cast("int")
    counts = rows.groupBy("root").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
    rows = rows.join(counts.where("n_open > 0"), "root").withColumns({"k": slices(F.col("n")), "k_open": slices(F.col("n_open"))})
    large = F.col("n") > most
    own, mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("k_open")).cast("int")
    # part (slice of all, slice of the open): closed sets go to their own slice's parts, open ones to those as well, and
    # to all parts of their open slice
    across = F.transform(F.sequence(F.lit(0), F.col("k_open") - 1), lambda j: F.struct(own.alias("i"), j.cast("int").alias("j")))
    along = F.when(F.col("open"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(i.cast("int").alias("i"), mine.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    places = F.when(large, F.array_union(across, along)).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    part = F.when(F.col("large"), F.xxhash64("root", "at.i", "at.j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(shared)))
    return rows.select(F.explode(places).alias("at"), "root", "node", large.alias("large")).select(part.alias("part"), "root", F.col("node").alias("set"))


def _sets_in(parts: DataFrame, blocks: DataFrame, places: DataFrame) -> DataFrame:
    wanted = parts.join(places, "set").groupBy("block").agg(F.collect_list(F.struct("part", "root", "set", "place")).alias("wanted"))
    return blocks.join(wanted, "block").select("ids", "lengths", "data", "wanted").mapInArrow(lean(_fetcher), "part long, root long, set long, data binary")


def _verified(blocks: DataFrame, groups: DataFrame, places: DataFrame, threshold: int, most: int = 500) -> DataFrame:
    """Links (a, b) within the groups (node, root).

    Groups of at most ``most`` sets are worked on whole, some hundred sets in a part. In a larger one all sets first meet its
    ``PIVOTS`` sets of least hash, dealt into slices with the pivots in each. Sets that link with what the largest
    component holds are closed: they need no more links among themselves. Only the others go on to meet all sets.
    So a group of true near copies costs rows in proportion to its size, whatever that is.
    """
    groups = written(groups, "groups")
    shared = groups.count() // 200 + 1
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > most)
    few = groups.join(large, "root", "left_anti").select("node", "root", F.lit(True).alias("open"))
    if large.isEmpty():
        return _sets_in(_parts(few, most, shared), blocks, places).groupBy("part").applyInArrow(_linker(threshold), "a long, b long")
    many = written(groups.join(large, "root"), "large")
    least = many.groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("size") / (4 * PIVOTS))) == 0, F.col("node")))), 1, PIVOTS).alias("pivots"))
    k = F.ceil(F.col("size") / (most / 2)).cast("int")
    slices = many.select("node", "root", F.pmod(F.xxhash64("node"), k).cast("int").alias("i"))
    pivots = least.join(large, "root").select("root", k.alias("k"), F.explode("pivots").alias("node"))
    pivots = pivots.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    met = slices.unionAll(pivots.select("node", "root", F.col("i").cast("int"))).distinct()
    parts = met.select(F.xxhash64("root", "i").alias("part"), "root", F.col("node").alias("set"))
    first = written(_sets_in(parts, blocks, places).groupBy("part").applyInArrow(_linker(threshold), "a long, b long"), "links")
    known = components(first)
    named = many.select("node", "root").join(known.withColumnRenamed("root", "component"), "node", "left")
    largest = named.where("component IS NOT NULL").groupBy("root", "component").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = named.join(largest, "root", "left").select("node", "root", (~F.col("component").eqNullSafe(F.col("main")) | F.col("main").isNull()).alias("open"))
    second = _sets_in(_parts(few.unionAll(rest), most, shared), blocks, places).groupBy("part").applyInArrow(_linker(threshold), "a long, b long")
    return first.unionAll(second)


def linked(docs: DataFrame, threshold: int = 80, dense: float = 0.001, block_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and text_hash (xxhash64 of the text)."""
    spark = docs.sparkSession
    blocks = in_blocks(docs, block_bytes)
    first = written(blocks.select("block", "ids", "lengths", "data").mapInArrow(lean(lambda batches: _first(batches, dense)), FIRST), "sets")
    shingles, distinct_, n_docs = (x or 1 for x in first.select(*[F.sum(F.get("totals", i)) for i in range(3)]).first())
    often = first.select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy("o.often").agg(F.sum("o.times").alias("times"))
    # at most mean set size / dense rows
    found = [r[0] for r in often.where(F.col("times") >= max(8.0, dense * n_docs)).select("often").collect()]
    dense_keys = np.sort(np.array(found, dtype=np.int64).view(np.uint64))
    # a set of n has C(p, 2) subsets or p lists, p about 0.2 n + 2; lists cost their length on top
    boundary = int((2 * (1 + 4 * shingles / distinct_) - 1) * 100 / (100 - threshold))
    shared = spark.sparkContext.broadcast((dense_keys, boundary))
    # a set's bitmap goes to as many buckets as it has keys there: with fewer buckets than keys that would grow with them
    buckets = max(64, blocks.count() // 6)

    def ask(block: Block, _: Answer) -> list[tuple[int, bytes]]:
        _, keys, _, order, cuts = _asked_keys(_Sets(block), *shared.value, threshold, buckets)
        return [(int(b), pack(keys[order[cuts[b] : cuts[b + 1]]])) for b in np.flatnonzero(np.diff(cuts))]

    told = with_answers(blocks, answered(asked(blocks, ask), _met))
    entries = asked(told, _entries(shared, threshold, buckets))
    stars = entries.groupBy("bucket").applyInArrow(_grouped(threshold), "a long, b long").distinct()
    docs = first.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes", "sets", "hashes")).alias("place", "d")).select("block", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_shingles"), F.col("d.sets").alias("set"), F.col("d.hashes").alias("text_hash"))
    places = docs.where("n_shingles > 0").groupBy("set").agg(F.min(F.struct("block", "place")).alias("at")).select("set", "at.block", "at.place")
    links = _verified(blocks, components(stars), places, threshold)
    roots = components(links)
    full = docs.where("n_shingles > 0")
    classes = full.groupBy("set").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    # copies in one block are one row until they have met their class
    copies = full.groupBy("block", "set").agg(F.collect_list(F.struct("doc_id", "n_shingles", "text_hash")).alias("copies"))
    found = copies.join(named, "set").select("component_id", F.explode("copies").alias("c")).select("c.doc_id", "c.n_shingles", "component_id", "c.text_hash")
    empty = docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return found.unionAll(empty)


def one_of_each(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """docs without those that link, over however many steps, with a document of a smaller doc_id. Of rows that repeat
    the same doc_id and text one stays, and of documents without words all."""
    found = linked(docs, threshold)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    kept = written(kept, "kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copies", "n")
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(text_of()) == kept["__hash"])
    if (kept.where("n > 0").agg(F.max("copies")).first()[0] or 0) > 1:
        keyed = docs.withColumn("__text", F.xxhash64(text_of()))
        empty = F.size(words_of(text_of())) == 0
        docs = keyed.where(~empty).dropDuplicates(["doc_id", "__text"]).unionAll(keyed.where(empty)).drop("__text")
        same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(text_of()) == kept["__hash"])
    return docs.join(kept, same, "left_semi")
