"""URL filters: rules on hosts and paths, and a cascade of Bloom filters that is exact over the corpus's own hosts.

The corpus's distinct hosts are the complete key universe. Level 1 of the cascade encodes the listed hosts, level 2
the unlisted hosts that level 1 wrongly passes, level 3 the listed hosts that level 2 wrongly passes, and so on until
no wrong answer is left. A host of the universe is then classified without error by testing bits alone: the filters
enter the plan as scalar subqueries, so the pages are neither joined nor shuffled. Each level's size is known before
it is built. Above ``max_bits`` the universe is dealt by hash into shards with a cascade each, and pages meet the
filters of their shard by an equi-join, whose skew adaptive execution splits.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and an empty path, fits no rule and is
allowed. Repeated rows are judged alike, empty tables give empty results, further columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of the path."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", ""))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        chosen = F.when(fits, F.lit(r.text)).otherwise(chosen)
    return chosen


def _positions(key: Column, level: int, hashes: int, bits: Column | int) -> list[Column]:
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    m = F.lit(bits) if isinstance(bits, int) else bits
    # the sum may wrap in neither mode: each part is below 2**31 first
    return [F.pmod(F.pmod(a, F.lit(2**31)) + F.pmod(b, F.lit(2**31 - 1)) * F.lit(i + 1), m) for i in range(hashes)]


def _hit(words: Column, positions: Sequence[Column]) -> Column:
    tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in positions]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


@dataclass
class Level:
    words: DataFrame  # shard, words: one row for each shard
    bits: int
    hashes: int


@dataclass
class Cascade:
    """Levels in order; hit(key) of level 1 asks for listed keys, of level 2 for its false positives, and so on."""

    levels: list[Level]
    shards: int

    def contains(self, key: Column, words: Sequence[Column]) -> Column:
        """Whether a key of the universe is listed; words: each level's bits for that key."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[n]
            verdict = F.when(_hit(words[n], _positions(key, n, lv.hashes, lv.bits)), verdict).otherwise(F.lit(n % 2 == 1))
        return verdict if self.levels else F.lit(False)

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with a boolean column that says whether the key is listed."""
        if self.shards == 1:
            return df.withColumn(name, self.contains(key, [lv.words.select("words").scalar() for lv in self.levels]))
        shard = F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int")
        kept = df.columns
        df = df.withColumn("__shard", shard)
        for n, lv in enumerate(self.levels):
            df = df.join(lv.words.select(F.col("shard").alias("__shard"), F.col("words").alias(f"__w{n}")), "__shard", "left")
        return df.select(*[F.col(f"`{c}`") for c in kept], self.contains(key, [F.col(f"__w{n}") for n in range(len(self.levels))]).alias(name))


def build_cascade(universe: DataFrame, rate: float = 0.02, max_bits: int = 1 << 27) -> Cascade:
    """The cascade over a universe of distinct keys: columns key and listed (boolean).

    rate: wrong positives of each level. max_bits: largest filter that enters a plan as a literal; larger ones are
    dealt into shards of that size.
    """
    keys = written(universe.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    spark, levels = keys.sparkSession, []
    per_key = -math.log(rate) / math.log(2) ** 2
    hashes = max(1, round(per_key * math.log(2)))
    n_listed = keys.where("listed").count()
    shards = max(1, math.ceil(n_listed * per_key / max_bits))
    shard = F.pmod(F.xxhash64(F.lit(-1), F.col("key")), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    keys, want = keys.withColumn("shard", shard), True
    count = n_listed
    while count:
        bits = 64 * math.ceil(max(64, 1.1 * count * per_key / shards) / 64)
        n = len(levels)
        inside, outside = keys.where(F.col("listed") == want), keys.where(F.col("listed") != want)
        spots = inside.select("shard", F.explode(F.array(*_positions(F.col("key"), n, hashes, bits))).alias("p"))
        ones = spots.select("shard", F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        zeros = spark.range(bits // 64).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        full = ones.union(zeros).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
        table = full.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        levels.append(Level(written(table, f"level{n}"), bits, hashes))
        wrong = Cascade([Level(levels[-1].words, bits, hashes)], shards)
        wrong = _passed(wrong, outside, n)
        keys = written(inside.select("key", "listed", "shard").union(wrong), f"left{n}")
        want, count = not want, keys.where(F.col("listed") != want).count()
    return Cascade(levels, shards)


def _passed(one: Cascade, keys: DataFrame, level: int) -> DataFrame:
    """Those of the keys that this one level passes."""
    lv = one.levels[0]
    if one.shards == 1:
        return keys.where(_hit(lv.words.select("words").scalar(), _positions(F.col("key"), level, lv.hashes, lv.bits))).select("key", "listed", "shard")
    held = keys.join(lv.words, "shard")
    return held.where(_hit(F.col("words"), _positions(F.col("key"), level, lv.hashes, lv.bits))).select("key", "listed", "shard")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed: Column, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    listed: a condition on the column ``key`` that tells which hosts of the corpus are on the block list; it is
    evaluated once for each distinct host. The longest fitting rule decides, else membership in the cascade.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    u = F.col(f"`{url}`")
    universe = pages.select(host_of(u).alias("key")).distinct().withColumn("listed", listed)
    cascade = build_cascade(universe)
    parsed = pages.select(*kept, host_of(u).alias("host"), path_of(u).alias("path"))
    parsed = parsed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    parsed = cascade.mark(parsed, F.col("host"), "__listed")
    allowed = [r.text for r in rules if r.allow]
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block") if allowed else F.lit("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("__listed"), "block").otherwise("allow")
    return parsed.withColumn("verdict", verdict).drop("__listed")
