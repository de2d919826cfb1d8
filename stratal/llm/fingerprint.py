"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL functions alone.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles of five words (with
fewer words, of all words as one shingle; without words it is empty). Sketches of parts merge into the sketch of the
whole. From sketches alone come the resemblance and containment of two texts and the count of distinct shingles.

Nulls and odd rows: a null text counts as the empty text, whose sketch is empty; two empty sketches resemble each
other fully, an empty and another one not at all. Rows that repeat with the same doc_id and text count once in the
order of documents and all keep their own result row; rows that share a doc_id are ordered by their text's hash; a null
doc_id comes first. An empty table gives an empty result, a table of one document is its own successor. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, same, text_of, words_of, written

SIZE = 5
K = 128


def shingles_of(words: Column, size: int = SIZE) -> Column:
    """Hashes of the shingles, in order."""


    def hashed(w: Column) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) >= size, run).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)


def sketch(words: Column, k: int = K, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles_of(words, size))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have; exact for sets up to k."""

    def share(union: Column) -> Column:
        common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))

    return let(merged(a, b, k), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, n = resemblance(a, b, k), distinct_count(a, k)
    both = j / (1.0 + j) * (n + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / n))


def printed(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each, highest first."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """docs with sketch (array), fingerprint (text) and n_shingles (estimate)."""
    s = docs.withColumn("sketch", sketch(words_of(text_of()), k, size))
    return s.withColumn("fingerprint", printed(F.col("sketch"))).withColumn("n_shingles", distinct_count(F.col("sketch"), k))


def successors(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Each document's key (doc_id, h) with length n and the next document's key (next_id, next_h), in ascending
    order of (doc_id, h), the first after the last; and whether any row repeats.

    Keys alone are sorted, by ranges, and numbered within each range; only one row for each range is looked at as a
    whole, to find what follows a range's last document.
    """
    keys = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), F.char_length(text_of()).cast("long").alias("n"))
    keys = keys.groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    keys = keys.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    keys = written(keys.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    ranges = keys.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    every = Window.orderBy("part")
    all_rows = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("last", F.coalesce(F.lead("first").over(every), F.min("first").over(all_rows)).alias("then"))
    keys = keys.join(F.broadcast(ranges), keys["at"] == ranges["last"], "left")  # a row for each range of the sort
    keys = keys.withColumn("next_at", F.coalesce("then", F.col("at") + 1)).drop("last", "then")
    after = keys.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("at").alias("next_at"))
    repeats = keys.agg(F.max("copies")).first()[0] or 0
    return keys.join(after, "next_at").select("doc_id", "h", "n", "next_id", "next_h"), repeats > 1


def compare_with_edits(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n/2) code points replaced by as many from the next document's start. Texts
    move once, to their successors only the part that the edit takes.
    """
    after, repeats = successors(docs)
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    once = rows.dropDuplicates(["doc_id", "h"]) if repeats else rows
    asked = after.select("next_id", "next_h", F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.col("n").alias("for_n"))
    given = once.join(asked, same(once["doc_id"], asked["next_id"]) & (once["h"] == asked["next_h"]))
    given = given.select("for_id", "for_h", F.substring("text", F.lit(1), F.expr("int(for_n div 2)")).alias("tail"), sketch(words_of(F.col("text")), k, size).alias("next_sketch"))
    both = rows.join(given, same(rows["doc_id"], given["for_id"]) & (rows["h"] == given["for_h"]))
    n = F.char_length("text")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "tail").alias("edited"), "next_sketch")
    both = both.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(words_of(F.col("text")), k, size).alias("own"), sketch(words_of(F.col("edited")), k, size).alias("changed"), "next_sketch")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("n_shingles"),
    )
