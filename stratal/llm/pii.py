"""Personal data: patterns find entities, corpus co-occurrence finds further terms that give them away.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers. For a term t that stands in a
document of an entity e, at any distance, the corpus gives pmi(t; e) = log2(N n(e,t) / (n(e) n(t))) and the entity's
information content ic(e) = log2(N / n(e)), from numbers of documents: n(e) that hold e, n(t) that hold the word t,
n(e,t) that hold both. t discloses e to the degree pmi / ic, at most 1. Terms at or over the threshold, with n(e,t) of
at least ``support``, are taken out wherever they stand, in documents without e as well: words that contain digits are
generalised to [NUMBER], others removed in favour of [TERM]; entities become [EMAIL], [IP], [CARD] and [PHONE]. Words
that touch an entity are no terms. All of it runs as SQL functions. Counts are summed before they are shuffled, so hot
terms and entities cost a row for each task. Bits of the disclosing terms, and then of the rows that hold one, go to the
texts: only words and texts that pass them move to a join, which decides, and so does the same share at every size.

Nulls and odd rows: a null or empty text has no spans. Rows that repeat are each counted and each answered. Spans of
one kind never overlap; spans of different kinds may, and sanitising merges those. Further columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, let, text_of, words_of, written
from .url_filter import _hit, _positions

KINDS = ("email", "ip", "card", "phone")
#: Marks for a span's ends and for a replaced character; where a text has them itself, _NONE stands in.
_OPEN, _CLOSE, _OTHER, _NONE = "\x02", "\x03", "\x01", "\ufffd"
_SPAN = "array<struct<start:int,end:int,value:string>>"
#: Size of the largest sieve. Keys beyond it make it pass more of the others; none of its own is lost.
_MOST_BITS = 1 << 27


def matches(text: Column, pattern: str, marked: Column | None = None) -> Column:
    """Spans (start, end exclusive, value) of a pattern, leftmost and non-overlapping, in code points.

    The pattern runs once over the text and puts marks around what it finds; the spans' places are sums of the
    lengths between marks. marked: a text of the same length to look in, where the pattern can be told more simply.
    """
    look = text if marked is None else marked
    look = F.translate(look, _OPEN + _CLOSE, _NONE + _NONE)
    pieces = F.split(F.regexp_replace(look, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def placed(parts: Column) -> Column:
        zero = F.struct(F.char_length(F.get(parts, 0)).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            n = F.instr(piece, _CLOSE) - 1
            span = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"), F.substring(piece, F.lit(1), n).alias("value"))
            return F.struct((acc["at"] + F.char_length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), zero, step, lambda acc: acc["out"])

    return let(pieces, placed)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice, F.when(d >= 5, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def _emails(text: Column) -> Column:
    # a dot with no label on one side ends a host name: it is replaced, so that what remains is one class of characters
    dots = F.regexp_replace(F.translate(text, _OTHER, _NONE), r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", _OTHER)
    # the replaced dot still belongs to what stands before the @; after a match the next may begin at once
    local = rf"A-Za-z0-9._%+{_OTHER}-"
    found = matches(text, rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*+", dots)
    return F.transform(found, lambda s: s.withField("value", F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def _ips(text: Column) -> Column:
    found = matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    return F.filter(found, lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _cards(text: Column) -> Column:
    joined = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", _OTHER)
    digits = lambda s: F.regexp_replace(s["value"], r"[\x20-]", "")
    found = matches(text, r"[0-9][0-9\x20-]*+", joined)
    return F.filter(found, lambda s: F.when(F.char_length(digits(s)).between(16, 19), _luhn(digits(s))).otherwise(False))


def _phones(text: Column) -> Column:
    found = matches(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    return F.filter(found, lambda s: F.char_length(F.regexp_replace(s["value"], "[^0-9]", "")).between(8, 15))


def with_entities(docs: DataFrame) -> DataFrame:
    """docs with a column for each kind: the array of its spans."""
    text = text_of()
    none = F.array().cast(_SPAN)
    some = docs.withColumn("__digit", text.rlike("[0-9]"))
    return some.withColumns({
        "email": F.when(F.contains(text, F.lit("@")), _emails(text)).otherwise(none),
        "ip": F.when(F.col("__digit"), _ips(text)).otherwise(none),
        "card": F.when(F.col("__digit"), _cards(text)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _phones(text)).otherwise(none),
    }).drop("__digit")


def _any(kinds: tuple[str, ...] = KINDS) -> Column:
    return reduce(lambda a, b: a | b, [F.size(k) > 0 for k in kinds])


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, by; in order) replaced; spans that overlap become the first one's ``by``."""
    kept = "struct<at:int,out:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kept)

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.when(s["start"] >= acc["at"], s["by"]).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], fresh).alias("out")).cast(kept)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, zero, step, rest)


def _together(held: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of documents by entity (n_e), and by entity and term that share documents (n_et), of at least support."""
    entity = lambda kind: F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), ascii_lower(s["value"])))
    each = held.select("__row", F.explode(F.array_distinct(F.concat(*map(entity, KINDS)))).alias("entity"))
    n_entity = each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    # an entity of fewer documents than support shares no more with any term
    listed = each.join(n_entity.select("entity"), "entity", "left_semi").groupBy("__row").agg(F.collect_list("entity").alias("entities"))
    gap = F.lit(_OPEN)
    marks = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), gap.alias("by"))) for k in KINDS]))
    # a word that touches an entity has a mark in it
    apart = F.filter(F.array_distinct(words_of(_replaced(F.translate(text_of(), _OPEN, _NONE), marks))), lambda w: ~F.contains(w, gap))
    terms = held.join(listed, "__row").select("entities", apart.alias("terms"))
    pairs = terms.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    return n_entity, pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)


def disclosing(docs: DataFrame, held: DataFrame, threshold: float, support: int) -> DataFrame:
    """entity, term, pmi, ic and degree of the terms that disclose an entity. docs: the corpus with a column text; held:
    its documents with entities, with their spans and a column __row."""
    n_entity, pairs = _together(held, support)
    pairs = written(pairs, "together")
    terms = pairs.select("term").distinct()
    counted = docs.select(F.explode(F.array_distinct(words_of(text_of()))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    n_term = counted.join(terms, "term", "left_semi")
    total = docs.agg(F.count("*").alias("n")).scalar()
    found = pairs.join(n_term, "term").join(n_entity, "entity").withColumn("n", total)
    pmi, ic = F.log2(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(F.col("n") / F.col("n_e"))
    found = found.withColumns({"pmi": pmi, "ic": ic})
    degree = F.when(F.col("ic") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pmi") / F.col("ic")))).otherwise(F.lit(0.0))
    return found.withColumn("degree", degree).where(F.col("degree") >= threshold).select("entity", "term", "pmi", "ic", "degree")


def _places(text: Column, terms: Column, taken: Column) -> Column:
    """Spans of the words of a text that are among terms, without those that touch a span of taken."""
    space = r"\x20\x09-\x0D"
    # each piece is a word and the space after it; the first may be space alone
    pieces = F.split(text, rf"(?<=[{space}])(?=[^{space}])")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        def told(word: Column) -> Column:
            end = acc["at"] + F.char_length(word)
            hit = F.array_contains(terms, word) & F.forall(taken, lambda s: (s["end"] <= acc["at"]) | (s["start"] >= end))
            span = F.struct(acc["at"].alias("start"), end.alias("end"), word.alias("value"))
            return F.when(hit, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

        out = let(ascii_lower(F.regexp_replace(piece, SPACE, "")), told)
        return F.struct((acc["at"] + F.char_length(piece)).alias("at"), out.alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def _sieve(keys: DataFrame, rate: float = 0.01, most: int = _MOST_BITS) -> Callable[[Column], Column]:
    """A test by bits alone that each key (the first column) passes, and others at about this rate."""
    spark, n = keys.sparkSession, max(1, keys.count())
    bits = 64 * math.ceil(min(most, -n * math.log(rate) / math.log(2) ** 2) / 64)
    hashes = max(1, min(round(-math.log2(rate)), round(bits / n * math.log(2))))
    spots = keys.select(F.explode(F.array(*_positions(F.col(keys.columns[0]), 0, hashes, bits))).alias("p"))
    ones = spots.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    zeros = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    full = ones.union(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = written(full.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")), "sieve")
    return lambda key: _hit(table.scalar(), _positions(key, 0, hashes, bits))


def find_personal_data(docs: DataFrame, threshold: float = 0.9, support: int = 2) -> DataFrame:
    """docs with a column of spans for each kind and for term."""
    own = [c for c in docs.columns if c not in (*KINDS, "term", "__row")]
    found = with_entities(docs.select(*[F.col(f"`{c}`") for c in own]))
    rows = written(found.withColumn("__row", F.monotonically_increasing_id()), "entities")
    told = written(disclosing(rows, rows.where(_any()), threshold, support).select("term").distinct(), "disclosing")
    each = rows.select("__row", F.explode(F.array_distinct(words_of(text_of()))).alias("term")).where(_sieve(told)(F.col("term")))
    hits = written(each.join(told, "term", "left_semi").groupBy("__row").agg(F.collect_list("term").alias("__terms")), "hits")
    near = _sieve(hits)(F.col("__row"))
    none = F.array().cast(_SPAN)
    term = F.when(F.col("__terms").isNotNull(), _places(text_of(), F.col("__terms"), F.concat(*KINDS))).otherwise(none)
    kept = [*[F.col(f"`{c}`") for c in own], *KINDS]
    # hits grow with the corpus: no broadcast while they are few, so that a small run moves what a large one does
    held = rows.where(near).join(hits.hint("merge"), "__row", "left").select(*kept, term.alias("term"))
    return held.union(rows.where(~near).select(*kept, none.alias("term")))


def digest(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start, joined with commas."""
    told = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
    return F.array_join(F.concat(*map(told, kinds)), ",")


def sanitised(text: Column) -> Column:
    """The text with its spans (columns of find_personal_data) generalised or removed."""
    label = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.when(s["value"].rlike("[0-9]"), "[NUMBER]").otherwise("[TERM]") if kind == "term" else F.lit(f"[{kind.upper()}]")).alias("by")))
    spans = F.array_sort(F.concat(*map(label, (*KINDS, "term"))))
    return _replaced(text, spans)
