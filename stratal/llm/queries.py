"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, jaccard_join, pieces, pii, pitman_yor, repeats, token_counts, toxicity, url_filter
from .common import text_of
from .ship import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


QUERIES["op2_fingerprints"] = op2_fingerprints


RULES = (
    url_filter.Rule("net", "/", allow=False),
    url_filter.Rule("example.net", "/en/", allow=True),
    url_filter.Rule("example.com", "/de/", allow=False),
    url_filter.Rule("org", "/fr/", allow=True),
)
#: Host labels on the block list.
BLOCKED_LABELS = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, BLOCKED_LABELS)))
    return url_filter.filter_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


QUERIES["op4_url_cascade"] = op4_url_cascade
_LABELS = ", ".join(f"'{x}'" for x in BLOCKED_LABELS)
ORACLES["op4_url_cascade"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), low AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM low
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(host, '.'), [{_LABELS}]) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(F.encode(pii.digest(pii.KINDS), "UTF-8"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.digest((*pii.KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))


QUERIES["op6_personal_data"] = op6_personal_data


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op7_benchmark_leaks"] = op7_benchmark_leaks
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op7_benchmark_leaks"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5
), iset AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5
), n AS (SELECT item_id, COUNT(*) AS n_shingles FROM iset GROUP BY 1
), hit AS (SELECT doc_id, item_id, COUNT(*) AS n_found FROM ds JOIN iset USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn_from(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.in_fold(3, 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


QUERIES["op5_toxicity"] = op5_toxicity


#: Where the public vocabularies are.
TOKENIZERS = "/opt/tokenizers"


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    vocabulary = pieces.load(model)
    docs = _table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    back = pieces.encode_and_decode(docs, vocabulary)
    fallback = F.size(F.filter("ids", lambda i: i.between(3, 258))).cast("long")
    return back.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), fallback.alias("n_byte_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


QUERIES["op9_sentencepiece"] = op9_sentencepiece


def op1_token_counts(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Three edits of every text: a replaced stretch, an inserted and a deleted one."""
    table = token_counts.read_ranks(ranks)
    n = F.char_length("text")
    place = lambda share, by=0: (F.floor(n * share).cast("int") + by)
    change = lambda start, end, by: F.struct(start.alias("start"), end.alias("end"), by.alias("replacement"))
    edits = F.array(change(place(0.25), place(0.25, 20), F.substring("text", 1, 30)), change(place(0.5), place(0.5), F.lit(" (revised 2024) ")), change(place(0.75), place(0.75, 40), F.lit("")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    before = token_counts.with_trees(docs, table).withColumns({"edits": edits, "n_chars": n.cast("long"), "n_tokens_before": F.col("n_tokens")})
    after = token_counts.edited(before, table)
    return after.select("doc_id", "n_chars", F.col("n_tokens_before").alias("n_tokens"), F.char_length("text").cast("long").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), F.size("tree.chars").cast("long").alias("n_leaves"), F.col("recounted").alias("recounted_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("edited_sha256"))


QUERIES["op1_token_counts"] = op1_token_counts


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op10_repeated_strings"] = op10_repeated_strings


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES["op8_jaccard_join"] = op8_jaccard_join
ORACLES["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1
), common AS (SELECT s FROM s GROUP BY 1 HAVING COUNT(*) > 1
), c AS (SELECT * FROM s SEMI JOIN common USING (s)
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), either_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT a AS x, b AS y FROM either_way UNION SELECT x, b FROM reach JOIN either_way ON y = a
), least AS (SELECT x, MIN(y) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON x = d.doc_id
"""


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op3_language_model"] = op3_language_model
