"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage reads what the one before has written as Parquet. Toxic documents go; of documents that link by near-equal
shingle sets one stays; documents that hold a benchmark item go; personal data and what gives it away is generalised in
the texts; the texts become token ids and are decoded again. Null and empty texts pass all stages and end without ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.llm import decontaminate, jaccard_join, pieces, pii, toxicity
from stratal.llm.common import text_of, written
from stratal.llm.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REJECTED = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score below REJECTED; the grammar's weights come from the labels of these documents."""
    model = toxicity.learn_from(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("toxicity") < REJECTED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of links."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.with_leaks(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities and disclosing terms generalised or removed; n_chars follows the text."""
    found = pii.find_personal_data(docs.select(*COLUMNS))
    clean = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.sanitised(text_of())))
    return clean.withColumn("n_chars", F.char_length(text_of()).cast("long")).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text as decoded from its ids, ids and n_tokens."""
    vocabulary = pieces.load(MODEL)
    rows = pieces.encode_and_decode(docs.select(*COLUMNS), vocabulary)
    return rows.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", toxic), ("jaccard_join", near_duplicates), ("decontamination", contaminated), ("personal_data", personal), ("sentencepiece", tokenised)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
