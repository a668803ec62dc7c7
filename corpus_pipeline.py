"""A cleaning pipeline over ``documents``: five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of ``docs``. Null, empty and blank texts pass every filter, but for named rows that
repeat each other. Rows without a doc_id are searched like others, by a working key from their text. Rows that
repeat doc_id (or lack it) and text count as one document in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, ngram_join, secrets_scan, sentencepiece_bpe, toxicity
from strandline.llm.common import arrow_limits, cut_lineage, only, picked, table

#: Near duplicates: words of a shingle and the least similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: The column that names a document in the stages that link rows.
KEY = "_working_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``: the doc_id or, where a text with words lacks one, a hash of the text in 2**62 to 2**63 - 1.

    So named documents come before unnamed ones. Unnamed rows without words have no key.
    """
    hashed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    unnamed = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), hashed)
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), unnamed))


def searched(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(KEY).alias("doc_id"), F.col("text").cast("string").alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, doesn't reject."""
    arrow_limits(spark)
    chain = toxicity.fit(*toxicity.inputs(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, or one without if all lack it."""
    arrow_limits(spark)
    rows = keyed(docs)
    found = ngram_join.near_duplicates(searched(rows.where(F.col(KEY).isNotNull())), SHINGLE, PERCENT)
    later = cut_lineage(found.where("component_id <> doc_id").select(F.col("doc_id").alias(KEY)).distinct())
    again = cut_lineage(rows.where(F.col(KEY).isNotNull()).groupBy(KEY).count().where("count > 1").select(KEY))
    first = picked(rows, later, "left_anti", KEY)
    once = picked(first, again, "left_anti", KEY)
    return once.unionByName(picked(first, again, "left_semi", KEY).dropDuplicates([KEY, "text"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    rows = keyed(docs)
    found = decontamination.contaminated(*decontamination.inputs(searched(rows), table(spark, sf_dir, "benchmark")))
    ids = cut_lineage(found.select(F.col("doc_id").alias(KEY)).distinct())
    return picked(rows, ids, "left_anti", KEY).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked in the text, and n_chars, where there is such a column, as it is then."""
    arrow_limits(spark)
    masked = secrets_scan.redact(docs, path="source" if "source" in docs.columns else None)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of every document's whole text."""
    arrow_limits(spark)
    path = sentencepiece_bpe.vocabulary_path()
    ids = sentencepiece_bpe.encode_column(only(docs, doc_id="long", text="string"), path, ["doc_id"])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can't express the classifiers and the tokenizer; tests hold each stage's rows against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
