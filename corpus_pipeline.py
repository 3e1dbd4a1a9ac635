"""The corpus pipeline: language, near-duplicates, benchmark copies, secrets, tokens.

Each stage takes what its predecessor kept, written and read again. All but the last return the columns of
``documents``; texts that a stage changes have a new ``n_chars``.

Defined results: rows that repeat and rows of equal id go through the stages one by one, but for near-duplicates, where one row of a group stays; null ids,
sources and counts are kept as they are; texts of any length are taken whole; columns beyond those of ``documents``, whatever their names, pass the first four stages
untouched; an empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.llm import bpe, decontam, lang_id, secret_scan, simhash
from thermogrid.llm.queries import table, vocabulary
from thermogrid.llm.support import Store, fresh
from thermogrid.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the model learns from the given labels, as in the operator's query.

    Null and empty texts, and those without a letter, have no language and go; a null ``lang`` labels nothing; without any label no language is known and all go.
    """
    held = lang_id.fold(F.col("doc_id"), 4) == 2
    model = lang_id.train(docs.where(~held), key=F.xxhash64("doc_id"))
    names = [fresh(docs, n) for n in ("lang_pred", "lang_score", "lang_rejected")]
    out = lang_id.identify(docs, model, "text", *names)
    return out.where(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of the smallest id, one row of it if the id repeats. Null and empty texts are one group."""
    return simhash.keep_one(docs, Store(spark))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one. Null and empty texts and items match nothing; without items all stay."""
    hits = fresh(docs, "hits")
    out = decontam.contaminate(docs, table(spark, sf_dir, "benchmark"), hits)
    return out.where(F.size(hits) == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays. A null text stays null."""
    out = secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_samples(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null text has none."""
    out = bpe.encode(docs.select("doc_id", "text", "lang", "source"), vocabulary())
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: SQL can't express trained models, alignment or BPE: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
