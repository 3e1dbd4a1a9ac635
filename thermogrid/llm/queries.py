"""The registered queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.session import scratch_path

from . import bpe, chat, decontam, lang_id, merkle, nndescent, passages, ppm, secret_scan, simhash, spelling, url_filter, warc
from .oracle import SQL  # noqa: F401  (of those that SQL can express)
from .support import Store

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> dict:
    import public_tokenizers

    return bpe.load(public_tokenizers.path(name))


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score(docs, lang_id.fold(F.col("doc_id"), 7) == 2, Store(spark)).withColumnRenamed("id", "doc_id")


def op2_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nndescent.near_duplicates(vectors, Store(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Store(spark))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_text("fingerprint").alias("fingerprint"), "component_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"), Store(spark))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark)
    warc.write(pages, path, Store(spark))
    return warc.page_report(spark, path)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"), Store(spark)).withColumnRenamed("id", "doc_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lang_id.fold(F.col("doc_id"), 4) == 2
    model = lang_id.train(docs.where(~held), key=F.xxhash64("doc_id"))
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


#: The rules that the query's contract names.
URL_RULES = tuple(url_filter.Rule(*r) for r in (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, Store(spark))


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(tampered, merkle.leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF]))
    out = merkle.manifest(docs, LEAF, "lang", "doc_id", Store(spark), found)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    words = store.put(spelling.words_of(table(spark, sf_dir, "documents")))
    return spelling.variants(words, store).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_nndescent": op2_nndescent,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_passages": op9_passages,
    "op10_language": op10_language,
    "op11_urls": op11_urls,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}
