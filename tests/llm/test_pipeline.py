from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import empty_docs, odd_docs
from thermogrid.llm.queries import QUERIES, SQL, vocabulary
from thermogrid.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_run_on_all_that_was_kept_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    row = docs.where("length(text) > 2000").orderBy("doc_id").first()
    other = docs.where("length(text) > 2000").orderBy(F.desc("doc_id")).first()
    extra = [
        (900001, row["text"], row["lang"], "x", 1), (900002, bench + " " + row["text"][:900][::-1], row["lang"], "x", 1), (900003, "12 34", "en", "x", 1), (900004, None, None, None, None),
        (900005, other["text"][:700] + " token=0123456789abcdef0123456789abcdef", other["lang"], "x", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = out.columns
        out = stage(spark, out, SF)
        path = corpus_pipeline.scratch_path(spark)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        kept[name] = {r[0] for r in out.select("doc_id").collect()}
        if name != "tokenize":
            assert out.columns == before
        if name == "mask_secrets":
            assert "0123456789abcdef" not in out.where("doc_id = 900005").first()["text"]
            assert out.where("n_chars <> length(text)").count() == 0
    assert not kept["language"] & {900003, 900004}
    assert 900001 not in kept["near_duplicates"] and 900002 not in kept["decontaminate"]
    assert kept["mask_secrets"] == kept["decontaminate"] == kept["tokenize"]
    assert 900005 in kept["tokenize"]
    assert bpe.decode(out.select("doc_id", "ids"), vocabulary()).where("doc_id = 900005 and text like '%token=[SECRET]%'").count() == 1


def test_stages_bear_odd_rows(spark):
    out = odd_docs(spark, clash=False)
    for _, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark)
        stage(spark, out, SF).write.parquet(path)
        out = spark.read.parquet(path)
    assert out.where(F.col("text") == "x" if "text" in out.columns else F.lit(False)).count() == 0


def test_all_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_an_empty_table_goes_through_every_stage(spark):
    out = empty_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        columns = out.columns
        path = corpus_pipeline.scratch_path(spark)
        stage(spark, out, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.count() == 0 and (name == "tokenize" or out.columns == columns)


def test_clashing_columns_pass_untouched(spark):
    out = odd_docs(spark).withColumn("score", F.lit(2.5)).withColumn("base", F.lit("b"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = out.columns
        path = corpus_pipeline.scratch_path(spark)
        stage(spark, out, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == columns and out.where("score <> 2.5 or base <> 'b'").count() == 0, name


def test_languages_of_held_out_documents_are_recognised(spark):
    """No SQL states a trained model: accuracy on rows that it hasn't learnt from, and the rows without letters."""
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    judged = [r for r in rows if r["held_out"] and lang[r["doc_id"]][0] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in judged) >= 0.97 * len(judged) > 100
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1] or "")) and 0 <= r["score"] <= 1
