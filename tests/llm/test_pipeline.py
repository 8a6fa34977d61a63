import re

import corpus_pipeline
from corpus import documents, mixed
from pyspark.sql import functions as F

from ledgerlens.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_each_on_what_the_one_before_kept(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now, kept = docs, {}
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(f(spark, now, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name], now = out, out
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = docs.sparkSession.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    scores = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, toxicity.fit(docs, seen)).collect()}
    clean = {i for i, s in scores.items() if s < 0.5}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean
    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == set(first.values())
    assert {r.doc_id for r in kept["simhash_near_dedup"].collect()} <= set(first.values())
    assert kept["pii"].count() == kept["simhash_near_dedup"].count()
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in kept["pii"].collect()}
    ended = now.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("n <> m").count()
    assert ended == 0


def test_run_and_registered_names(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))


def test_stages_on_awkward_rows_and_empty_tables(spark):
    """Null ids and texts, repeated rows, long texts and clashing names pass every stage; the columns stay."""
    rows = mixed(spark)
    docs = documents(spark, rows)
    now = docs
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(f(spark, now, SF), name)
        if name == "toxicity":
            assert out.count() == len(rows)  # nothing here is toxic
        if name == "exact_dedup":
            texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}
            assert out.count() == len(texts)
        if name != "packing":
            assert out.columns == docs.columns
            assert f(spark, docs.limit(0), SF).count() == 0
        now = out
    assert now.count() > 0
    packing = dict(corpus_pipeline.STAGES)["packing"]
    assert packing(spark, docs.limit(0), SF).count() == 0
