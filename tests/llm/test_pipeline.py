"""The pipeline's stages in a row, and the queries whose SQL exists."""

from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import line_dedup, near_dedup, packing, registry
from test_line_dedup import brute as line_brute
from test_near_dedup import brute as near_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, small)
        out[name] = (docs, result)
        if name != "packing":
            assert result.columns == COLUMNS
            docs = spark.createDataFrame(result.collect(), result.schema)
    before, after = out["toxicity"]
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 2 and after.count() > 0.8 * before.count()

    before, after = out["line dedup"]
    want = {i: t for i, _, g, t in line_brute([(r["doc_id"], r["text"]) for r in before.collect()]) if g}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(got) == before.count() and all(got[i] == t for i, t in want.items())

    before, after = out["near dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, c in near_brute(rows, 0.8) if i == c)

    before, after = out["mixing"]
    times = after.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 2
    assert after.join(before, COLUMNS, "left_anti").count() == 0

    before, after = out["packing"]
    assert after.agg(F.sum("length")).first()[0] == packing.pieces(before).agg(F.sum("length")).first()[0]


def test_run_gives_the_last_stages_rows(spark, small):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert a == b and len(a) > 0


def test_queries_with_sql(spark, small):
    for name in ("op5_near_dedup", "op10_line_dedup"):
        assert_same(spark, small, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_registry_is_complete():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    assert line_dedup.MIN_DOCS == 5 and near_dedup.SHINGLE == 5


def test_stages_on_odd_rows(spark, small, odd_docs, no_docs, clashing):
    """Nulls, empty tables and columns of the stages' own names pass through all stages."""
    for docs in (odd_docs, no_docs, clashing):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, small)
            rows = result.collect()
            if name == "packing":
                assert len(rows) >= (1 if n else 0)
                break
            assert result.columns == columns
            assert result.schema == docs.schema or [f.dataType for f in result.schema] == [f.dataType for f in docs.schema]
            docs = spark.createDataFrame(rows, result.schema)


def test_toxicity_stage_without_labels(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity_stage(spark, odd_docs, str(tmp_path)).count() == odd_docs.count()
