import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline


def test_stages_keep_the_columns_of_documents(spark, sf_dir, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.cache()
        docs = stage(spark, before, sf_dir).cache()
        assert docs.schema.names == documents.schema.names, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    assert {r.shard for r in last.select("shard").distinct().collect()} == set(range(16))


def test_run_equals_the_stages(spark, sf_dir, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.exceptAll(docs).count() == 0 and got.count() == docs.count()


def test_messy_documents_run_through(spark, sf_dir, messy, nothing):
    for rows in (messy, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == rows.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.filter(F.col("slot").isNull()).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_its_query(n):
    more = {"op3_language_id_pages"}  # beside the one over documents
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_") and q not in more]) == 1


def test_pipeline_is_registered():
    assert "pipeline" in entry.queries()
