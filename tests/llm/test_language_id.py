import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import language_id
from panelforge.llm.language_id import accepted, fit, fuse, host_of, identify, markup_language, page_text, suffix_of, _prepare
from panelforge.llm.registered import QUERIES


def test_held_out_accuracy(documents):
    """Half of the declarations are hidden: the other evidence has to give them back."""
    hidden = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang"))
    got = identify(documents, declared=hidden).join(documents, "doc_id").filter("doc_id % 2 = 1")
    right = got.filter(F.col("language") == F.col("lang")).count()
    assert right >= 0.97 * got.count()


def test_messy_rows(messy):
    got = {(r.doc_id, i): r for i, r in enumerate(identify(messy, F.col("lang"), None, F.col("source"), min_rows=5).collect())}
    assert len(got) == messy.count()
    by_id = {k[0]: r for k, r in got.items()}
    for i in (75, 76, 77, 81):  # no letters
        assert by_id[i].rejected and by_id[i].language is None
    assert not by_id[1].rejected and by_id[1].language == "en"
    kept = accepted(messy, F.col("lang"), None, F.col("source"))
    assert kept.columns == messy.columns
    assert kept.count() == sum(not r.rejected for r in got.values())


def test_without_any_evidence(spark, messy, nothing):
    assert identify(messy).filter("not rejected").count() == 0
    assert accepted(messy).count() == 0
    assert identify(nothing, F.col("lang"), None, F.col("source")).count() == 0
    assert accepted(nothing, F.col("lang")).count() == 0


def test_accepted_reads_texts_in_one_python_worker(spark, messy):
    """Every document that `identify` does not reject, and one step in Python, so that a task keeps one worker."""
    evidence = F.col("lang"), None, F.col("source")
    kept = accepted(messy, *evidence)
    assert len(re.findall(r"MapInArrow|ArrowEvalPython", kept._jdf.queryExecution().optimizedPlan().toString())) == 1
    got = identify(messy.filter("doc_id != 78"), *evidence).filter("not rejected").select("doc_id")
    same = accepted(messy.filter("doc_id != 78"), *evidence)
    assert same.count() > 50 and sorted(map(str, same.select("doc_id").collect())) == sorted(map(str, got.collect()))
    assert kept.exceptAll(messy).count() == 0


def test_blocks_of_any_size_give_the_same_documents(spark, messy, monkeypatch):
    evidence = F.col("lang"), None, F.col("source")
    few = accepted(messy, *evidence).collect()
    monkeypatch.setattr(language_id, "SCORED_BYTES", 100)
    assert sorted(map(str, accepted(messy, *evidence).collect())) == sorted(map(str, few))


def test_markup_and_address(spark):
    rows = [
        ('<!DOCTYPE html><HTML class="a" lang="de-AT"><p>', "https://user@www.Example.DE:80/fr/x"),
        ("<html><p lang='en'>", "http://a.b.c/english"),
        (None, None),
        ("", "no address"),
    ]
    got = spark.createDataFrame(rows, "html string, url string").select(markup_language("html"), host_of("url"), suffix_of("url")).collect()
    assert [tuple(r) for r in got] == [("de-AT", "www.example.de", "de/fr"), (None, "a.b.c", "c"), (None, None, None), (None, None, None)]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1>|<[^>]*>", " ")
    got = identify(pages.withColumn("text", text), markup_language("html"), suffix_of("url"), host_of("url"), id_col="page_id")
    joined = got.join(pages, "page_id")
    assert joined.filter(F.col("language") == markup_language("html")).count() >= 0.98 * joined.count()


def test_fusion_by_hand(spark):
    """Posterior of every row from the written formula, over the likelihoods of the text model."""
    texts = {"en": "the and of this with that from they", "de": "der und nicht auch mit dass von sie"}
    rows = [(i, texts[k], k, f"{h}.org") for i, (k, h) in enumerate([("en", "a"), ("en", "a"), ("de", "a"), ("de", "b"), ("en", "b"), ("de", "b")])]
    rows += [(6, "the und", None, "a.org"), (7, "the und", "de", "b.org"), (8, "von they", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    prepared = _prepare(docs, "text", F.col("lang"), None, F.col("host"))
    fitted, slim = fit(prepared, "doc_id", 1500, 1)
    scored = slim.orderBy("_lid_id").collect()
    text = np.array([r._lid_text for r in scored])

    def softmax(x):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    p = softmax(text)
    corpus = (p.sum(0) + 1) / (p.sum() + 3)
    for r, q, t in zip(fuse(slim, fitted, 0.0).orderBy("_lid_id").collect(), p, text):
        prior = corpus
        for column in ("_lid_domain", "_lid_host"):
            name = scored[r._lid_id][column]
            if name is not None:
                rest = np.maximum(p[[s[column] == name for s in scored]].sum(0) - q, 0)
                prior = (rest + 5 * prior) / (rest.sum() + 5)
        logs = t + np.log(prior)
        if r._lid_declared is not None:
            known = [s._lid_declared is not None for s in scored]
            counts = p[[s._lid_declared == r._lid_declared for s in scored]].sum(0)
            logs = logs + np.log((counts + 1) / (p[known].sum(0) + len({s._lid_declared for s in scored} - {None})))
        assert r._lid_confidence == pytest.approx(softmax(logs).max(), rel=1e-6)


def test_page_text(spark):
    rows = [
        ("<p>a&eacute;&amp;<!-- <b>x --> b<script>var t = '</p>';</SCRIPT >c<style>p{}</style>d 1 < 2", "aé& b c d 1 < 2"),
        ("x<script>never closed", "x"), ("x<!-- nor this", "x"), ("", ""), (None, None),
    ]
    got = spark.createDataFrame(rows, "html string, want string").select(page_text("html"), "want").collect()
    assert [r[0] and " ".join(r[0].split()) for r in got] == [r.want for r in got]


def test_registered_query_over_pages(spark, sf_dir, tmp_path):
    """Every page gets a row; of pages with the same few letters on one host, the address makes the difference."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    more = [(-1, "http://new.example.com/fr/1", "<p>a"), (-2, "http://new.example.com/de/1", "<p>a"), (-3, None, None)]
    pages.unionByName(spark.createDataFrame(more, pages.schema)).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op3_language_id_pages"](spark, str(tmp_path))
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == got.count() == pages.count() + 3
    declared = {r[0]: r[1] for r in pages.select("page_id", markup_language("html")).collect()}
    assert sum(rows[i].language == k for i, k in declared.items()) >= 0.98 * len(declared)
    assert abs(rows[-1].confidence - rows[-2].confidence) > 1e-3
    assert rows[-3].rejected
