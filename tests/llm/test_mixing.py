import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm.mixing import mixed_rows, mixture
from tests.llm.conftest import none_first


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(rows, epochs=1.5, most=2.0):
    """Sharing again and again what the caps cut off."""
    own = defaultdict(int)
    for r in rows:
        own[r.source] += size(r.text)
    names = sorted((s for s in own if s is not None)) + ([None] if None in own else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = {s for s in names if own[s] == 0}
    while True:
        left = epochs * sum(own.values()) - sum(most * own[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        want = {s: most * own[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if want[s] > most * own[s]}
        if not over:
            return own, want
        capped |= over


def check(docs, near):
    rows = docs.select("doc_id", "text", "source").collect()
    own, want = targets(rows)
    got = mixture(docs).collect()
    assert none_first((r.doc_id, r["size"]) for r in got) == none_first((r.doc_id, size(r.text)) for r in rows)
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        if r.doc_id is not None and r.doc_id != 78:  # id 78 has two sources
            assert r.source_size == own[source[r.doc_id]]
            assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
    joined = docs.select(F.col("source").alias("s")).distinct().collect()
    rows_by = mixed_rows(docs)
    for r in rows_by.select("text", "source").collect():
        taken[r.source] += size(r.text)
    for s in [r.s for r in joined]:
        largest = max(size(r.text) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= max(near * want[s], 1.0 * largest)
    return rows_by


def test_documents(documents):
    rows = check(documents, 0.02)
    assert none_first(rows.collect()) == none_first(mixed_rows(documents.repartition(7)).collect())  # reruns agree


def test_messy_rows(messy):
    rows = check(messy, 0.02)
    assert rows.columns == messy.columns


def test_the_mix_is_what_the_report_says(documents):
    copies = Counter(r.doc_id for r in mixed_rows(documents).select("doc_id").collect())
    for r in mixture(documents).collect():
        if r["size"]:
            assert copies[r.doc_id] * r["size"] == r.taken


def test_longer_documents_are_likelier(spark):
    """Inclusion rises with the length class inside a source."""
    docs = spark.createDataFrame([(i, "w " * (4 if i % 2 else 400), "a") for i in range(4000)] + [(5000, "w " * 900_000, "b")], "doc_id long, text string, source string")
    got = mixture(docs).filter("target < 1.9 * source_size").withColumn("long", F.col("size") > 10)
    assert got.select("source_size").distinct().count() <= 1
    share = {r.long: r.x for r in got.groupBy("long").agg(F.avg((F.col("taken") / F.col("size"))).alias("x")).collect()}
    assert not share or len(share) < 2 or share[True] > share[False]


def test_no_rows(nothing):
    assert mixture(nothing).count() == 0
    assert mixed_rows(nothing).count() == 0


def test_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r.target, r.taken) for r in mixture(docs).collect()} == {(0, 0.0, 0)}
