import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.llm import exact_dedup as module
from panelforge.llm.exact_dedup import build_index, directory, exact_duplicates, normalised
from tests.llm.conftest import none_first


def by_brute_force(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", "", r.text or "")].append(i)
    out = []
    for text, members in groups.items():
        def rank(i):
            d = rows[i].doc_id
            return (-len(rows[i].text or ""), d is None, d or 0, i)

        best = min(members, key=rank)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[i].doc_id, rows[best].doc_id, len(members), i == best, digest) for i in members]
    return out


@pytest.mark.parametrize("capacity", [4096, 3])
def test_messy_rows(spark, messy, capacity):
    more = spark.createDataFrame([(500, "a b"), (500, "a  b"), (500, "ab"), (501, "a\tb"), (501, "a  b"), (None, "a  b"), (None, "zz")], "doc_id long, text string")
    docs = messy.select("doc_id", "text").unionByName(more)
    got = exact_duplicates(docs, capacity=capacity)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert none_first(got.collect()) == none_first(by_brute_force(docs.collect()))
    assert exact_duplicates(messy).count() == messy.count()


def test_documents(documents):
    assert none_first(exact_duplicates(documents).collect()) == none_first(by_brute_force(documents.collect()))


def test_no_rows(nothing):
    assert exact_duplicates(nothing).count() == 0


def test_buckets_split_until_they_fit(documents):
    index = build_index(documents, capacity=20)
    keys = index.select("hash").distinct()
    held = {r.bucket: r["count"] for r in index.groupBy("bucket").count().collect()}
    assert max(held.values()) <= 20
    table = directory(keys, 20).collect()
    depth = table[0].global_depth
    for r in table:  # a bucket is a prefix of the cell, and its parent would overflow
        span = 1 << (depth - r.local_depth)
        assert r.bucket <= r.cell < r.bucket + span
        if r.local_depth:
            parent = r.bucket & ~(2 * span - 1)
            assert keys.filter(F.shiftrightunsigned("hash", 64 - depth).between(parent, parent + 2 * span - 1)).count() > 20


def test_the_directory_doubles_until_crowded_prefixes_are_apart(spark):
    """Hash values that share their first 30 bits: no bucket overflows, however deep it has to go."""
    close = spark.createDataFrame([((5 << 40) + (i << 30),) for i in range(60)] + [((i + 9) << 55,) for i in range(40)], "hash long")
    table = {r.cell: r for r in directory(close, 4).collect()}
    assert max(r.held for r in table.values()) <= 4
    assert next(iter(table.values())).global_depth > 30


def same_for_equal_lengths(body):
    return F.xxhash64(F.length(body) % 7)


@pytest.mark.parametrize("capacity", [4096, 2])
def test_collisions_are_chained_and_bytes_compared(messy, documents, capacity):
    """A hash with seven values: nearly all texts collide, and only their bytes tell them apart."""
    for docs in (messy.select("doc_id", "text"), documents.limit(120)):
        got = exact_duplicates(docs, capacity=capacity, hash_of=same_for_equal_lengths)
        assert none_first(got.collect()) == none_first(by_brute_force(docs.collect()))
        index = build_index(docs, capacity=capacity, hash_of=same_for_equal_lengths)
        assert index.agg(F.max("chain")).first()[0] > 7 >= index.select("hash").distinct().count()


def test_the_result_comes_through_the_directory(documents, monkeypatch):
    """With a wrong or missing cell, documents don't find their entry."""
    whole = exact_duplicates(documents).count()
    right = module.directory

    def cut(keys, capacity):
        return right(keys, capacity).withColumn("least", F.min("cell").over(Window.partitionBy("global_depth"))).filter("cell > least").drop("least")

    monkeypatch.setattr(module, "directory", cut)
    assert 0 < exact_duplicates(documents).count() < whole


def test_only_texts_of_shared_hashes_are_moved(spark):
    """Alone in its hash value: no text behind an exchange."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    assert exact_duplicates(docs).filter("kept AND group_size = 1").count() == 300
    keys = docs.select(F.xxhash64(normalised("text")).alias("hash"), F.lit(1).alias("n"))
    shared = module._shared(module._bitmap(keys))
    assert keys.filter(shared).count() == 0
    twice = keys.withColumn("n", F.lit(2))
    assert twice.filter(module._shared(module._bitmap(twice))).count() == 300
