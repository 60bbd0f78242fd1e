import hashlib
import re

import pytest

from panelforge.llm.decontaminate import contamination, decontaminate
from tests.llm.conftest import none_first

LETTERS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(LETTERS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_brute_force(rows, items, window):
    where = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            where.setdefault(tuple(w[k : k + window]), set()).add(i or "")
    out = []
    for r in rows:
        w = words(r.text)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in where}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in where:
                    found |= where[tuple(w[i : i + n])]
                    hit[i : i + n] = [1] * n
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((r.doc_id, len(w), sum(hit), len(found), digest, sum(hit) > 0))
    return out


@pytest.fixture
def items(messy):
    rows = messy.collect()
    long = next(r.text for r in rows if r.doc_id == 79)
    w = long.split()
    return [
        ("1", " ".join(w[100:160])),
        ("1", " ".join(w[7000:7012])),  # the same id again
        ("2", " ".join(w[150:155] + ["nowhere"] + w[156:170])),
        (None, "The SAME text, in every one!"),
        ("one", "short"),
        ("empty", "?!"),
        ("null", None),
        ("absent", "not one of these words stands in that order anywhere here at all"),
        ("end", " ".join(w[-15:])),
    ]


def test_messy_rows(spark, messy, items):
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = contamination(messy, bench)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = messy.collect()
    want = by_brute_force(rows, items, 10)
    assert none_first(got.select(names).collect()) == none_first(want)
    left = decontaminate(messy, bench)
    assert left.columns == messy.columns
    assert left.count() == sum(not w[-1] for w in want)


def test_longest_match_and_its_place(spark, items):
    text = " ".join(["before"] * 5 + items[0][1].split() + ["after"] * 5)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(items[:1], "item_id string, text string")
    r = contamination(docs, bench).first()
    assert (r.longest, r.longest_at, r.longest_item, r.n_hit) == (60, 5, "1", 60)


def test_documents(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = contamination(documents, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    assert none_first(got.collect()) == none_first(by_brute_force(documents.collect(), items, 10))


def test_no_rows(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id string, text string")
    assert contamination(nothing, none).count() == 0
    assert decontaminate(messy, none).count() == messy.count()


def longest_by_brute_force(text, items):
    """(length, place, item) of the longest run of words that the text shares with an item."""
    w, best = words(text), (0, None, None)
    for item, body in items:
        v = words(body)
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n and (-n, i, item or "") < (-best[0], best[1] if best[0] else 0, best[2] or ""):
                    best = (n, i, item or "")
    return best


@pytest.mark.parametrize("slice_bytes", [1 << 22, 1, 200])
def test_longest_matches_of_any_length(spark, messy, items, slice_bytes):
    """Also below the window, of a single word, and with the benchmark in many slices."""
    bench = items[:8] + [("pair", "the same words nowhere"), ("solo", "xyzzy nobody qqq")]
    rows = [r for r in messy.select("doc_id", "text").collect() if len(words(r.text)) < 120][:45]
    bench += [("seven", " ".join(words(rows[3].text)[2:9])), ("more", " ".join(["before", *words(rows[5].text)[1:15], "after"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = contamination(docs, spark.createDataFrame(bench, "item_id string, text string"), slice_bytes=slice_bytes)
    got = found.select("doc_id", "longest", "longest_at", "longest_item").collect()
    assert none_first(got) == none_first((r.doc_id, *longest_by_brute_force(r.text, bench)) for r in rows)
    assert {1, 2} < {r.longest for r in got}


def test_a_deeper_match_elsewhere_hides_no_shallower_one(spark):
    """Both documents lie in one shard: the search goes deeper for one of them, the other keeps what it has."""
    docs = spark.createDataFrame([(1, "x a b y z"), (2, "q a b c d r"), (3, "a c"), (4, "d")], "doc_id long, text string").coalesce(1)
    bench = [("i", "a b c d e"), ("j", "k a b")]
    got = contamination(docs, spark.createDataFrame(bench, "item_id string, text string")).select("doc_id", "longest", "longest_at", "longest_item")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, "i"), (2, 4, 1, "i"), (3, 1, 0, "i"), (4, 1, 0, "i")]


@pytest.mark.parametrize("slice_bytes", [1, 150])
def test_slices_are_united_before_counting(spark, messy, items, slice_bytes):
    bench = spark.createDataFrame(items, "item_id string, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = contamination(messy, bench, slice_bytes=slice_bytes).select(names)
    assert none_first(got.collect()) == none_first(by_brute_force(messy.collect(), items, 10))
    assert decontaminate(messy, bench, slice_bytes=slice_bytes).count() == decontaminate(messy, bench).count()
