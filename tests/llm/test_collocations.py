import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.collocations import collocations, frequent_phrases


def by_brute_force(rows, min_count, longest, top, percent):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in held.items():
            if 100 * inside[p] >= percent * a and inside[p]:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "id": F.lit(2), "score": F.lit(0.5), "words": F.lit("w"), "rank": F.lit(7)})


def some_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "é", "a" * 70, "Über", "x-y", " nbsp", "san", "Francisco", "一", "😀"]
    rows = []
    for _ in range(150):
        words = [rng.choice(vocabulary[: rng.choice([3, 6, 13])]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice(["en", "en", "en", "fr", "und", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)))
    rows += [("en", "new york new york new york")] * 30  # overlapping occurrences, repeated rows
    rows += [("fr", None), (None, ""), ("en", " .,;:!? \n"), ("de", "one two three four five six. " * 20), ("", "no language name. " * 5)]
    return rows


@pytest.mark.parametrize(("min_count", "longest", "top", "percent", "bits"), [(5, 5, 2000, 100, 27), (3, 5, 7, 100, 6), (2, 3, 50, 60, 20)])
def test_brute_force(spark, min_count, longest, top, percent, bits):
    rows = some_rows()
    got = collocations(table(spark, rows), min_count, longest, top, percent, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == by_brute_force(rows, min_count, longest, top, percent)


def test_messy_rows(messy):
    want = by_brute_force([(r.lang, r.text) for r in messy.collect()], 6, 5, 2000, 100)
    assert sorted(map(tuple, collocations(messy, 6).collect())) == want and want


def test_documents(documents):
    want = by_brute_force([(r.lang, r.text) for r in documents.collect()], 20, 5, 300, 100)
    assert sorted(map(tuple, collocations(documents, 20, top=300).collect())) == want and want


def test_no_rows(spark, nothing):
    assert collocations(nothing).count() == 0
    assert collocations(table(spark, [("en", "too few words to count")])).count() == 0


def test_one_structure(spark):
    """Totals are the sums of the stripes, extensions their counters, and the longest neighbours their maxima."""
    found = frequent_phrases(table(spark, [("en", "a b c. a b d. a b c, x a b")] * 2), min_count=2)
    f = {r.id: r.f for r in found["totals"].collect()}
    a = {tuple(r.words): (r.id, r.a) for r in found["phrases"].collect()}
    word = {r.word: r.hash for r in found["vocabulary"].collect()}
    ab, abc = (word["a"], word["b"]), (word["a"], word["b"], word["c"])
    assert a[ab][1] == f[a[ab][0]] == 8 and a[abc][1] == 4
    longer = {r.id: r.f for r in found["longer"].collect()}
    assert longer[a[ab][0]] == 4  # of "a b c", "a b d" and "x a b"
    assert longer[a[word["b"], word["c"]][0]] == 4


def test_scores_beyond_64_bits(spark):
    from panelforge.llm import collocations as module

    rows = [("en", "p q " * 400 + ". " + "z " * 50_000)]
    want = by_brute_force(rows, 100, 5, 2000, 100)
    got = sorted(map(tuple, module.collocations(table(spark, rows)).collect()))
    assert got == want
    big = spark.createDataFrame([(3_000_000_000_000, 90_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, n long, l long, r long")
    score = big.select(F.expr(module.SCORE)).first()[0]
    assert score == 1000 * 3_000_000_000_000 * 90_000_000_000_000 // (4_000_000_000_000 * 5_000_000_000_000)


def test_hot_prefix_is_dealt_out(spark):
    """The stripe of a hot prefix lies in several parts, and their totals add up."""
    rng = random.Random(1)
    rows = [("en", " ".join(f"the w{rng.randrange(300)}" for _ in range(400))) for _ in range(20)]
    found = frequent_phrases(table(spark, rows), min_count=2)
    totals = found["totals"].join(found["vocabulary"].filter("word = 'the'"), "id").collect()
    assert [r.f for r in totals] == [8000]
    got = sorted(map(tuple, collocations(table(spark, rows), 2, 3).collect()))
    assert got == by_brute_force(rows, 2, 3, 2000, 100)


def test_long_text(spark):
    rows = [("en", "alpha beta gamma, " * 100_000)]
    assert np.array_equal(sorted(map(tuple, collocations(table(spark, rows)).collect())), by_brute_force(rows, 100, 5, 2000, 100))


class _Passes:
    """Takes the functions that the passes hand to tasks."""

    def __init__(self, spark):
        self.sparkSession, self.functions = spark, []

    def mapInArrow(self, function, schema):
        self.functions.append(function)
        raise NotImplementedError


def test_tasks_hold_little(spark):
    """Of 8 MB of text, counting words and sending stripes hold a block and some words or entries at a time."""
    import tracemalloc

    import pyarrow as pa

    from panelforge.llm import collocations as module

    rng = random.Random(2)
    words = [f"w{i}" for i in range(400_000)]
    texts = [" ".join(rng.choices(words, k=1500)) for _ in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 300), pa.array(texts[i : i + 300])], ["lang", "text"]) for i in (0, 300, 600)]
    passes = _Passes(spark)
    with pytest.raises(NotImplementedError):
        module._words(passes, 2)
    with pytest.raises(NotImplementedError):
        module._stripes(passes, 2, 2, np.full(1 << 10, 255, np.uint8), np.zeros(0, np.uint64), 4)
    for function, most in zip(passes.functions, (40e6, 130e6), strict=True):
        tracemalloc.start()
        assert sum(b.num_rows for b in function(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_small_batches(spark):
    """Passes get their rows in small Arrow batches; afterwards the session has its own settings again."""
    import pyarrow as pa

    from panelforge.llm import collocations as module

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    before = {k: spark.conf.get(k, None) for k in module.BATCHES}
    long = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 8000).alias("text"))
    with module._small_batches(spark):
        got = long.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 5000 and max(r.rows for r in got) <= 2000 and max(r.bytes for r in got) < 12 << 20
    assert collocations(table(spark, [("en", "a b c. " * 100)])).count() > 0
    assert {k: spark.conf.get(k, None) for k in module.BATCHES} == before
