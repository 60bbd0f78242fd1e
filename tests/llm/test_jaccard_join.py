import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.jaccard_join import BITS, SEVERAL, _block_rows, _unpack, count_documents, jaccard_components, jaccard_links, one_of_each, search_unit, unit_links
from tests.llm.conftest import none_first

WHITE = "[^\x20\x09-\x0d]+"


def lower(w):
    return re.sub("[A-Z]", lambda m: m.group().lower(), w)


def sets_of(rows, width):
    for text in rows:
        w = [lower(x) for x in re.findall(WHITE, text or "")]
        yield frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def by_brute_force(rows, width, percent):
    """(id, set size, smallest id reachable) of every row."""
    sets = list(sets_of([r.text for r in rows], width))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    name = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            name[find(i)] = min(name.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, len(s), name.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("width", "percent", "unit"), [(3, 90, 2000), (5, 80, 4)])
def test_messy_rows(messy, width, percent, unit):
    got = jaccard_components(messy, width, percent, unit=unit)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert none_first(got.collect()) == none_first(by_brute_force(messy.collect(), width, percent))


def test_documents(documents):
    got = jaccard_components(documents, 3, 90).collect()
    assert none_first(got) == none_first(by_brute_force(documents.collect(), 3, 90))


def test_one_of_each_keeps_one_row_per_component(messy):
    kept = one_of_each(messy, 5, 80)
    assert kept.columns == messy.columns
    rows = messy.collect()
    want = set()
    for r, (i, n, name) in zip(rows, by_brute_force(rows, 5, 80)):
        if n == 0 or i == name:
            want.add((i, lower(r.text or "")))
    got = [(r.doc_id, lower(r.text or "")) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_rows(nothing):
    assert jaccard_components(nothing, 3, 90).count() == 0
    assert one_of_each(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_search_unit_finds_the_links(seed):
    """Dense groups with chains: every component, whatever is skipped."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10_000, 60, replace=False)
    tokens = []
    for _ in range(80):
        t = base.copy()
        t[rng.integers(0, 60, rng.integers(0, 7))] = rng.integers(10_000, 10_400, 1)
        tokens.append(np.unique(t[: rng.integers(50, 61)]))
    tokens.sort(key=len)
    sizes = np.array([len(t) for t in tokens])
    root = search_unit(tokens, sizes, 80)
    parent = list(range(80))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(80):
        for j in range(i):
            k = len(np.intersect1d(tokens[i], tokens[j]))
            if 180 * k >= 80 * (sizes[i] + sizes[j]):
                parent[find(i)] = find(j)
    want = [find(i) for i in range(80)]
    assert len(set(zip(root.tolist(), want))) == len(set(want)) == len(set(root.tolist()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (200, 250), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 250: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_group_is_one_class(messy):
    got = jaccard_components(messy.filter(F.col("source") == "hot"), 5, 80).collect()
    assert {r.component_id for r in got} == {100} and len(got) == 40


def links_by_brute_force(rows, width, percent):
    sets = list(sets_of([r.text for r in rows], width))
    where, out = defaultdict(list), [0] * len(rows)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                out[i] += 1
                out[j] += 1
    return [(r.doc_id, len(s), k) for r, s, k in zip(rows, sets, out)]


@pytest.mark.parametrize("unit", [2000, 4])
def test_links_of_every_document(spark, messy, unit):
    """Also in groups of many different texts, in one unit and over many."""
    base = [f"w{i}" for i in range(60)]
    near = [(1000 + i, " ".join([*base[: 60 - i % 7], *[f"x{i // 3}"] * (i % 3), "end"])) for i in range(60)]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = jaccard_links(docs, 3, 80, unit=unit)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    want = links_by_brute_force(docs.collect(), 3, 80)
    assert max(w[2] for w in want if (w[0] or 0) >= 1000) > 20
    assert none_first(got.drop("component_id").collect()) == none_first(want)


@pytest.mark.parametrize("listed", [None, 0, 1, 30, 80])
def test_unit_links_counts_every_pair(listed):
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 60, replace=False)
    tokens = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(48, 61)], rng.integers(20_000, 20_050, 2)])) for _ in range(80)]
    sizes, copies = np.array([len(t) for t in tokens]), rng.integers(1, 5, 80)
    want = np.zeros(80, np.int64)
    for i in range(80):
        for j in range(i):
            k = len(np.intersect1d(tokens[i], tokens[j]))
            if 180 * k >= 80 * (sizes[i] + sizes[j]) and (listed is None or j < listed <= i):
                want[i] += copies[j]
                want[j] += copies[i]
    assert unit_links(tokens, sizes, copies, 80, listed)[1].tolist() == want.tolist()
    assert want.any() or listed in (0, 80)


def test_a_shingle_in_every_document(spark):
    """One line that all share, in blocks of many rows and of few: sent once a block, counted for every document."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
        rows.append((i, f"all of them begin like this here {own if i % 5 else 'and a few go on alike to the end of it'}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_links(docs, width=3, percent=90).collect()}
    assert all(got[i] == (0 if i % 5 == 0 else i) for i in got)
    slim = docs.select(F.col("doc_id").alias("id"), "text")
    sizes = {r.id: (r.n, r.single) for r in count_documents(slim, 3).collect()}
    for i, (n, single) in sizes.items():
        assert single < n and (i % 5 or single == 0)


def test_what_a_block_sends():
    tokens = np.array([5, 5, 5, 9, 11, 11], np.uint64)
    owner = np.array([0, 1, 2, 0, 1, 2])
    batch = _block_rows("b", tokens, owner, 3, BITS, 1, {"sets": [b"x"] * 3, "counts": [2, 2, 2]}, members=True)
    r = batch.to_pylist()[0]
    sent = _unpack(r["packed"])
    assert (sent >> np.uint64(64 - BITS)).tolist() == [5, 9, 11]
    assert (sent & np.uint64(SEVERAL)).tolist() == [SEVERAL, 0, SEVERAL]
    assert np.frombuffer(r["times"], np.uint32).tolist() == [3, 2]
    assert len(_unpack(r["members"])) == 5
