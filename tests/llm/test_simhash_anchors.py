import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from panelforge.llm.simhash_anchors import LENGTH, PAIRS, RADIUS, close_pairs, cosets, fingerprint, remainder, replicas, simhash_components, stars
from tests.llm.conftest import none_first


def plain_fingerprint(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, threshold):
    """Root of every distinct fingerprint, by comparing all of them."""
    values = np.array(sorted(set(prints)), np.uint64)
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= threshold]:
            a, b = find(int(v)), find(int(w))
            root[max(a, b)] = min(a, b)
    return {int(v): find(int(v)) for v in values}


def by_brute_force(rows, width, threshold):
    prints = [plain_fingerprint(r.text, width) for r in rows]
    root = groups_of(prints, threshold)
    ids = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        ids[root[p]] += [r.doc_id] if r.doc_id is not None else []
    return [(r.doc_id, f"{p:016x}", min(ids[root[p]], default=None)) for r, p in zip(rows, prints, strict=True)]


@pytest.mark.parametrize("width", [4, 5])
def test_messy_rows(messy, width):
    got = simhash_components(messy, width=width, threshold=4)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert none_first(got.collect()) == none_first(by_brute_force(messy.select("doc_id", "text").collect(), width, 4))


def test_documents(documents):
    got = simhash_components(documents, width=4)
    assert none_first(got.collect()) == none_first(by_brute_force(documents.collect(), 4, 4))


def test_no_rows(nothing):
    assert simhash_components(nothing).count() == 0


def test_texts_without_words_are_linked(spark):
    rows = [(3, None), (2, ""), (9, " \n"), (1, "one"), (None, None)]
    got = {(r.doc_id, r.component_id) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 2), (2, 2), (9, 2), (1, 1), (None, 2)}


def test_a_component_of_null_ids_has_no_name(spark):
    got = simhash_components(spark.createDataFrame([(None, "nobody"), (1, "somebody else")], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(None, None), (1, 1)}


def test_the_code_is_perfect():
    assert (remainder(np.arange(1 << LENGTH, dtype=np.uint32)) == 0).sum() == 4096
    assert (np.diff(cosets(0)[0][1]) == 1).all()  # one code word within the covering radius of every word


@pytest.mark.parametrize("threshold", [1, 2, 3, 4, 5])
def test_linked_prints_meet_at_home(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 1, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1, dtype=np.uint64)
        y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, threshold, replace=False).astype(np.uint64))
        anchors, _, home = replicas(x, threshold)
        assert home.sum() == len(PAIRS) and len(np.intersect1d(anchors[home], replicas(y, threshold)[0]))
    code = anchors[home & (anchors >> np.uint64(46) == 0)].astype(np.int64)
    assert bin(int(code[0] & ((1 << 23) - 1)) ^ (int(x[0]) >> 22 & ((1 << 21) - 1))).count("1") <= RADIUS


def crowd(seed=5):
    """Chains of close prints, a dense crowd about one centre, lone prints, and pairs just too far apart."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(6):
            out.add(v)
            for b in rng.sample(range(64), rng.choice([3, 4, 4, 5])):
                v ^= 1 << b
    centre = rng.getrandbits(64)
    out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(1500)}
    out |= {rng.getrandbits(64) for _ in range(500)}
    return sorted(out)


@pytest.mark.parametrize("tile", [1 << 22, 64])
def test_crowds_chains_and_tiles(spark, tile):
    values = crowd()
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "print long")
    edges = close_pairs(rows, 4, tile).collect()
    if tile > 64:  # stars, not the pairs of the crowd
        assert len(edges) < 60 * len(values)
    a, b = (np.array([e[k] for e in edges], np.int64).view(np.uint64) for k in (0, 1))
    nodes, roots = stars(a, b)
    got = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert {v: got.get(v, v) for v in values} == groups_of(values, 4)


def test_long_text():
    text = "Word, " * 200_000 + "end"
    assert fingerprint(text, 4) == plain_fingerprint(text, 4)
