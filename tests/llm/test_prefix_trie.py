import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import prefix_trie as module
from panelforge.llm.prefix_trie import Minima, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_brute_force(rows):
    """`rows` in the order of their turns."""
    own = defaultdict(list)
    for c, _, role, text in rows:
        if c is not None:
            own[c].append((role or "", text or ""))
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path) == d))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        up = min(nodes[path[:-1]])[0] if path else None
        out.append((min(members)[0], len(path), up, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"class": F.lit("c"), "depth": F.lit(1), "members": F.lit(2), "a": F.lit(3), "part": F.lit(4), "index": F.lit(5)})


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def some_rows(seed, n=260, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), n):
        size = rng.randrange(9)
        rows += [(c, t if t else None, rng.choice(["user", None]), rng.choice(["", None, "é😀", "hello", "a longer text"][:words])) for t in range(size)]
    return rows


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 4), (3, 60)])
def test_brute_force(spark, seed, partitions):
    """With 60 ranges nearly every run of members crosses ranges, and many ranges are empty."""
    rows = some_rows(seed, words=2 + seed)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = prefix_trie(table(spark, rows))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert result(got) == by_brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert result(prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) == by_brute_force([tuple(r) for r in rows])


def test_no_rows(spark):
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_a_single_conversation(spark):
    for c in (0, 7, 101):
        rows = [(c, 1, "user", "hi"), (c, 2, None, None), (None, 3, "user", "left out")]
        assert result(prefix_trie(table(spark, rows))) == by_brute_force(rows)


def test_all_turns_lost(spark):
    """No first conversation of the hundred: what the head replaces is gone, and the root is all that is left."""
    ids = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, t, "user", f"{c} {t}") for c in ids for t in range(2)]
    got = result(prefix_trie(table(spark, rows)))
    assert got == by_brute_force(rows) and len(got) == 1 and got[0][3:6] == (5, 0, 1)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    """A conversation that half of all repeat, and one with thousands of turns, cut into runs."""
    monkeypatch.setattr(module, "RUN", 16)
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(200) for t in range(6)]
    rows += [(100 * c, t, "user", f"turn {t}" if t < 40 else f"own {t}") for c in (500, 501) for t in range(300)]
    rows += [(100 * c, t, "user", f"turn {t}") for c in (502, 503) for t in range(150)]
    assert result(prefix_trie(table(spark, rows))) == by_brute_force(rows)


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(0, 1, "user", x) for x in "abcabc"]
    first = result(prefix_trie(table(spark, rows)))
    assert first == result(prefix_trie(table(spark, rows[::-1]))) and len(first) == 7


def test_long_text(spark):
    rows = [(0, 1, "user", "x" * 3_000_000), (100, 1, "user", "x" * 3_000_000), (200, 1, "user", "x" * 2_999_999)]
    assert result(prefix_trie(table(spark, rows))) == by_brute_force(rows)


def test_runs_by_halving_steps():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, 5, n)
        table = Minima(values)
        for depth in range(6):
            want_last, want_first = [], []
            for i in range(n):
                e = i - 1
                while e + 1 < n and values[e + 1] >= depth:
                    e += 1
                want_last.append(e)
                s = i + 1
                while s and values[s - 1] >= depth:
                    s -= 1
                want_first.append(s)
            at = np.arange(n)
            assert table.last_not_below(at, np.full(n, depth)).tolist() == want_last
            assert table.first_not_below(at, np.full(n, depth)).tolist() == want_first
        for i in range(n):
            assert table.over(np.full(n - i, i), np.arange(i + 1, n + 1)).tolist() == [values[i:j].min() for j in range(i + 1, n + 1)]
