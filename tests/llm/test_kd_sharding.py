import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm.kd_sharding import _orders, kd_shards, points, tree


def check(docs, shards):
    rows = kd_shards(docs, shards).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())))
    got = defaultdict(list)
    held, slots, members = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        got[r.doc_id].append((r.size, r.text_crc32))
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        members[r.text_crc32].add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return rows, held, members


def test_documents(documents):
    _, held, members = check(documents, 4)
    mean = sum(held.values()) / 4
    assert max(held.values()) < 1.1 * mean and min(held.values()) > 0.9 * mean
    assert sum(len(m) > 1 for m in members.values()) <= 4  # groups of copies travel together


def test_messy_rows(messy):
    check(messy, 8)


def test_a_group_with_most_bytes_is_cut(spark):
    docs = spark.createDataFrame([(i, "copy " * 50, "s") for i in range(900)] + [(i, f"own text {i}", "s") for i in range(900, 1000)], "doc_id long, text string, source string")
    _, held, _ = check(docs, 16)
    mean = sum(held.values()) / 16
    assert len(held) == 16 and max(held.values()) < 1.1 * mean and min(held.values()) > 0.9 * mean


def test_target_bytes_and_limits(documents, nothing):
    sizes = kd_shards(documents, None, 100_000).groupBy("shard").sum("size").collect()
    assert len(sizes) == 8
    assert kd_shards(nothing, 16).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        kd_shards(documents, 12)
    again = [r.shard for r in kd_shards(documents, 4).orderBy("doc_id").collect()]
    assert again == [r.shard for r in kd_shards(documents.repartition(5), 4).orderBy("doc_id").collect()]


def grown(rows, levels, node=0):
    """The same tree by sorting: {row: leaf}. `rows` are (key, size, orders)."""
    if not levels or not rows:
        return {key: node << levels for key, _, _ in rows}
    spans = [(max(r[2][d] for r in rows) >> 24) - (min(r[2][d] for r in rows) >> 24) for d in range(len(rows[0][2]))]
    dim = spans.index(max(spans))
    aim, before = sum(r[1] for r in rows) / 2, 0
    for value in sorted({r[2][dim] for r in rows}):
        held = sum(r[1] for r in rows if r[2][dim] == value)
        if before + held >= aim:
            break
        before += held
    cut = value + (before + held - aim < aim - before)
    sides = [[r for r in rows if (r[2][dim] >= cut) == right] for right in (False, True)]
    return grown(sides[0], levels - 1, 2 * node) | grown(sides[1], levels - 1, 2 * node + 1)


@pytest.mark.parametrize("levels", [1, 3, 5])
def test_the_tree_by_sorting(documents, messy, levels):
    """Weighted medians found by counting cells are those of sorted rows, leaf by leaf."""
    for docs in (documents, messy):
        rows = _orders(points(docs, "doc_id", "text", "source"), F.lit(500.0)).cache()
        held = rows.select("id", "crc", "member", "size", "at").collect()
        want = grown([((r.id, r.crc, r.member), r.size, list(r["at"])) for r in held], levels)
        got = tree(rows, levels).select("id", "crc", "member", "node").collect()
        assert len(got) == len(held) and all(want[r.id, r.crc, r.member] == r.node for r in got)
