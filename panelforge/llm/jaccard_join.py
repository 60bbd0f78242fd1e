"""N-gram Jaccard join as a T-occurrence search: which documents are linked by a chain of similar word-shingle sets?

Two sets x and y are linked when 100 * |x and y| >= percent * |x or y|. Then at least T = ceil(percent * |x| / 100)
shingles of x are shared, whatever y is.

1. Counting. Each task cuts its documents into blocks and sends, per range of hash values, the shingles of the block with
   their documents, as packed bytes, to the task that owns the range; a shingle that several of them have is sent once. That
   task sees which shingles occur in one document only and returns a count per document. A document with more than |x| - T such shingles can be linked with nothing; this
   settles most of the corpus. Half of the hash values suffice for it (fewer are counted, so no link is lost).
2. Classes. The remaining documents are read again; equal sets become one class, so a group of copies is one row from here
   on. Shingles are counted again among classes; only shared ones are kept. With m shared shingles, rarest first, some
   linked pair meets in the first m - T + 1 of each: the prefix. Classes that share a prefix shingle are tied to the
   smallest of them (one edge per class and shingle, never all pairs).
3. Search. Components of these ties are searched on their own, in one task each while they have at most `UNIT` classes
   (and twice SOME_TOKENS shingles).
   Larger ones are cut into bands of set size, of which only neighbours can hold linked sets, and bands into parts; every
   part, and every pair of parts that can hold a link, is searched, so that no task holds more than two parts and a pair of
   classes is met in one task only.
   Inside a task the inverted lists are divided: the longest are set aside, the others are merged and give the classes
   that occur T - (long lists) times; few such classes are looked up in the long lists by binary search, for many the long
   lists are counted. Of a shingle that most classes have, the classes that lack it are listed, so a dense group costs its
   differences. Every such class is verified, and every link is counted.
4. Each class leaves its task with one edge and the number of documents it is linked with there, never with its pairs. The
   edges are connected again, over all tasks, and the numbers are added up.

Shingles are 48-bit hashes of word hashes. Memory: a block, a range of the counts, or two units.

Defined cases: NULL and empty texts have 0 shingles and are linked with nothing; a text of fewer words than a shingle has
one shingle, its whole sequence, which differs from every longer one; repeated rows are linked as equal texts; rows with a
NULL id take part and never give a component its name, and a component of NULL ids only has a NULL name; an empty table
gives an empty result. Other columns may have any name but those starting with `_nj_`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written
from panelforge.llm.components import components
from panelforge.llm.words import SPACED, mix, rows_of, runs, text_blocks, words_of

BITS = 48
UNIT = 2000
#: Candidates up to which the long lists are searched and not counted.
LOOKUPS = 8
#: Shingles, about, in one range of hash values, one block of sets, or one unit of a large component.
SOME_TOKENS = 1_000_000
_DOC = np.uint64(64 - BITS)
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93,
            0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


class Sets(NamedTuple):
    """Sorted distinct shingles of each row, one row after the other, and where each row begins."""

    tokens: np.ndarray
    first: np.ndarray


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """T: the least number of shingles that a linked set shares with one of n."""
    return -(-(n * percent) // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Sets:
    """Shingle sets of at most 65,536 rows."""
    words = words_of(data, offsets, SPACED)
    h, first = words.hashes, words.first
    counts = np.diff(first)
    row = rows_of(first)
    places = np.arange(len(h))
    full = places[places + width <= first[1:][row]] if len(h) else places
    shingles = np.zeros(len(full), np.uint64)
    for j in range(width):
        shingles += h[full + j] * np.uint64(_FACTORS[j])
    owner = row[full]
    for m in range(1, width):
        short = np.flatnonzero(counts == m)
        whole = np.full(len(short), m, np.uint64) * np.uint64(_FACTORS[-1])
        for j in range(m):
            whole += h[first[short] + j] * np.uint64(_FACTORS[j])
        shingles, owner = np.concatenate([shingles, whole]), np.concatenate([owner, short])
    keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (mix(shingles) >> _DOC))
    return Sets(keys & np.uint64((1 << BITS) - 1), np.searchsorted(keys >> np.uint64(BITS), np.arange(len(counts) + 1)))


def digests(sets: Sets) -> list[bytes]:
    """16 bytes that depend on the set alone."""
    out = np.zeros((len(sets.first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(sets.first))
    if len(some):
        for k in range(2):
            out[some, k] = np.add.reduceat(mix(sets.tokens + np.uint64(_FACTORS[k])), sets.first[some])
    return [r.tobytes() for r in out]


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the leading ones of sorted values then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


#: Members of a block are numbered below this; it stands for "several of them" in what is sent to the ranges.
SEVERAL = (1 << 16) - 1
_BLOCK_SCHEMA = "block string, range int, size int, ids array<long>, counts array<int>, sets array<binary>, packed binary, often binary, times binary, members binary"
_ARROW_BLOCK = pa.schema(
    [("block", pa.string()), ("range", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
     ("sets", pa.list_(pa.binary())), ("packed", pa.binary()), ("often", pa.binary()), ("times", pa.binary()), ("members", pa.binary())]
)


def _block_rows(name: str, tokens: np.ndarray, owner: np.ndarray, size: int, bits: int, ranges: int, lists: dict, members: bool = False) -> pa.RecordBatch:
    """A block as one row per range of hash values. A shingle that several members have is sent once, with their number, so
    that a shingle found everywhere costs its owner an entry per block; with `members`, who has it stays in the row that also
    holds what is known of the members, which goes by way of a range that depends on the block."""
    packed = np.sort((tokens << _DOC) | owner.astype(np.uint64))
    token = packed >> _DOC
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    times = np.diff(first, append=len(token))
    many = times > 1
    sent = np.where(many, packed[first] | np.uint64(SEVERAL), packed[first])
    edges = np.searchsorted(sent >> _DOC, np.array([(r << bits) // ranges for r in range(ranges + 1)], np.uint64))
    home = zlib.crc32(name.encode()) % ranges
    rows = []
    for r in range(ranges):
        i, j = edges[r], edges[r + 1]
        if r == home or i < j:
            rows.append({"block": name, "range": r, "size": size, "packed": _pack(sent[i:j]), "times": times[i:j][many[i:j]].astype(np.uint32).tobytes()})
            if r == home:
                rows[-1] |= lists
                if members:
                    rows[-1]["members"] = _pack(packed[np.repeat(many, times)])
    return pa.RecordBatch.from_pylist(rows, _ARROW_BLOCK)


def _blocks(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """`docs` (id, text). One row per block and range of hash values; one of them also lists the documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in text_blocks(batch.column(1), rows=SEVERAL):
                sets = shingle_sets(data, offsets, width)
                name, number = f"{task}-{number}", number + 1
                half = sets.tokens < np.uint64(1 << (BITS - 1))
                lists = {"ids": ids.slice(at, end - at).to_pylist(), "counts": np.diff(sets.first).tolist(), "sets": digests(sets)}
                yield _block_rows(name, sets.tokens[half], rows_of(sets.first)[half], end - at, BITS - 1, ranges, lists)

    return docs.mapInArrow(cut, _BLOCK_SCHEMA)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of one range after the other: their rows, their packed shingles one block after the other, where each
    block begins, and in how many members of all blocks each of these shingles occurs."""
    held: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["range"], []).append(r)
    while held:
        rows = held.popitem()[1]
        parts = [_unpack(r.pop("packed")) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        packed = np.concatenate(parts)
        del parts
        weight = np.ones(len(packed), np.uint32)
        weight[(packed & np.uint64(SEVERAL)) == SEVERAL] = np.frombuffer(b"".join(r.pop("times") for r in rows), np.uint32)
        token = packed >> _DOC
        order = np.argsort(token, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) != 0, [True]])) if len(token) else np.zeros(1, np.int64)
        often = np.empty(len(token), np.uint32)
        if len(token):
            often[order] = np.repeat(np.add.reduceat(weight[order], edge[:-1]), np.diff(edge))
        yield rows, packed, first, often


def _single_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of whole ranges: how many shingles of each document are found in it alone. Passes the lists on."""
    for rows, packed, first, often in _ranges(batches):
        for i, r in enumerate(rows):
            here = slice(first[i], first[i + 1])
            alone = packed[here][often[here] == 1] & np.uint64((1 << 16) - 1)
            r["packed"] = np.sort(alone.astype(np.uint16)).tobytes()  # one entry per shingle, so no more than were sent
            yield pa.RecordBatch.from_pylist([r], _ARROW_BLOCK)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of whole ranges: the shingles that another class has too, and how many classes have them."""
    for rows, packed, first, often in _ranges(batches):
        for i, r in enumerate(rows):
            here = slice(first[i], first[i + 1])
            keep = often[here] > 1
            r |= {"packed": _pack(packed[here][keep]), "often": often[here][keep].tobytes()}
            yield pa.RecordBatch.from_pylist([r], _ARROW_BLOCK)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each block and lists its documents."""
    total: dict[str, np.ndarray] = {}
    lists: dict[str, dict] = {}
    for b in batches:
        for r in b.to_pylist():
            single = np.bincount(np.frombuffer(r["packed"], np.uint16), minlength=r["size"])
            total[r["block"]] = total.get(r["block"], 0) + single
            if r["ids"] is not None:
                lists[r["block"]] = r
    for name, r in lists.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["ids"], pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(r["sets"], pa.binary()), pa.array(total[name], pa.int64())],
            ["id", "n", "set", "single"],
        )


def count_documents(docs: DataFrame, width: int) -> DataFrame:
    """Per row of `docs` (id, text): size and digest of its set, and how many of its shingles no other row has."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(size / 5 / 2 / SOME_TOKENS))
    blocks = _blocks(docs, width, ranges).repartition(ranges, "range")
    counted = blocks.mapInArrow(_single_counts, _BLOCK_SCHEMA).repartition("block")
    return written(counted.mapInArrow(_documents, "id long, n long, set binary, single long"), "documents")


def read_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Sets of the wanted (id, set) rows, once per set: set, n, tokens. How many are wanted grows with the corpus, so the
    texts meet them by a sorted join, never by a broadcast."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), rows=1 << 16):
                sets = shingle_sets(data, offsets, width)
                tokens = pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(sets.tokens.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests(sets), pa.binary()), pa.array(np.diff(sets.first), pa.int64()), tokens], ["set", "n", "tokens"]
                )

    ids = wanted.groupBy("set").agg(F.min("id").alias("id"))
    text = docs.join(ids.select("id").distinct().hint("merge"), "id", "left_semi").select("text")
    found = text.mapInArrow(cut, "set binary, n long, tokens array<long>")
    return found.join(ids.select("set").hint("merge"), "set", "left_semi").dropDuplicates(["set"])


def _set_blocks(sets: DataFrame, ranges: int) -> DataFrame:
    """`sets` (set, n, tokens) in blocks like those of documents, over all hash values."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens, names, sizes = batch.column(2), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten().to_numpy().astype(np.uint64)
            first = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            while at < len(names):
                end = max(at + 1, int(np.searchsorted(first, first[at] + SOME_TOKENS, "right")) - 1)
                end = min(end, at + SEVERAL, len(names))
                name, number = f"{task}-{number}", number + 1
                owner = np.repeat(np.arange(end - at), lengths[at:end])
                lists = {"counts": sizes[at:end], "sets": names[at:end]}
                yield _block_rows(name, flat[first[at] : first[end]], owner, end - at, BITS, ranges, lists, members=True)
                at = end

    return sets.select("set", "n", "tokens").mapInArrow(cut, _BLOCK_SCHEMA)


def _by_rarity(percent: int):
    """Puts blocks together again: every class with its shared shingles, rarest first, and its prefix."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                blocks.setdefault(r["block"], []).append(r)
        while blocks:
            rows = blocks.popitem()[1]
            head = next(r for r in rows if r["sets"] is not None)
            packed = np.concatenate([_unpack(r["packed"]) for r in rows])
            often = np.concatenate([np.frombuffer(r["often"], np.uint32) for r in rows])
            # shingles that several members have: one entry came back, the members themselves are in the head
            many = (packed & np.uint64(SEVERAL)) == SEVERAL
            members = _unpack(head["members"])
            known = packed[many] >> _DOC
            place = np.argsort(known)
            at = place[np.searchsorted(known, members >> _DOC, sorter=place)] if len(members) else np.zeros(0, np.int64)
            packed, often = np.concatenate([packed[~many], members]), np.concatenate([often[~many], often[many][at]])
            owner, token = (packed & np.uint64((1 << 16) - 1)).astype(np.int64), (packed >> _DOC).astype(np.int64)
            order = np.lexsort((token, often, owner))
            first = np.searchsorted(owner[order], np.arange(head["size"] + 1))
            token, m, n = token[order], np.diff(first), np.array(head["counts"], np.int64)
            keep = np.flatnonzero(m >= need(n, percent))
            length, prefix = m[keep], (m - need(n, percent) + 1)[keep]
            lists = [
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(token[runs(first[keep], size)]))
                for size in (length, prefix)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([head["sets"][i] for i in keep], pa.binary()), pa.array(n[keep]), *lists], ["set", "n", "tokens", "prefix"]
            )

    return join


def shared_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """Per class its shingles that another class has too, rarest first, if there are at least T of them."""
    sets = written(sets, "sets")
    total = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(total / SOME_TOKENS))
    counted = _set_blocks(sets, ranges).repartition(ranges, "range").mapInArrow(_shared_only, _BLOCK_SCHEMA)
    found = counted.repartition("block").mapInArrow(_by_rarity(percent), "set binary, n long, tokens array<long>, prefix array<long>")
    return written(found, "shared")


def ties(shared: DataFrame) -> DataFrame:
    """One edge from every class to the smallest class with the same prefix shingle."""
    rows = shared.select("set", F.explode("prefix").alias("token"))
    least = written(rows.groupBy("token").agg(F.min("set").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "lists")
    return rows.join(least, "token").select(F.col("set").alias("a"), "b")


class Lists(NamedTuple):
    """Inverted lists, one after the other, as sorted keys shingle * n + class. `common` shingles are those that more than
    half of the listed classes have; `missing` has the lists of the classes that lack them, so that these are read instead."""

    n: int
    keys: np.ndarray
    start: np.ndarray
    common: np.ndarray
    missing: np.ndarray
    missing_start: np.ndarray


def _lists(rank: np.ndarray, owner: np.ndarray, shingles: int, n: int, listed: int) -> Lists:
    """The lists of the first `listed` of n classes."""
    mine = owner < listed
    keys = np.sort(rank[mine] * n + owner[mine])
    start = np.searchsorted(keys, np.arange(shingles + 1) * n)
    common = 2 * np.diff(start) > listed
    which = np.flatnonzero(common)
    lacks = np.ones((len(which), listed), bool)
    length = np.diff(start)[which]
    lacks[np.repeat(np.arange(len(which)), length), keys[runs(start[which], length)] % n] = False
    at, lacking = np.nonzero(lacks)
    missing = which[at] * n + lacking
    return Lists(n, keys, start, common, missing, np.searchsorted(missing, np.arange(shingles + 1) * n))


def _occurrences(lists: Lists, shingles: np.ndarray, end: int) -> np.ndarray:
    """How many of the shingles each of the first `end` classes has."""
    n, common = lists.n, lists.common[shingles]
    rare, often = shingles[~common], shingles[common]
    begin = lists.start[rare]
    has = lists.keys[runs(begin, np.searchsorted(lists.keys, rare * n + end) - begin)] % n
    begin = lists.missing_start[often]
    lacks = lists.missing[runs(begin, np.searchsorted(lists.missing, often * n + end) - begin)] % n
    return len(often) + np.bincount(has, minlength=end) - np.bincount(lacks, minlength=end)


def unit_links(
    tokens: list[np.ndarray], sizes: np.ndarray, copies: np.ndarray, percent: int, listed: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Every linked pair of one unit: a root per class after all these links, and per class how many documents the classes
    linked with it have. `sizes` are those of the full sets, `copies` the documents of a class. With `listed`, only pairs of
    one of the first `listed` classes and one of the others."""
    n = len(tokens)
    root, linked_with = np.arange(n), np.zeros(n, np.int64)
    held = n if listed is None else listed
    if not 0 < held or listed == n:
        return root, linked_with
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    known, rank = np.unique(np.concatenate(tokens), return_inverse=True)
    rank = rank.astype(np.int64)
    lists = _lists(rank, owner, len(known), n, held)
    first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    for q in range(1 if listed is None else listed, n):
        end = min(q, held)  # in the lists of all classes, those before q only: the head of each list
        mine = rank[first[q] : first[q + 1]]
        length = np.searchsorted(lists.keys, mine * n + end) - lists.start[mine]
        mine, length = mine[length > 0], length[length > 0]
        least = int(need(int(sizes[q]), percent))
        if len(mine) < least:
            continue
        mine = mine[np.argsort(length, kind="stable")]
        aside = min(least - 1, int(least / (0.0085 * math.log2(int(length.max()) + 1) + 1)))
        long_lists = mine[len(mine) - aside :]
        times = _occurrences(lists, mine[: len(mine) - aside], end)
        found = np.flatnonzero(times >= least - aside)
        found = found[(sizes[found] * 100 >= percent * sizes[q]) & (sizes[q] * 100 >= percent * sizes[found])]
        if not len(found):
            continue
        if len(found) <= LOOKUPS:
            probe = long_lists[:, None] * n + found
            at = np.minimum(np.searchsorted(lists.keys, probe), len(lists.keys) - 1)
            overlap = times[found] + (lists.keys[at] == probe).sum(axis=0)
        else:
            overlap = times[found] + _occurrences(lists, long_lists, end)[found]
        found = found[overlap * (100 + percent) >= percent * (sizes[q] + sizes[found])]
        if not len(found):
            continue
        linked_with[q] += copies[found].sum()
        linked_with[found] += copies[q]
        roots = np.unique(root[found])
        root[q] = roots[0]
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root, linked_with


def search_unit(tokens: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Roots of the classes of one unit after all links among them."""
    return unit_links(tokens, sizes, np.ones(len(tokens), np.int64), percent)[0]


def _units(shared: DataFrame, groups: DataFrame, copies: DataFrame, percent: int, unit: int) -> DataFrame:
    """Every class in every unit that has to hold it. Small components are one unit; larger ones are cut into bands of
    size and bands into parts, and a unit is a part or a pair of parts whose sizes allow a link. `side` says of which part of
    a pair a class is, so that a pair of classes belongs to one unit; it is -1 where all pairs of the unit count."""
    rows = shared.join(groups.select(F.col("node").alias("set"), "root"), "set").join(copies.hint("merge"), "set")
    held = F.greatest(F.count(F.lit(1)) / unit, F.sum(F.size("tokens")) / (2 * SOME_TOKENS))
    counts = written(rows.groupBy("root").agg(held.alias("held")), "members")
    rows = rows.join(counts, "root")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100) if percent < 100 else F.col("n")).cast("long")
    rows = written(rows.withColumn("band", F.when(F.col("held") > 1, band)), "banded")
    small = rows.filter("band IS NULL").select("root", F.lit("").alias("unit"), F.lit(-1).alias("side"), "set", "n", "copies", "tokens")
    large = rows.filter("band IS NOT NULL")
    parts = large.groupBy("root", "band").agg(F.ceil(2 * held).cast("int").alias("parts"))
    parts = written(parts, "parts")
    # rounding may put a size at the edge of a band into the next one; so two bands up are looked at
    near = F.explode(F.array(*[F.col("band") + d for d in range(-2, 3)]))
    large = large.join(parts, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    other = parts.select("root", F.col("band").alias("band2"), F.col("parts").alias("parts2"))
    large = large.withColumn("band2", near).join(other, ["root", "band2"])
    large = large.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    one = F.struct(F.col("band").alias("b"), F.col("part").alias("p"))
    two = F.struct(F.col("band2").alias("b"), F.col("part2").alias("p"))
    name = F.concat_ws(":", *[F.col(f"{s}.{x}").cast("string") for s in ("low", "high") for x in ("b", "p")])
    side = F.when(one == two, -1).when(one < two, 0).otherwise(1)
    large = large.withColumns({"low": F.least(one, two), "high": F.greatest(one, two), "side": side})
    return small.unionByName(large.select("root", name.alias("unit"), "side", "set", "n", "copies", "tokens"))


def links(shared: DataFrame, groups: DataFrame, copies: DataFrame, percent: int, unit: int) -> DataFrame:
    """Per class and unit with a link of it: an edge (a, b) to the root of the class there, and the documents of the classes
    linked with it there. The edges connect exactly the classes that are connected by links."""
    rows = _units(shared, groups, copies, percent, unit).withColumn("key", F.concat_ws("/", F.hex("root"), "unit"))
    rows = rows.select("key", "side", "n", "copies", "set", "tokens")

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        held.sort(key=lambda r: r[:2])
        side, sizes, copies = (np.array(x, np.int64) for x in list(zip(*held))[:3])
        listed = None if side[0] < 0 else int((side == 0).sum())
        root, linked_with = unit_links([r[4] for r in held], sizes, copies, percent, listed)
        some = np.flatnonzero(linked_with)
        if not len(some):
            return None
        sets = [[held[i][3] for i in x] for x in (some, root[some])]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.binary()) for x in sets], pa.array(linked_with[some])], ["a", "b", "linked_with"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, (k, *row) in enumerate(zip(*columns)):
                if k != key:
                    if len(held) > 1 and (out := solve(held)) is not None:
                        yield out
                    key, held = k, []
                held.append((*row, batch.column(5)[i].values.to_numpy(zero_copy_only=False).copy()))
        if len(held) > 1 and (out := solve(held)) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "a binary, b binary, linked_with long")


def linked_sets(docs: DataFrame, counted: DataFrame, width: int, percent: int, unit: int) -> DataFrame:
    """(set, root, linked_with) for every set that is linked with another one."""
    open_ = counted.filter((F.col("n") > 0) & (F.col("single") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    shared = shared_tokens(read_sets(docs, open_.select("id", "set"), width), percent)
    copies = open_.groupBy("set").agg(F.count(F.lit(1)).alias("copies"))
    found = written(links(shared, written(components(ties(shared)), "groups"), copies, percent, unit), "links")
    sums = found.groupBy(F.col("a").alias("set")).agg(F.sum("linked_with").alias("linked_with"))
    return written(components(found.select("a", "b")).select(F.col("node").alias("set"), "root").join(sums, "set"), "linked")


_LAST = (1 << 63) - 1


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids without NULL (the largest number stands for it) and texts."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _classes(counted: DataFrame, linked: DataFrame) -> DataFrame:
    """(set, component, n_links): the smallest id among all rows that a set is connected with, and with how many rows a row
    of the set is linked, its copies among them."""
    classes = counted.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    rooted = classes.join(linked, "set", "left").withColumn("root", F.coalesce("root", "set"))
    names = rooted.groupBy("root").agg(F.min("id").alias("component"))
    n_links = F.col("copies") - 1 + F.coalesce("linked_with", F.lit(0))
    return written(rooted.join(names, "root").select("set", "component", n_links.alias("n_links")), "classes")


def jaccard_links(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT
) -> DataFrame:
    """Every document with the size of its shingle set, the smallest id it is connected with and how many other documents it
    is linked with."""
    slim = _slim(docs, id_col, text_col)
    counted = count_documents(slim, width)
    classes = _classes(counted, linked_sets(slim, counted, width, percent, unit))
    found = counted.join(classes, "set", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return found.select(
        F.nullif("id", F.lit(_LAST)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("component", F.lit(_LAST)).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT
) -> DataFrame:
    """Every document with the size of its shingle set and the smallest id it is connected with."""
    return jaccard_links(docs, width, percent, id_col, text_col, unit).drop("n_links")


def one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT
) -> DataFrame:
    """The documents with all their columns, but of each component only the row with the smallest id (of equal rows with
    that id, one). Documents without words stay."""
    slim = _slim(docs, id_col, text_col)
    counted = count_documents(slim, width)
    classes = _classes(counted, linked_sets(slim, counted, width, percent, unit))
    keep = counted.join(classes, "set").filter("id = component").select(F.col("set").alias("_nj_set"), F.col("id").alias("_nj_id")).distinct()
    keep = written(keep.withColumn("_nj_kept", F.lit(True)), "keep")
    names = docs.columns
    text_at = names.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(text_at), rows=1 << 16):
                sets = shingle_sets(data, offsets, width)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(digests(sets), pa.binary()), pa.array(np.diff(sets.first) == 0)], [*names, "_nj_set", "_nj_empty"]
                )

    schema = docs.withColumns({"_nj_set": F.lit(b""), "_nj_empty": F.lit(True)}).schema
    rows = docs.mapInArrow(add, schema).withColumn("_nj_id", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    rows = rows.join(keep, ["_nj_id", "_nj_set"], "left").filter(F.col("_nj_kept") | F.col("_nj_empty"))
    order = Window.partitionBy("_nj_id", "_nj_set").orderBy(F.xxhash64(*names))
    return rows.withColumn("_nj_place", F.row_number().over(order)).filter((F.col("_nj_place") == 1) | F.col("_nj_empty")).select(*names)
