"""SimHash near-duplicates by anchor-point covering: which documents are linked by a chain of close fingerprints?

A fingerprint bit is 1 if it is set in more than half of the XXH64 values of the text's word shingles, repeats included.
Two fingerprints link at `threshold` or fewer differing bits.

1. Equal fingerprints become one, so a group of copies is one row from here on.
2. The 64 bits are cut into three blocks. Of two linked fingerprints, some pair of blocks differs in at most
   2 * threshold // 3 bits, so each of the three pairs of blocks is covered on its own.
3. The anchors of a pair of blocks are pairs of words of the binary Golay code of length 23 (shorter blocks are filled up
   with zeros). The code is perfect: every block lies within 3 bits, the covering radius, of exactly one code word. Its
   own pair of code words is the home of a fingerprint.
4. A fingerprint is replicated to every anchor within the covering radius plus the threshold of the pair: to the code words
   at most 3 + i and 3 + j bits off in the two blocks, i + j up to the threshold of the pair. The home of x then holds every
   y that is linked to x through this pair of blocks, whatever the texts are.
5. At every anchor the fingerprints at home there are compared with all that were sent there. Links are reduced to stars
   inside a task at once (a crowd of close fingerprints gives one edge each, never all pairs). An anchor with more than
   `TILE` comparisons is cut into tiles, which are dealt out to other tasks. Connected components come from star contraction.

A fingerprint has some 190 replicas of 12 bytes, whatever the corpus; they cross the shuffle packed by range of anchors.
The number of ranges follows the number of fingerprints, so a task's memory doesn't grow. Everything between the steps is
a table in the shared folder: a lost executor costs its tasks alone.

Defined cases: NULL text counts as empty; texts without words have fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle. Repeated rows each give a row. A NULL id takes part and never names a component;
a component of NULL ids only has a NULL name. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.scale import written
from panelforge.llm.components import components
from panelforge.llm.words import mix, runs

SEED = 42
LENGTH, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code, and the blocks of a fingerprint as (lowest bit, bits).
GOLAY = 0b110001110101
BLOCKS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Replicas, about, in one range of anchors; fingerprints replicated at once; comparisons made at once.
SOME_REPLICAS = 4_000_000
SOME_PRINTS = 16_384
TILE = 1 << 22

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int) -> int:
    """Words lie between ASCII white space, which is what bytes.split() takes for it."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist() or [len(joined)]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, len(ends)
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the fingerprint of every row's whole text, as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, print long")


def remainder(block: np.ndarray) -> np.ndarray:
    """Of a block as a polynomial divided by the generator: 0 for code words, the same for all words of a coset."""
    block = block.copy()
    for bit in range(LENGTH - 1, 10, -1):
        block ^= ((block >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY << (bit - 11))
    return block


@cache
def cosets(beyond: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0 to `beyond` bits beyond the covering radius: the differences from a word of each coset to its code words, and
    where each coset's begin. Within the radius there is one; further on those of exactly that many bits."""
    out = []
    for extra in range(beyond + 1):
        weights = range(RADIUS + 1) if not extra else (RADIUS + extra,)
        words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.uint32)
        coset = remainder(words)
        order = np.argsort(coset, kind="stable")
        out.append((words[order], np.searchsorted(coset[order], np.arange((1 << 11) + 1))))
    return out


def replicas(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of every fingerprint, the fingerprint's place, and whether the anchor is its home."""
    budget = 2 * threshold // 3
    tables = cosets(budget)
    blocks = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for low, bits in BLOCKS]
    rest = [remainder(b) for b in blocks]
    anchors, places, home = [], [], []
    for number, (p, q) in enumerate(PAIRS):
        for i in range(budget + 1):
            for j in range(budget + 1 - i):
                (left, at_left), (right, at_right) = tables[i], tables[j]
                n_right = at_right[rest[q] + 1] - at_right[rest[q]]
                total = (at_left[rest[p] + 1] - at_left[rest[p]]) * n_right
                row = np.repeat(np.arange(len(prints)), total)
                inside = runs(np.zeros(len(prints), np.int64), total)
                a = blocks[p][row] ^ left[at_left[rest[p][row]] + inside // n_right[row]]
                b = blocks[q][row] ^ right[at_right[rest[q][row]] + inside % n_right[row]]
                anchors.append((np.uint64(number) << np.uint64(46)) | (a.astype(np.uint64) << np.uint64(23)) | b)
                places.append(row)
                home.append(np.full(len(row), i + j == 0))
    return np.concatenate(anchors), np.concatenate(places), np.concatenate(home)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge per node: every node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least, most = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = least < most
        x, y = x[apart], y[apart]
        np.minimum.at(label, most[apart], least[apart])
        while (label != (up := label[label])).any():
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(homes: np.ndarray, first: np.ndarray, last: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each home with prints[first:last], as stars. At most about `TILE` comparisons are held at once."""
    sizes = last - first
    done = np.cumsum(sizes)
    a, b, at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    while at < len(homes):
        end = max(at + 1, int(np.searchsorted(done, done[at] - sizes[at] + TILE, "right")))
        x = np.repeat(homes[at:end], sizes[at:end])
        y = prints[runs(first[at:end], sizes[at:end])]
        close = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        a, b = stars(np.concatenate([a, x[close]]), np.concatenate([b, y[close]]))
        at = end
    return a, b


_REPLICA = "range int, n_home int, anchors binary, prints binary"
_FOUND = "a long, b long, tile binary, with binary"
_ARROW_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tile", pa.binary()), ("with", pa.binary())])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], schema=_ARROW_FOUND)


def _range_links(anchors: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Compares at every anchor of a range; what is too much for one task leaves as tiles."""
    order = np.lexsort((~home, anchors))
    anchors, prints, home = anchors[order], prints[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    last = np.append(first[1:], len(anchors))
    n_home = np.add.reduceat(home, first, dtype=np.int64)
    large = n_home * (last - first) > tile
    small = np.flatnonzero((n_home > 0) & (last - first > 1) & ~large)
    at = runs(first[small], n_home[small])
    bucket = np.repeat(small, n_home[small])
    yield _edges(*_links(prints[at], first[bucket], last[bucket], prints, threshold))
    side = max(1, int(tile**0.5))
    for k in np.flatnonzero(large):
        here = prints[first[k] : last[k]]
        for i in range(0, n_home[k], side):
            for j in range(0, len(here), side):
                row = {"tile": here[i : min(i + side, n_home[k])].tobytes(), "with": here[j : j + side].tobytes()}
                yield pa.RecordBatch.from_pylist([row], _ARROW_FOUND)


def close_pairs(prints: DataFrame, threshold: int = 4, tile: int = TILE) -> DataFrame:
    """`prints` (print): distinct fingerprints. Returns edges (a, b) whose components are those of all links."""
    spark = prints.sparkSession
    each = len(replicas(np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), threshold)[0]) // 4096 + 1
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * each // SOME_REPLICAS + 1)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), SOME_PRINTS):
                part = whole[at : at + SOME_PRINTS]
                anchors, places, home = replicas(part, threshold)
                key = mix(anchors + np.uint64(1))
                owner = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.lexsort((~home, owner))
                edges = np.searchsorted(owner[order], np.arange(ranges + 1))
                low, value, home = key[order].astype(np.uint32), part[places[order]], home[order]
                rows = [(r, int(home[i:j].sum()), low[i:j].tobytes(), value[i:j].tobytes()) for r in range(ranges) if (i := edges[r]) < (j := edges[r + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "n_home", "anchors", "prints"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            home = np.concatenate([np.arange(len(a) // 4) < n for n, a, _ in rows])
            anchors, values = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((1, np.uint32), (2, np.uint64)))
            return _range_links(anchors, values, home, threshold, tile)

        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["range"] != now:
                    yield from done(rows)
                    rows = []
                now = r["range"]
                rows.append((r["n_home"], r["anchors"], r["prints"]))
        if rows:
            yield from done(rows)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[k], np.uint64) for k in ("tile", "with"))
                a, b = _links(x, np.zeros(len(x), np.int64), np.full(len(x), len(y)), y, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    packed = prints.select("print").mapInArrow(replicate, _REPLICA)
    found = written(packed.repartition("range").sortWithinPartitions("range").mapInArrow(compare, _FOUND), "anchors")
    cut = found.filter("tile IS NOT NULL").select("tile", "with")
    return found.filter("tile IS NULL").select("a", "b").unionByName(cut.repartition(F.xxhash64("tile", "with")).mapInArrow(tiles, "a long, b long"))


def simhash_components(
    docs: DataFrame, width: int = 5, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE
) -> DataFrame:
    """Every document with its fingerprint and the smallest id among the documents that a chain of links reaches."""
    rows = written(fingerprints(docs, width, id_col, text_col), "prints")
    classes = written(rows.groupBy("print").agg(F.min("id").alias("id")), "classes")
    linked = components(close_pairs(classes, threshold, tile)).withColumnRenamed("node", "print")
    rooted = classes.join(linked, "print", "left").withColumn("root", F.coalesce("root", "print"))
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = written(rooted.join(names, "root").select("print", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(found, "print").select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
