"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its documents into shards of whole documents. For a shard it sorts the suffixes (word positions) by the
words that follow, to the depth of the window, and binary-searches every suffix of every benchmark item in that order:
one column of words narrows all searches at once. The range left at full depth is every verbatim occurrence, and such
matches are followed word by word to their end. All places of a range match to the depth it has; the deepest range that a
place of a document lies in, whichever suffix it belongs to, is the document's longest match.
Suffixes whose first words (two, or as many as the shortest item has) begin no benchmark suffix can't be visited by a
search that goes deeper, so they are not sorted in; documents without any match of two words are looked up word by word.

Words are compared by 64-bit hashes. The benchmark goes to the tasks in slices of `slice_bytes` of text, each sent on its own;
a task holds one shard and one slice at a time, searches all slices, and unites the words that were hit and the items that
were found before it counts. So a benchmark of any size gives exact counts in bounded memory; its cost grows with it.

Defined cases: NULL and empty texts have no words and are clean; an item without words occurs nowhere; an item shorter
than the window is one window; repeated documents get a row each; items with the same id count once; a NULL item id is
listed as empty text; of equally long matches the first place counts, then the smallest item id; without a match `longest`
is 0 and its place and item are NULL; an empty table on either side gives clean documents or no rows. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.words import LETTERS, Words, mix, rows_of, runs, text_blocks, words_of

WINDOW = 10
SLICE_BYTES = 4 << 20
_TABLE_BITS = 22


class Benchmark(NamedTuple):
    """The items of a slice, word after word. `suffix` holds the first `window` words from every position, `left` how many
    words the item has there, `rank` the place of each item's id among the sorted ids, `known` the distinct words and
    `known_item` the item with the smallest id that has them."""

    ids: list[str]
    suffix: np.ndarray
    left: np.ndarray
    item: np.ndarray
    words: np.ndarray
    at: np.ndarray
    window: int
    rank: np.ndarray
    known: np.ndarray
    known_item: np.ndarray


class Found(NamedTuple):
    """Per document of a shard."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[str]]
    longest: np.ndarray
    longest_at: np.ndarray
    longest_item: list[str | None]


def _columns(hashes: np.ndarray, positions: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The next `depth` words from each position, 0 beyond the end of its text."""
    at = positions[:, None] + np.arange(depth)
    inside = at < ends[:, None]
    return np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else at.astype(np.uint64)


def slice_of(ids: Sequence[str], texts: Sequence[str | None], window: int) -> Benchmark:
    hashes, lengths = [], []
    for _, _, data, offsets in text_blocks(pa.array(texts, pa.large_string())):
        found = words_of(data, offsets, LETTERS)
        hashes.append(found.hashes)
        lengths.append(np.diff(found.first))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    counts = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    positions = np.arange(len(words))
    item = np.repeat(np.arange(len(counts)), counts)
    rank = np.unique(np.array(ids, object), return_inverse=True)[1] if ids else np.zeros(0, np.int64)
    order = np.lexsort((rank[item], words))
    known, first = np.unique(words[order], return_index=True)
    return Benchmark(list(ids), _columns(words, positions, ends, window), ends - positions, item, words, positions, window, rank, known, item[order][first])


def send_benchmark(benchmark: DataFrame, window: int, slice_bytes: int, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """The benchmark as broadcast slices of about `slice_bytes` of text. The driver holds one slice at a time."""
    context, sent = benchmark.sparkSession.sparkContext, []
    ids: list[str] = []
    texts: list[str | None] = []
    size = 0
    for i, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        ids.append(i or "")
        texts.append(text)
        size += 3 * len(text or "")
        if size > 3 * slice_bytes:
            sent.append(context.broadcast(slice_of(ids, texts, window)))
            ids, texts, size = [], [], 0
    if ids:
        sent.append(context.broadcast(slice_of(ids, texts, window)))
    return sent


def _slices(sent: list[Broadcast]) -> Iterator[Benchmark]:
    """One slice at a time: of several, none stays in a task's memory after its search."""
    for b in sent:
        yield b.value
        if len(sent) > 1:
            b.__dict__.pop("_value", None)


def _narrow(column: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each wanted value inside its own sorted range of the column, for all ranges in step."""

    def bound(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            middle = (a + b) >> 1
            value = column[np.minimum(middle, len(column) - 1)]
            below = open_ & ((value <= wanted) if right else (value < wanted))
            a = np.where(below, middle + 1, a)
            b = np.where(open_ & ~below, middle, b)

    return bound(False), bound(True)


def _candidates(shard: Words, ends: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Positions whose first words begin some benchmark suffix (a hashed bit table may let a few others through)."""
    depth = min(2, int((bench.left[np.r_[True, bench.item[1:] != bench.item[:-1]]]).min()), bench.window)
    shift = np.uint64(64 - _TABLE_BITS)

    def key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(first * np.uint64(3) + second) >> shift

    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    if depth < 2:
        table[bench.suffix[:, 0] >> shift] = True
        return np.flatnonzero(table[shard.hashes >> shift])
    table[key(bench.suffix[:, 0], bench.suffix[:, 1])] = True
    if len(shard.hashes) < 2:
        return np.zeros(0, np.int64)
    keep = np.flatnonzero(table[key(shard.hashes[:-1], shard.hashes[1:])])
    return keep[keep + 1 < ends[keep]]


class _Matches(NamedTuple):
    """Places of matches in a shard, their lengths and items."""

    place: np.ndarray
    length: np.ndarray
    item: np.ndarray


def _joined(parts: list[_Matches]) -> _Matches:
    return _Matches(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _search_slice(shard: Words, row: np.ndarray, ends: np.ndarray, bench: Benchmark) -> tuple[_Matches, _Matches]:
    """All whole windows (with the window's own length), and for every document its longest matches."""
    none = _Matches(*(np.zeros(0, np.int64) for _ in range(3)))
    positions = _candidates(shard, ends, bench)
    if not len(positions):
        return none, none
    window = bench.window
    suffixes = _columns(shard.hashes, positions, ends[positions], window)
    order = np.lexsort(suffixes.T[::-1])
    array, suffixes = positions[order], suffixes[order]

    n = len(bench.at)
    low, high, depth = np.zeros(n, np.int64), np.full(n, len(array)), np.zeros(n, np.int64)
    deepest, owner = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    live = np.arange(n)
    for k in range(window):
        live = live[bench.left[live] > k]
        a, b = _narrow(suffixes[:, k], low[live], high[live], bench.suffix[live, k])
        live, a, b = live[a < b], a[a < b], b[a < b]
        low[live], high[live], depth[live] = a, b, k + 1
        # ranges of one depth are the same or apart: all their places match so far, with the smallest id of those that do
        order = np.lexsort((bench.rank[bench.item[live]], a))
        starts, first = np.unique(a[order], return_index=True)
        size = b[order[first]] - starts
        covered = runs(starts, size)
        deepest[covered], owner[covered] = k + 1, np.repeat(bench.item[live[order[first]]], size)

    # whole windows: every position left in the range, followed word by word to the end of the match
    starts_item = np.r_[True, bench.item[1:] != bench.item[:-1]]
    whole = np.flatnonzero((depth == window) | (starts_item & (depth == bench.left)))
    count = high[whole] - low[whole]
    places = array[runs(low[whole], count)]
    width, item = np.repeat(depth[whole], count), np.repeat(bench.item[whole], count)
    length, source = width.copy(), np.repeat(bench.at[whole], count)
    left = np.minimum(np.repeat(bench.left[whole], count), ends[places] - places) if len(places) else length
    going = np.flatnonzero(length < left)
    while len(going):
        going = going[shard.hashes[places[going] + length[going]] == bench.words[source[going] + length[going]]]
        length[going] += 1
        going = going[length[going] < left[going]]

    # the first place of the deepest ranges of every document
    some = np.flatnonzero(deepest)
    some = some[np.lexsort((array[some], -deepest[some], row[array[some]]))]
    some = some[np.r_[True, np.diff(row[array[some]]) != 0]] if len(some) else some
    return _Matches(places, width, item), _joined([_Matches(array[some], deepest[some], owner[some]), _Matches(places, length, item)])


def search_shard(shard: Words, slices: Iterable[Benchmark]) -> Found:
    """Everything the benchmark has in common with the documents of one shard."""
    n_rows = len(shard.first) - 1
    found = Found(np.diff(shard.first), np.zeros(n_rows, np.int64), [[] for _ in range(n_rows)], np.zeros(n_rows, np.int64), np.full(n_rows, -1), [None] * n_rows)
    if not len(shard.hashes):
        return found
    row = rows_of(shard.first)
    ends = shard.first[1:][row]
    hit = np.zeros(len(shard.hashes), bool)
    for bench in slices:
        if not len(bench.words):
            continue
        windows, matches = _search_slice(shard, row, ends, bench)
        edge = np.bincount(windows.place, minlength=len(hit) + 1) - np.bincount(windows.place + windows.length, minlength=len(hit) + 1)
        hit |= np.cumsum(edge[:-1]) > 0
        for r, i in np.unique(np.stack([row[windows.place], windows.item]), axis=1).T.tolist():
            found.items[r].append(bench.ids[i])

        seen = np.zeros(n_rows, bool)
        seen[row[matches.place[matches.length > 1]]] = True
        words = np.flatnonzero(~seen[row] & (found.longest[row] <= 1))
        at = np.minimum(np.searchsorted(bench.known, shard.hashes[words]), len(bench.known) - 1)
        single = bench.known[at] == shard.hashes[words]
        matches = _joined([matches, _Matches(words[single], np.ones(int(single.sum()), np.int64), bench.known_item[at[single]])])
        best = np.lexsort((bench.rank[matches.item], matches.place, -matches.length, row[matches.place]))
        best = best[np.r_[True, np.diff(row[matches.place[best]]) != 0]] if len(best) else best
        for i in best.tolist():
            r = row[matches.place[i]]
            new = (-int(matches.length[i]), int(matches.place[i] - shard.first[r]), bench.ids[matches.item[i]])
            if not found.longest[r] or new < (-int(found.longest[r]), int(found.longest_at[r]), found.longest_item[r]):
                found.longest[r], found.longest_at[r], found.longest_item[r] = -new[0], new[1], new[2]
    total = np.concatenate([[0], np.cumsum(hit)])
    found.n_hit[:] = total[shard.first[1:]] - total[shard.first[:-1]]
    return found


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: words, words inside an occurring window, the items found and their digest, and the longest
    verbatim match with its place (word index, from 0) and item."""
    sent = send_benchmark(benchmark, window, slice_bytes)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = (
        f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean, items array<string>, longest long, longest_at long, longest_item string"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(1)):
                f = search_shard(words_of(data, offsets, LETTERS), _slices(sent))
                items = [sorted(set(x)) for x in f.items]
                columns = [
                    batch.column(0).slice(at, end - at),
                    pa.array(f.n_words, pa.int64()),
                    pa.array(f.n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([_digest(x) for x in items]),
                    pa.array(f.n_hit > 0),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(f.longest, pa.int64()),
                    pa.array(f.longest_at, pa.int64(), mask=f.longest == 0),
                    pa.array(f.longest_item, pa.string()),
                ]
                names = [id_col, *(c.split()[0] for c in schema.split(", ")[1:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(search, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The documents without any word inside an occurring window, with all their columns."""
    sent = send_benchmark(benchmark, window, slice_bytes)
    text_at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(text_at)):
                f = search_shard(words_of(data, offsets, LETTERS), _slices(sent))
                yield batch.slice(at, end - at).filter(pa.array(f.n_hit == 0))

    return docs.mapInArrow(keep, docs.schema)
