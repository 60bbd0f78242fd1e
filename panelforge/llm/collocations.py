"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A phrase is a run of words inside a piece of text; counts are kept per language. For every length of prefix, from one word
to `longest` - 1, a pass over the whole texts gives stripes, which are merged elementwise by their owners:

    prefix -> {next word: count, ..., anything else or nothing: count}

One merged stripe says three things. Its counters are the counts of the phrases one word longer (extensions). Their sum is
the count of the prefix itself (prefix total), which scores need for the parts of a phrase. The largest counter is the
most frequent longer phrase that begins with the prefix (subsumption maximum); the same counters, read by the phrase
without its first word, give the longer phrases that end with it. A phrase lies inside a longer one of nearly its own count
only if one of its two neighbours by a single word has such a count as well, so these two maxima decide.

What keeps it bounded:
* A phrase can reach `min_count` only if the phrases without its first and without its last word do. Their ids are kept in
  a bitmap of 2 ** `filter_bits` bits, which every task gets; what it rules out is counted as "anything else", so that
  totals stay exact. A crowded bitmap rules out less, but never a phrase that counts.
* A task combines the stripes of its texts before it sends them, and sends them packed, one row per owner.
* A prefix that begins at least 1/HOT of all words has its stripe dealt out by next word. There are at most HOT of these, so
  the list that tasks get is bounded.
* Only extensions that reach `min_count` leave their owner. From there on joins of Spark work on phrases that do.
* A task holds one small Arrow batch, the words of one block of text and at most SOME_WORDS words or SOME_ENTRIES entries.

Words and phrases are known by 64-bit hashes until the end. Passes are written to the shared folder one after the other, so
a lost executor costs its tasks only.

Defined cases: NULL text has no words; a NULL language is `und`, together with documents whose language says so. A row
that repeats counts again. An empty table, or one without frequent phrases, gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written
from panelforge.llm.words import byte_table, mix, rows_of, text_blocks, words_of

BREAKS = ".,;:!?\n\x0b\x0c\r"
WORDS = byte_table(" \t" + BREAKS)
HOT = 1024
#: Words, and entries of stripes, combined in a task before they are sent; entries, about, for one owner.
SOME_WORDS = 200_000
SOME_ENTRIES = 500_000
OWNED = 1_000_000
#: Rows and bytes of one Arrow batch, which the JVM and the Python worker of every running task hold. At Spark's 10,000 rows, a
#: batch of web texts, or of packed stripes, is tens of megabytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
SEGMENT = 1 << 16
#: Exact: the products have 38 digits at most.
SCORE = "cast((1000BD * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0))) div (cast(l AS decimal(17,0)) * cast(r AS decimal(17,0))) AS long)"

_CHAIN = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(10 if chr(c) in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = np.isin(np.arange(256), [ord(c) for c in BREAKS])


def _salt(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def follow(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Id of the phrase that goes on with a word."""
    return mix(prefix * _CHAIN + word)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For the passes that run inside; afterwards the session has its own settings again."""
    own = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in own.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _words(texts: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of words that reach `min_count`, with their hash and id, and (lang, n) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            langs, words, counts = ([lang for lang, own in seen.items() for _ in own], [w.decode() for own in seen.values() for w in own], [n for own in seen.values() for n in own.values()])
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = seen[lang]
                held -= len(own)
                own.update(text.as_py().encode().translate(_PLAIN).split())
                held += len(own)
                if held + len(seen) > SOME_WORDS:
                    yield rows()
                    held = 0
        if seen:
            yield rows()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = {v: _salt(v) for v in batch.column(0).unique().to_pylist()}
            salt = np.array([salts[v] for v in batch.column(0).to_pylist()], np.uint64)
            hashes = np.zeros(batch.num_rows, np.uint64)
            for at, end, data, offsets in text_blocks(batch.column(1)):
                hashes[at:end] = words_of(data, offsets, WORDS).hashes
            ids = mix(hashes + salt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.view(np.int64)), pa.array(ids.view(np.int64))], ["lang", "word", "n", "hash", "id"])

    every = written(texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    often = every.filter(F.col("n") >= min_count).mapInArrow(name, "lang string, word string, n long, hash long, id long")
    return written(often, "vocabulary"), written(every.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for every id. Tasks set bits in segments of the map, which are united by segment before they reach the driver,
    so that it gets 2 ** `bits` bits at most."""
    size = 1 << bits
    span = min(SEGMENT, size // 8)

    def some(parts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["segment", "bits"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.sort(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(slot // (8 * span), prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                segment = int(slot[i]) // (8 * span)
                own = np.zeros(8 * span, bool)
                own[slot[i:j] - segment * 8 * span] = True
                drawn = np.packbits(own, bitorder="little")
                parts[segment] = parts[segment] | drawn if segment in parts else drawn
        if parts:
            yield some(parts)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, drawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                drawn = np.frombuffer(drawn, np.uint8)
                parts[segment] = parts[segment] | drawn if segment in parts else drawn
        if parts:
            yield some(parts)

    out = np.zeros(size // 8, np.uint8)
    schema = "segment long, bits binary"
    for r in ids.mapInArrow(draw, schema).repartition("segment").mapInArrow(unite, schema).collect():
        out[r.segment * span : (r.segment + 1) * span] = np.frombuffer(r.bits, np.uint8)
    return out


def _inside(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = ids >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def entries_of(data: np.ndarray, offsets: np.ndarray, salt: np.ndarray, length: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, next word) of every place of whole texts whose `length` words may be frequent; next is 0 where nothing
    follows in the piece or what follows can't be frequent."""
    cuts = np.union1d(offsets, np.flatnonzero(_BREAK[data]))
    words = words_of(data, cuts, WORDS)
    row = np.searchsorted(offsets[1:], cuts[:-1], "right")  # of every piece
    piece = rows_of(words.first)
    left = words.first[1:][piece] - np.arange(len(piece))  # words from here to the end of the piece
    h = words.hashes
    here = np.flatnonzero(left >= length)
    prefix = mix(h[here] + salt[row[piece[here]]])
    for j in range(1, length):
        prefix = follow(prefix, h[here + j])
    may = _inside(prefix, bitmap)
    after = np.zeros(len(h) + 1, bool)  # by place: may the `length` words that begin there be frequent?
    after[here[may]] = True
    here, prefix = here[may], prefix[may]
    goes_on = (left[here] > length) & after[here + 1]
    return prefix, np.where(goes_on, h[np.minimum(here + length, len(h) - 1)], np.uint64(0))


def combined(prefix: np.ndarray, after: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes merged elementwise: every (prefix, next word) once, prefixes together."""
    order = np.lexsort((after, prefix))
    prefix, after, n = prefix[order], after[order], n[order]
    if not len(prefix):
        return prefix, after, n
    first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (after[1:] != after[:-1])]))
    return prefix[first], after[first], np.add.reduceat(n, first)


_PACKED = "owner int, prefixes binary, sizes binary, after binary, counts binary"
_STRIPE = "prefix long, total long, after array<long>, counts array<long>, ids array<long>"


def _stripes(texts: DataFrame, length: int, min_count: int, bitmap: np.ndarray, hot: np.ndarray, owners: int) -> DataFrame:
    """Merged stripes of all prefixes of `length` words: total (of a dealt-out stripe, of this part), and the extensions
    that reach `min_count` with their counts and ids."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, np.sort(hot)))

    def parts(prefix: np.ndarray, after: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        hot = shared.value[1]
        spread = np.isin(prefix, hot) if len(hot) else np.zeros(len(prefix), bool)
        key = mix(prefix + np.where(spread, after, np.uint64(0)) * _CHAIN)
        owner = ((key >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        order = np.argsort(owner, kind="stable")  # prefixes stay together
        prefix, after, n = prefix[order], after[order], n[order]
        edges = np.searchsorted(owner[order], np.arange(owners + 1))
        rows = []
        for r in range(owners):
            i, j = edges[r], edges[r + 1]
            if i < j:
                first = np.flatnonzero(np.concatenate([[True], prefix[i + 1 : j] != prefix[i : j - 1]]))
                rows.append((r, prefix[i:j][first].tobytes(), np.diff(first, append=j - i).astype(np.uint32).tobytes(), after[i:j].tobytes(), n[i:j].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "prefixes", "sizes", "after", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            columns = list(map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return combined(*columns)

        for batch in batches:
            salts = {v: _salt(v) for v in batch.column(0).unique().to_pylist()}
            salt = np.array([salts[v] for v in batch.column(0).to_pylist()], np.uint64)
            for at, end, data, offsets in text_blocks(batch.column(1)):
                prefix, after = entries_of(data, offsets, salt[at:end], length, shared.value[0])
                held.append(combined(prefix, after, np.ones(len(prefix), np.int64)))
                if sum(len(x[0]) for x in held) > SOME_ENTRIES:
                    held.append(taken())
                    if 2 * len(held[0][0]) > SOME_ENTRIES:
                        yield parts(*held.pop())
        if any(len(x[0]) for x in held):
            yield parts(*taken())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            prefixes, size, after, n = (np.frombuffer(b"".join(packed), t) for packed, t in zip(zip(*rows, strict=True), (np.uint64, np.uint32, np.uint64, np.int64), strict=True))
            rows.clear()
            prefix, after, n = combined(np.repeat(prefixes, size), after, n)
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            total = np.add.reduceat(n, first)
            keep = (after != 0) & (n >= min_count)
            ends = np.append(np.add.reduceat(keep, first, dtype=np.int64).cumsum(), 0)
            lists = [pa.ListArray.from_arrays(pa.array(np.roll(ends, 1).astype(np.int32)), pa.array(v[keep].view(np.int64))) for v in (after, n, follow(prefix, after))]
            return pa.RecordBatch.from_arrays([pa.array(prefix[first].view(np.int64)), pa.array(total), *lists], ["prefix", "total", "after", "counts", "ids"])

        now, rows = None, []
        for batch in batches:
            for owner, *packed in zip(*(c.to_pylist() if k == 0 else c for k, c in enumerate(batch.columns)), strict=True):
                if rows and owner != now:
                    yield done(rows)
                now = owner
                rows.append(tuple(x.as_buffer() for x in packed))
        if rows:
            yield done(rows)

    return written(texts.mapInArrow(send, _PACKED).repartition("owner").sortWithinPartitions("owner").mapInArrow(merge, _STRIPE), f"stripes-{length}")


def _cuts(phrases: DataFrame) -> DataFrame:
    """`phrases` (lang, words, id, a). One row per phrase and cut: ids of the part before and the part after it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = {v: _salt(v) for v in batch.column(0).unique().to_pylist()}
            salt = np.array([salts[v] for v in batch.column(0).to_pylist()], np.uint64)
            lists, ids = batch.column(1), batch.column(2).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            hashes, first = lists.flatten().to_numpy().view(np.uint64), np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = {}
                for i in range(size):
                    part[i, i + 1] = mix(hashes[first[rows] + i] + salt[rows])
                    for j in range(i + 1, size):
                        part[i, j + 1] = follow(part[i, j], hashes[first[rows] + j])
                for k in range(1, size):
                    sides = [pa.array(part[x].view(np.int64)) for x in ((0, k), (k, size))]
                    whole = [pa.array(np.full(len(rows), x, np.int32)) for x in (k, size)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), *whole, *sides], ["id", "cut", "words", "left", "right"])

    return phrases.select("lang", "words", "id").mapInArrow(cut, "id long, cut int, words int, left long, right long")



def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", filter_bits: int = 27) -> dict[str, DataFrame]:
    """Phrases of two to `longest` words with at least `min_count` occurrences, from the merged stripes.

    phrases (lang, words, id, a): words are hashes. totals (id, f): counts of all parts, from the prefix totals. longer (id, f):
    the most frequent phrase one word longer, at either end. vocabulary and sizes as from the word count."""
    with _small_batches(docs.sparkSession):
        return _frequent_phrases(docs, min_count, longest, lang_col, text_col, filter_bits)


def _frequent_phrases(docs: DataFrame, min_count: int, longest: int, lang_col: str, text_col: str, filter_bits: int) -> dict[str, DataFrame]:
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    vocabulary, sizes = _words(texts, min_count)
    every = sizes.agg(F.sum("n")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every // OWNED + 1)
    known = vocabulary.select("lang", F.array("hash").alias("words"), "id", F.col("n").alias("a"))
    phrases, totals, longer = [], [], []
    for length in range(1, longest):
        hot = known.filter(F.col("a") * HOT >= every).select("id").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        stripes = _stripes(texts, length, min_count, _bitmap(known.select("id"), filter_bits), hot, owners)
        totals.append(stripes.groupBy(F.col("prefix").alias("id")).agg(F.sum("total").alias("f")).filter(F.col("f") >= min_count))
        longer.append(stripes.filter("size(counts) > 0").select(F.col("prefix").alias("id"), F.array_max("counts").alias("f")))
        each = stripes.select("prefix", F.inline(F.arrays_zip("after", "counts", "ids")))
        heads = known.select("lang", "words", F.col("id").alias("prefix"))
        known = each.join(heads, "prefix").select("lang", F.concat("words", F.array("after")).alias("words"), F.col("ids").alias("id"), F.col("counts").alias("a"))
        known = written(known, f"phrases-{length + 1}")
        phrases.append(known)

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    whole = all_of(phrases)
    cuts = written(_cuts(whole), "cuts")
    # the phrase without its first word, which a longer one ends with
    longer.append(cuts.filter("cut = 1 AND words > 2").select("id", F.col("right").alias("tail")).join(whole.select("id", "a"), "id").select(F.col("tail").alias("id"), F.col("a").alias("f")))
    return {
        "phrases": whole,
        "cuts": cuts,
        "totals": written(all_of(totals), "totals"),
        "longer": all_of(longer).groupBy("id").agg(F.max("f").alias("f")),
        "vocabulary": vocabulary,
        "sizes": sizes,
    }


def collocations(
    docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, subsumed_percent: int = 100, lang_col: str = "lang", text_col: str = "text", filter_bits: int = 27
) -> DataFrame:
    """The first `top` phrases of each language by the score of their weakest cut, floor(1000 * a * n / (l * r)), without
    those that a longer phrase holds with at least `subsumed_percent` of their count."""
    found = frequent_phrases(docs, min_count, longest, lang_col, text_col, filter_bits)
    cuts, totals, sizes = found["cuts"], found["totals"], found["sizes"]
    candidates = found["phrases"].join(found["longer"].withColumnRenamed("f", "longest"), "id", "left").filter(
        F.coalesce(100 * F.col("longest") < subsumed_percent * F.col("a"), F.lit(True))
    )
    parts = (
        cuts.join(candidates.select("id", "lang", "words", "a").withColumnRenamed("words", "hashes"), "id")
        .join(totals.select(F.col("id").alias("left"), F.col("f").alias("l")), "left")
        .join(totals.select(F.col("id").alias("right"), F.col("f").alias("r")), "right")
        .join(sizes, "lang")
    )
    scored = parts.withColumn("score", F.expr(SCORE))
    weakest = (
        scored.groupBy("id")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"), *(F.first(c).alias(c) for c in ("lang", "hashes", "a", "n")))
        .select("id", "lang", "hashes", "a", "n", "w.score", "w.l", "w.r")
    )
    spelled = (
        weakest.select("*", F.posexplode("hashes").alias("place", "hash"))
        .join(found["vocabulary"].select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("id", "lang", "a", "l", "r", "n", "score")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelt"))  # `longest` words at most
        .withColumn("phrase", F.array_join(F.col("spelt.word"), " "))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of every share first, so that no task orders all phrases of a language
    share = F.pmod(F.col("id"), F.lit(64))
    shared = spelled.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    first = shared.filter(F.col("place") <= top)
    return (
        first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
