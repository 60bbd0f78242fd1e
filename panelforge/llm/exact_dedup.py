"""Exact deduplication through an extendible-hash index kept in shared files. DataFrame operations only.

1. Texts are normalised by deleting ASCII white space, hashed to 64 bits, and written as records without the text.
2. The directory maps the leading bits of a hash (a cell) to a bucket. It doubles until no bucket holds more than `capacity`
   hash values; a bucket spans as many cells as it needs not be split for. Texts with one hash can't be told apart by more
   bits: they are chained in their bucket.
3. A hash value that one row has alone needs no comparison; its entry is made from its record. For the others the texts
   themselves are needed. A bitmap of 2 ** `FILTER_BITS` bits says whose (a crowded one moves more texts, never fewer).
   Equal texts are combined by task before they are moved, so a hot group crosses the shuffle as one row per task. What is
   left finds its bucket in the directory and goes to the task that owns it, which chains the texts of each hash value and
   compares their bytes along the chain: equal neighbours become one entry, different ones the next link.
4. The index is written by key range, a row per hash value with its chain. A lost executor costs the rows of its range.
5. Documents look their entry up: cell, directory, bucket, hash value, and in the chain the digest. Records hold no text. A
   hot entry is one row on the index side, so adaptive execution can split the documents that meet it.

Defined cases: NULL text equals empty text, and texts of white space only are equal to it. Of equal texts the one with
the most code points stays, then the smallest doc_id; a NULL doc_id sorts after every other. Of repeated rows (same id, same
text) one stays. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written

CAPACITY = 4096
FILTER_BITS = 24
#: Doublings of the directory made at once when a bucket overflows.
DOUBLINGS = 4
WHITE = "[\\x20\\x09-\\x0D]+"

HashOf = Callable[[Column], Column]


def normalised(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _rows(docs: DataFrame, id_col: str, text_col: str, hash_of: HashOf) -> DataFrame:
    """Id, code points, normalised text and its hash."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        normalised(text_col).alias("body"),
    )
    return rows.withColumn("hash", hash_of(F.col("body")))


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth).alias("cell")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`keys` (hash): distinct hash values. The directory: `cell` (leading bits at the global depth), the local depth of its
    bucket, the bucket as the first cell that shares it, and how many hash values it holds."""
    total = keys.count()
    depth = max(1, math.ceil(math.log2(max(total, 1) / capacity + 1)) + DOUBLINGS)
    while True:
        cells = written(keys.groupBy(_cell(depth)).agg(F.count(F.lit(1)).alias("n")), "cells")
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth >= 63:
            break
        depth = min(63, depth + DOUBLINGS)  # a bucket that can be split overflows: the directory doubles
    levels = cells.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    prefix = F.col("cell").bitwiseAND(F.expr(f"-shiftleft(1L, {depth} - local_depth)"))
    levels = levels.withColumn("bucket", prefix)
    held = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("held"))
    return (
        levels.join(held, ["local_depth", "bucket"])
        .filter((F.col("held") <= capacity) | (F.col("local_depth") == depth))
        .groupBy("cell")
        .agg(F.min_by(F.struct("bucket", "local_depth", "held"), "local_depth").alias("b"))
        .select("cell", "b.bucket", "b.local_depth", "b.held", F.lit(depth).alias("global_depth"))
    )


#: Slot of a hash value in the bitmap.
_SLOT = f"shiftrightunsigned(xxhash64(hash), {64 - FILTER_BITS})"


def _bitmap(keys: DataFrame) -> Column:
    """Bits of the hash values that several rows have, as one array of 64-bit words: 2 ** FILTER_BITS bits, whatever the table."""
    slots = keys.filter("n > 1").selectExpr(f"{_SLOT} AS slot")
    drawn = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
    every = keys.sparkSession.range(1 << (FILTER_BITS - 6)).withColumnRenamed("id", "word").join(drawn, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(ordered, lambda x: x.bits).alias("bitmap")).scalar()


def _shared(bitmap: Column) -> Column:
    """Is the hash value of a row among those that several rows have?"""
    word = F.get(bitmap, F.expr(f"cast({_SLOT} div 64 AS int)"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast({_SLOT} % 64 AS int))")) != 0


def _rank(points: str, doc_id: str) -> Column:
    """More code points first, then the smaller id, NULL last: one exact number, which keeps groupings hash aggregates."""
    last = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(Decimal(1 << 63)))
    return F.col(points).cast("decimal(10,0)") * F.lit(Decimal(1 << 64)) - last


def _chained(docs: DataFrame, records: DataFrame, keys: DataFrame, table: DataFrame, depth: int, names: tuple[str, str], hash_of: HashOf) -> DataFrame:
    """One row per distinct text: bucket, hash, place in the chain, digest, group size and the row that stays."""
    bitmap = _bitmap(keys)
    alone = records.filter(~_shared(bitmap)).select(
        "hash", "text_sha256", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points")
    )
    alone = alone.withColumn("cell", _cell(depth)).join(table, "cell").withColumn("chain", F.lit(1))

    rows = _rows(docs, *names, hash_of).filter(_shared(bitmap)).withColumn("cell", _cell(depth))
    combined = rows.groupBy("cell", "hash", "body").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("doc_id", _rank("points", "doc_id")).alias("doc_id"),
        F.max("points").alias("points"),
    )
    # to the owners: all texts of a bucket meet in one task, in the order of their hash values
    owned = combined.join(table, "cell").repartition("bucket")
    along = Window.partitionBy("bucket", "hash").orderBy("body")
    linked = owned.withColumn("chain", F.dense_rank().over(along))
    several = linked.groupBy("bucket", "hash", "chain").agg(
        F.sum("n").alias("group_size"),
        F.max_by("doc_id", _rank("points", "doc_id")).alias("keep_id"),
        F.max("points").alias("keep_points"),
        F.first("body").alias("body"),
    )
    several = several.select("bucket", "hash", "chain", F.sha2("body", 256).alias("text_sha256"), "group_size", "keep_id", "keep_points")
    return several.unionByName(alone.select(*several.columns))


def _index(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, hash_of: HashOf
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Records of all rows, the directory, the index and the global depth."""
    slim = _rows(docs, id_col, text_col, hash_of).withColumn("text_sha256", F.sha2("body", 256)).drop("body")
    records = written(slim, "records")
    keys = written(records.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "keys")
    table = written(directory(keys, capacity), "directory")
    depth = table.agg(F.max("global_depth")).first()[0] or 1
    entries = _chained(docs, records, keys, table.select("cell", "bucket"), depth, (id_col, text_col), hash_of)
    links = F.struct("chain", "text_sha256", "group_size", "keep_id", "keep_points")
    chains = entries.groupBy("bucket", "hash").agg(F.array_sort(F.collect_list(links)).alias("chain"))
    return records, table, written(chains.repartitionByRange("bucket", "hash"), "index"), depth


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: HashOf = F.xxhash64
) -> DataFrame:
    """The index table: one row per distinct text with its bucket and its place in the chain of its hash value."""
    index = _index(docs, id_col, text_col, capacity, hash_of)[2]
    return index.select("bucket", "hash", F.inline("chain"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: HashOf = F.xxhash64
) -> DataFrame:
    """Every document with the row that stays for its text, the size of its group and whether it is that row."""
    records, table, index, depth = _index(docs, id_col, text_col, capacity, hash_of)
    rows = records.groupBy("doc_id", "points", "hash", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    buckets = rows.withColumn("cell", _cell(depth)).join(table.select("cell", "bucket"), "cell")
    met = buckets.join(index, ["bucket", "hash"])
    link = F.filter("chain", lambda x: x.text_sha256 == F.col("text_sha256"))
    found = met.withColumn("link", F.get(link, F.lit(0)))
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    stays = F.col("doc_id").eqNullSafe(F.col("link.keep_id")) & (F.col("points") == F.col("link.keep_points")) & (F.col("copy") == 1)
    return copies.select("doc_id", F.col("link.keep_id").alias("keep_id"), F.col("link.group_size").alias("group_size"), stays.alias("kept"), "text_sha256")
