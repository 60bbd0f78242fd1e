"""Sharding by a k-d tree: spaces of documents are split at distributed weighted medians until leaves are small enough.

The points are groups of equal texts, weighted by their bytes, so copies travel together. Their dimensions come from
metadata: length (logarithm of the bytes), source, and first id; each is scaled to 24 bits of its range over all
documents. Every node is split along the dimension that is widest in it. The order along a dimension is made total by 24
bits of a hash: of the group, so that it stays whole, or of the row if the group is heavier than `whole_share` of a leaf.
So a value, a source or a group of copies with a third of all bytes is cut like anything else.

The median of every node of a level is found by counting bytes per cell of the leading 16 bits of that order, then per
cell of the next 16 bits inside the middle cell, and so on: three aggregations over slim rows, the last of which is
exact. The tree is a table of cuts (one row per node); nothing of the documents passes through the driver.

Slots are gapless inside a shard: rows are dealt to blocks by hash, blocks are counted, and a row's slot is the number of
rows in blocks before its own plus its place in it. No task sorts a shard.

Defined cases: NULL text has no bytes (size 1) and equals empty text as a group; NULL metadata takes the lowest value;
rows equal in id and text share their place in the order and so their shard, with slots of their own; an empty table
gives an empty result; fewer rows than leaves leave leaves empty. Other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written

WHOLE_SHARE = 1 / 64
BLOCK_ROWS = 5000
_HALF_BITS = 24
_STEP_BITS = 16
DIMENSIONS = ("length", "source", "id")


def _hash24(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 64 - _HALF_BITS)


def points(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Slim rows, written once: id, bytes, checksum, hash of the text, and a hash of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("group"),
        _hash24(F.lit("source"), F.col(source_col)).alias("source"),
    )
    return written(rows.withColumn("member", F.xxhash64(F.lit("member"), "id", "group")), "points")


def _orders(rows: DataFrame, whole_below: Column) -> DataFrame:
    """Adds the total order along each dimension: 24 bits of its scaled value, then 24 bits of a hash."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.min("id").alias("first"), F.min("source").alias("origin"))
    groups = written(groups, "groups")  # a plain table, so that the join may split the rows of a hot group
    rows = rows.join(groups, "group")
    edges = rows.agg(
        F.min(F.log2("size")).alias("l0"), F.max(F.log2("size")).alias("l1"), F.min("first").alias("i0"), F.max("first").alias("i1")
    )
    top = float((1 << _HALF_BITS) - 1)
    rows = rows.crossJoin(F.broadcast(edges))  # one row

    def scaled(value: Column, low: str, high: str) -> Column:
        share = F.try_divide(value - F.col(low).cast("double"), F.col(high).cast("double") - F.col(low).cast("double"))
        return F.floor(F.coalesce(share, F.lit(0.0)) * top).cast("long")

    tie = F.when(F.col("weight") <= whole_below, _hash24(F.lit("tie"), F.col("group"))).otherwise(_hash24(F.lit("tie"), F.col("member")))
    values = (scaled(F.log2("size"), "l0", "l1"), F.col("origin"), scaled(F.col("first").cast("double"), "i0", "i1"))
    return rows.select(
        "id", "size", "crc", "member", F.array(*[F.shiftleft(v, _HALF_BITS) + tie for v in values]).alias("at")
    )


def _cuts(rows: DataFrame) -> DataFrame:
    """One row per node: the dimension it is cut along and the order from which rows go to the right."""
    spans = [F.shiftright(F.max(F.col("at")[i]), _HALF_BITS) - F.shiftright(F.min(F.col("at")[i]), _HALF_BITS) for i in range(len(DIMENSIONS))]
    widest = rows.groupBy("node").agg(F.array(*spans).alias("spans"), (F.sum("size") / 2).alias("aim"))
    state = widest.select(
        "node", (F.array_position("spans", F.array_max("spans")) - 1).cast("int").alias("dim"), "aim",
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"),
    )
    for left in range(2 * _HALF_BITS - _STEP_BITS, -1, -_STEP_BITS):
        order = F.get(F.col("at"), F.col("dim"))
        inside = rows.join(F.broadcast(state), "node").filter(F.shiftright(order, left + _STEP_BITS) == F.shiftright("prefix", left + _STEP_BITS))
        cells = inside.groupBy("node", "dim", "aim", "before", F.shiftright(order, left).alias("cell")).agg(F.sum("size").alias("held"))
        by_cell = Window.partitionBy("node").orderBy("cell")  # at most 2 ** 16 cells per node
        run = F.col("before") + F.sum("held").over(by_cell)
        reached = cells.withColumn("run", run).filter(F.col("run") >= F.col("aim"))
        state = reached.groupBy("node").agg(F.min_by(F.struct("dim", "aim", "cell", "held", "run"), "cell").alias("s")).select(
            "node", "s.dim", "s.aim", F.shiftleft("s.cell", left).alias("prefix"),
            (F.col("s.run") - F.col("s.held")).alias("before"), F.col("s.held").alias("held"),
        )
    # the value in the middle goes to the side that comes nearer to the half
    left_with = F.col("before") + F.col("held") - F.col("aim") < F.col("aim") - F.col("before")
    return state.select("node", "dim", (F.col("prefix") + left_with.cast("long")).alias("cut"))


def tree(rows: DataFrame, levels: int) -> DataFrame:
    """Adds `node`, the leaf of every row, numbered from 0 in the order of the tree."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for _ in range(levels):  # the tables sent to all tasks have one row per node
        cuts = written(_cuts(rows), "cuts")
        right = F.get(F.col("at"), F.col("dim")) >= F.col("cut")
        rows = written(
            rows.join(F.broadcast(cuts), "node").withColumn("node", F.col("node") * 2 + right.cast("long")).drop("dim", "cut"), "level"
        )
    return rows


def add_slots(rows: DataFrame, shard: str, total: int) -> DataFrame:
    """Adds `slot`, 0, 1, 2, ... inside every shard."""
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod("member", F.lit(blocks)))
    counts = rows.groupBy(shard, "block").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(shard).orderBy("block")
    counts = counts.select(shard, "block", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy(shard, "block").orderBy("member", "id", "crc", "size"))
    return rows.withColumn("place", place - 1).join(counts, [shard, "block"]).withColumn("slot", F.col("before") + F.col("place"))


def kd_shards(
    docs: DataFrame,
    shards: int | None = 16,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_share: float = WHOLE_SHARE,
) -> DataFrame:
    """Shard and slot of every document, under the law `bytes`: sizes near equal. `shards` is a power of two; or give
    `target_bytes`, and leaves are split until their mean is at most that."""
    rows = points(docs, id_col, text_col, source_col)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        levels = max(0, math.ceil(math.log2(max(1.0, total.bytes / target_bytes))))
    else:
        levels = shards.bit_length() - 1
        if shards != 1 << levels:
            raise ValueError("a k-d tree has a power of two leaves")
    ordered = written(_orders(rows, F.lit(whole_share * total.bytes / (1 << levels))), "orders")
    leaves = add_slots(tree(ordered, levels), "node", total.n)
    return leaves.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("node").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
