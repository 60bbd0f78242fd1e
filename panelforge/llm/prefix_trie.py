"""Prefix trie of conversations from sorted sequences: range minima over LCPs instead of a stack or a tree in memory.

1. Turns are numbered by a distributed sort, conversations are rebuilt with the head of the first conversation of their
   hundred, and every (role, text) becomes two 64-bit hashes; texts are not moved again. Equal conversations become one
   class, known by its smallest id, so a conversation that a third of all rows repeat is one row from here on.
2. A class keeps its turns up to a power of two at which it is alone; later turns can't be shared and are never gathered.
   The kept sequences are sorted over ranges, and LCP[i] is the number of turns that class i shares with the one before.
3. Prefix d of class i is a node that i is the first to have if LCP[i] < d. Each such candidate searches the ends of its run
   of members on its own: by halving steps over a sparse table of LCP minima, to the right and to the left, all candidates
   of a range at once. A run that leaves its range goes on in a sparse table over the ranges' minima (a number per range),
   and in the range where it ends it is looked up by (range, depth) among that range's running minima. The left end of
   candidate LCP[i] is the class that has the parent node.
4. Members, leaves, saved code points and smallest ids of a run are differences of running sums and one more range minimum.
   Nodes of a single class follow from the class without a search.
5. The ids that end at a node are packed in order over ranges and hashed class by class, in a stream.

Sequences are compared by 128 bits a turn. A task holds the kept turns of one range; `SOME_TURNS` bounds them unless two
different conversations share a prefix longer than that. Every step starts from a table or checkpoint in the shared folder.

Defined cases: rows without conv_id are left out; NULL role or text counts as empty; NULL turns come first, and rows of one
turn number are ordered by a hash of role and text; repeated rows are turns of their own. conv_id - conv_id % 100 takes the
remainder with the sign of conv_id. Conversations that lose all turns are members of the root. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import cut_lineage, sorted_index, written
from panelforge.llm.words import runs

#: Kept turns, about, in a range; turns whose code points are summed at once; characters of ids hashed at once.
SOME_TURNS = 1_000_000
RUN = 4096
CHARACTERS = 1 << 16
_LARGEST = (1 << 63) - 1


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"),
        F.length(text).cast("long").alias("points"),
    )


def rebuilt(conversations: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, a, b, points) of the rebuilt conversations, and all conv_ids."""
    placed = sorted_index(_turns(conversations), ["conv_id", "turn", "a", "b"], "index")
    found = written(placed.groupBy("conv_id").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    ids = found.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head"),
    )
    based = ids.join(found.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    based = written(based.withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0)))), "based")
    turns = placed.join(found.select("conv_id", "first"), "conv_id").withColumn("at", F.col("index") - F.col("first"))
    own = turns.join(based.select("conv_id", "head", "taken"), "conv_id").filter("at >= head")
    own = own.select("conv_id", (F.col("at") - F.col("head") + F.col("taken") + 1).alias("depth"), "a", "b", "points")
    lent = turns.filter(F.col("at") < heads - 1).select(F.col("conv_id").alias("base"), "at", "a", "b", "points")
    lent = lent.join(based.select("base", "conv_id", "head"), "base").filter("at < head")
    lent = lent.select("conv_id", (F.col("at") + 1).alias("depth"), "a", "b", "points")
    return written(own.unionByName(lent), "rebuilt"), found.select("conv_id")


def _classes(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, class) of every conversation, and the classes (class, members, turns, points, kept): equal sequences have
    equal sums of hashes that depend on depth and turn."""
    level = F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.length(F.bin(F.col("depth") - 1)))
    marks = turns.select("conv_id", level.alias("level"), "points", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "depth", "a").alias("y"))
    levels = written(
        marks.groupBy("conv_id", "level").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("points").alias("points")),
        "levels",
    )
    sums = levels.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("turns"), F.sum("points").alias("points"))
    sums = written(ids.join(sums, "conv_id", "left").na.fill(0), "sums")
    key = ["turns", "x", "y"]
    classes = written(sums.groupBy(*key, "points").agg(F.min("conv_id").alias("class"), F.count(F.lit(1)).alias("members")), "classes")
    member = sums.join(classes.select(*key, "class"), key).select("conv_id", "class")
    # the first 2, 4, 8, ... turns of each class: does another class begin with them?
    order = Window.partitionBy("class").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    begins = levels.withColumnRenamed("conv_id", "class").join(classes.select("class"), "class")
    begins = begins.select("class", "level", *(F.bit_xor(c).over(order).alias(c) for c in "xy"), F.sum("n").over(order).alias("n"))
    begins = written(begins.filter(F.col("n") == F.expr("shiftleft(1L, level)")), "begins")
    alone = begins.groupBy("n", "x", "y").agg(F.count(F.lit(1)).alias("times"), F.min("class").alias("class")).filter("times = 1")
    kept = alone.groupBy("class").agg(F.min("n").alias("alone"))
    classes = classes.join(kept, "class", "left").withColumn("kept", F.least("turns", F.coalesce("alone", "turns")))
    return member, written(classes.select("class", "members", "turns", "points", "kept"), "kept")


def _digests(member: DataFrame) -> DataFrame:
    """(class, ends_sha256): ids of the class in order. They are packed over ranges, so a class is hashed from few rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, pairs in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda p: p[0]):
                ids = [p[1] for p in pairs]
                for at in range(0, len(ids), CHARACTERS // 8):
                    part = ids[at : at + CHARACTERS // 8]
                    rows.append((own, part[0], ",".join(map(str, part))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["class", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or own != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["class", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["class", "ends_sha256"])

    packed = member.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInArrow(pack, "class long, first long, ids string")
    return packed.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digest, "class long, ends_sha256 string")


class Part(NamedTuple):
    """Sorted classes of one range. `lcp` is with the class before, the first one's is unknown (0)."""

    ids: np.ndarray
    members: np.ndarray
    turns: np.ndarray
    points: np.ndarray
    a: np.ndarray
    b: np.ndarray
    before: np.ndarray
    first: np.ndarray
    lcp: np.ndarray


def _part(batches: Iterator[pa.RecordBatch]) -> Part | None:
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if table is None or not len(table):
        return None
    table = table.combine_chunks()
    ids, members, turns, points = (table.column(c).to_numpy() for c in ("class", "members", "turns", "points"))
    path = table.column("path").chunk(0)
    size = np.diff(path.offsets.to_numpy()).astype(np.int64)
    flat = path.flatten()
    a, b, each = (flat.field(k).to_numpy() for k in (0, 1, 2))
    first = np.append(0, np.cumsum(size))
    least = np.minimum(size[:-1], size[1:])
    row = np.repeat(np.arange(len(least)), least)
    x, y = runs(first[:-2], least), runs(first[1:-1], least)
    unlike = np.flatnonzero((a[x] != a[y]) | (b[x] != b[y]))
    lcp = np.append(0, least)
    rows, at = np.unique(row[unlike], return_index=True)
    lcp[rows + 1] = x[unlike[at]] - first[rows]
    return Part(ids, members, turns, points, a, b, np.append(0, np.cumsum(each)), first, lcp)


def _head(p: Part, i: np.ndarray | int, depth: np.ndarray | int) -> np.ndarray:
    """Code points of the first turns of a class."""
    return p.before[p.first[i] + np.maximum(depth, 0)] - p.before[p.first[i]]


class Minima:
    """Sparse table: minima of all runs of 2 ** k values."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [np.asarray(values, np.int64)]
        while 2 ** len(self.rows) <= len(values):
            last, step = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def last_not_below(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The largest e >= start - 1 with all of values[start : e + 1] at least `depth`."""
        at = np.array(start, np.int64)
        for k in reversed(range(len(self.rows))):
            fits = at + 2**k <= len(self.rows[0])
            fits[fits] = self.rows[k][at[fits]] >= depth[fits]
            at += fits * 2**k
        return at - 1

    def first_not_below(self, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The smallest s <= end + 1 with all of values[s : end + 1] at least `depth`."""
        at = np.array(end, np.int64) + 1
        for k in reversed(range(len(self.rows))):
            fits = at >= 2**k
            fits[fits] = self.rows[k][at[fits] - 2**k] >= depth[fits]
            at -= fits * 2**k
        return at

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of values[start : end], the largest long where that is empty."""
        out = np.full(len(start), _LARGEST)
        size = end - start
        for k in range(len(self.rows)):
            own = (size >= 2**k) & (size < 2 ** (k + 1))
            out[own] = np.minimum(self.rows[k][start[own]], self.rows[k][end[own] - 2**k])
        return out


_SUMS = ("members", "weighted", "new", "leaves")


def _sums(p: Part, lcp: np.ndarray, following: int) -> np.ndarray:
    """Running sums over classes, one row more than there are: members, code points times members, code points that the
    class before lacks, leaves."""
    each = np.stack([p.members, p.members * p.points, p.points - _head(p, np.arange(len(lcp)), lcp), np.append(lcp[1:], following) < p.turns])
    return np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(each, axis=1)], axis=1)


_BORDER = "part int, first array<struct<a:long,b:long,points:long>>, last array<struct<a:long,b:long,points:long>>, lowest long, least long, points long, turns long, members long, weighted long, new long, leaves long"
_RANGE = "part int, border long, lowest long, least long, members long, weighted long, new long, leaves long"
_FOUND = "kind string, class long, depth long, part int, other long, members long, weighted long, new long, leaves long, least long"
_ARROW_FOUND = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32()}.get(c.split()[1], pa.int64())) for c in _FOUND.split(", ")])


def _borders(ordered: DataFrame) -> DataFrame:
    """One row per range: LCP of its first class with the last one before, its lowest LCP, smallest id and sums."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _part(batches)
        if p is None:
            return
        n = len(p.ids)
        sums = _sums(p, p.lcp, -1)  # the first LCP and the last leaf are put right below

        def path(i: int) -> list[dict]:
            at = slice(p.first[i], p.first[i + 1])
            return [{"a": x, "b": y, "points": z} for x, y, z in zip(p.a[at].tolist(), p.b[at].tolist(), np.diff(p.before[p.first[i] : p.first[i + 1] + 1]).tolist(), strict=True)]

        row = {"part": TaskContext.get().partitionId(), "first": path(0), "last": path(n - 1), "lowest": int(p.lcp[1:].min(initial=_LARGEST)), "least": int(p.ids.min()), "points": int(p.points[0]), "turns": int(p.turns[-1])}
        row |= {c: int(v) for c, v in zip(_SUMS, sums[:, -1], strict=True)}
        keys = pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "points")]))
        schema = pa.schema([("part", pa.int32()), ("first", keys), ("last", keys), *((c, pa.int64()) for c in ("lowest", "least", "points", "turns", *_SUMS))])
        yield pa.RecordBatch.from_pylist([row], schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shared = -1
                if ready is not None:
                    shared = next((i for i, (x, y) in enumerate(zip(last, r["first"], strict=False)) if (x["a"], x["b"]) != (y["a"], y["b"])), min(len(last), len(r["first"])))
                    ready["leaves"] += (shared < ready.pop("turns")) - 1
                    rows.append(ready)
                last = r["last"]
                new = r["new"] - sum(x["points"] for x in r["first"][: max(shared, 0)])
                ready = {"part": r["part"], "border": shared, "lowest": min(shared, r["lowest"]), "least": r["least"], "members": r["members"], "weighted": r["weighted"], "new": new, "leaves": r["leaves"], "turns": r["turns"]}
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if ready is not None:
            yield pa.RecordBatch.from_pylist([{k: v for k, v in ready.items() if k != "turns"}], schema)

    schema = pa.schema([("part", pa.int32()), *((c.split()[0], pa.int64()) for c in _RANGE.split(", ")[1:])])
    # one row per range, in one task
    return ordered.mapInArrow(ends, _BORDER).repartition(1).sortWithinPartitions("part").mapInArrow(meet, _RANGE)


def _searched(ordered: DataFrame, ranges: list) -> DataFrame:
    """Ends of every candidate's run. Rows by kind: `class` (depth: LCP before, other: LCP after), `node` (sums of its run; of
    its part up to range `part`, where it ends), `branch` (other: the class, class: who has the parent, or the last range
    `part` that can), `right` and `left` (by range and depth: sums up to the end of a run, and the class where one begins)."""
    numbers = np.array([list(r)[1:] for r in ranges], np.int64).reshape(-1, 7).T
    shared = ordered.sparkSession.sparkContext.broadcast((np.array([r[0] for r in ranges], np.int64), numbers))

    def rows(kind: str, n: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, n, 65_536):
            size = min(65_536, n - at)
            held = {"kind": pa.array([kind] * size)} | {c: v.slice(at, size) if isinstance(v, pa.Array) else pa.array(v[at : at + size]) for c, v in columns.items()}
            arrays = [held[f.name].cast(f.type) if f.name in held else pa.nulls(size, f.type) for f in _ARROW_FOUND]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW_FOUND)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _part(batches)
        if p is None:
            return
        parts, (border, lowest, least, *totals) = shared.value
        me, n = int(np.searchsorted(parts, TaskContext.get().partitionId())), len(p.ids)
        following = int(border[me + 1]) if me + 1 < len(parts) else -1
        lcp = p.lcp.copy()
        lcp[0] = border[me]
        after = np.append(lcp[1:], following)
        yield from rows("class", n, **{"class": p.ids, "depth": lcp, "other": after})
        table, ids, all_lcp, all_ids = Minima(lcp), Minima(p.ids), Minima(lowest), Minima(least)
        sums = _sums(p, lcp, following)
        whole = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(np.stack(totals), axis=1)], axis=1)

        # nodes of several classes, by the first class that has them
        count = np.maximum(after - lcp, 0)
        i = np.repeat(np.arange(n), count)
        depth = runs(lcp + 1, count)
        begin, end = table.first_not_below(i, depth) - 1, table.last_not_below(i + 1, depth)
        out = sums[:, end + 1] - sums[:, begin]
        out[2] -= sums[2, begin + 1] - sums[2, begin]
        low = ids.over(begin, end + 1)
        leaves_range = (end == n - 1) & (following >= depth)
        stop = all_lcp.last_not_below(np.full(len(i), me + 1), depth) + 1  # the range where the run ends, if it leaves this one
        stop = np.where(leaves_range, stop, me + 1)
        out += whole[:, stop] - whole[:, [me + 1]]
        low = np.minimum(low, all_ids.over(np.full(len(i), me + 1), stop))
        inner = leaves_range & (stop < len(parts))
        inner[inner] = border[stop[inner]] >= depth[inner]
        target = pa.array(np.where(inner, stop, 0), pa.int32(), mask=~inner)
        yield from rows("node", len(i), **{"class": p.ids[begin], "depth": depth, "part": target, "least": low}, **dict(zip(_SUMS, out, strict=True)))

        # where each class leaves the ones before it: who has that node?
        i = np.flatnonzero(lcp >= 0)
        owner = table.first_not_below(i, lcp[i]) - 1
        here = owner >= 0
        yield from rows("branch", int(here.sum()), **{"class": p.ids[owner[here]], "depth": lcp[i[here]], "other": p.ids[i[here]]})
        far = i[~here]
        source = all_lcp.first_not_below(np.full(len(far), me - 1), lcp[far]) - 1
        yield from rows("branch", len(far), **{"part": source, "depth": lcp[far], "other": p.ids[far]})

        # for runs that come from other ranges and end here, and for those that begin here and go on
        depth = np.arange(lcp.min() + 1, lcp[0] + 1)
        end = np.searchsorted(-np.minimum.accumulate(lcp), -depth, "right")
        yield from rows("right", len(depth), **{"part": np.full(len(depth), me), "depth": depth, "least": ids.over(np.zeros_like(end), end)}, **dict(zip(_SUMS, sums[:, end], strict=True)))
        depth = np.arange(lcp.min() + 1, following + 1)
        begin = n - 1 - np.searchsorted(-np.minimum.accumulate(lcp[::-1]), -depth, "right")
        yield from rows("left", len(depth), **{"part": np.full(len(depth), me), "depth": depth, "class": p.ids[begin]})

    return written(ordered.mapInArrow(search, _FOUND), "searched")


def _before(turns: DataFrame) -> DataFrame:
    """Adds the code points of the turns before, by runs of turns, so that no task has to order a long conversation."""
    rows = turns.withColumn("run", F.floor(F.col("depth") / RUN))
    inside = F.sum("points").over(Window.partitionBy("class", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy("class", "run").agg(F.sum("points").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("class").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("class", "run", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    summed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["class", "run"])
    return summed.select("class", "depth", (F.col("inside") + F.col("earlier")).alias("before"))


def prefix_trie(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    spark = conversations.sparkSession
    turns, ids = rebuilt(conversations, family, heads)
    member, classes = _classes(turns, ids)
    own = written(turns.withColumnRenamed("conv_id", "class").join(classes.select("class", "kept"), "class"), "own")
    step = F.struct("depth", "a", "b", "points")
    paths = own.filter("depth <= kept").groupBy("class").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    paths = paths.select("class", F.transform("steps", lambda s: F.struct(s.a.alias("a"), s.b.alias("b"), s.points.alias("points"))).alias("path"))
    kept = classes.agg(F.sum("kept")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept // SOME_TURNS + 1)
    empty = F.array().cast(paths.schema["path"].dataType)
    rows = classes.join(paths, "class", "left").withColumn("path", F.coalesce("path", empty))
    ordered = cut_lineage(rows.repartitionByRange(ranges, "path").sortWithinPartitions("path"))
    found = _searched(ordered, _borders(ordered).collect())  # a row of numbers per range

    def of(kind: str, *columns: str | Column) -> DataFrame:
        return found.filter(F.col("kind") == kind).select(*columns)

    ends = of("right", "part", "depth", *(F.col(c).alias(f"{c}_in") for c in (*_SUMS, "least")))
    nodes = of("node", "class", "depth", "part", *_SUMS, "least").join(ends, ["part", "depth"], "left")
    nodes = nodes.select(
        "class", "depth", *((F.col(c) + F.coalesce(f"{c}_in", F.lit(0))).alias(c) for c in _SUMS), F.least("least", "least_in").alias("least")
    )
    nodes = written(nodes, "nodes")
    begins = of("left", "part", "depth", F.col("class").alias("there"))
    branches = of("branch", "class", "depth", "part", F.col("other").alias("child")).join(begins, ["part", "depth"], "left")
    branches = written(branches.select(F.coalesce("class", "there").alias("class"), "depth", "child"), "branches")

    sides = of("class", "class", F.col("depth").alias("lcp"), F.col("other").alias("lcp_after"))
    parents = branches.select(F.col("child").alias("class"), F.col("class").alias("above"))
    info = written(classes.withColumnRenamed("members", "in_class").join(sides, "class").join(parents, "class", "left").join(_digests(member), "class"), "info")
    root = info.filter("lcp = -1").select("class", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"))
    places = _before(own).unionByName(root).join(info, "class").filter("depth > lcp")

    children = branches.groupBy("class", "depth").agg(F.count(F.lit(1)).alias("branches"))
    first_alone = F.greatest("lcp", "lcp_after") + 1
    at = places.join(nodes, ["class", "depth"], "left").join(children, ["class", "depth"], "left")
    several = F.col("depth") <= F.col("lcp_after")
    at = at.select(
        F.when(several, F.col("least")).otherwise(F.col("class")).alias("conv_id"),
        "depth",
        # the parent is looked up where several classes share it; the null key of the others meets nothing
        F.when(F.col("depth") <= first_alone, F.when(F.col("depth") == F.col("lcp") + 1, F.col("above")).otherwise(F.col("class"))).alias("up"),
        F.when(F.col("depth") > first_alone, F.col("class")).alias("own"),
        F.when(several, F.col("members")).otherwise(F.col("in_class")).alias("n_convs"),
        ((F.col("turns") > F.col("depth")).cast("long") + F.coalesce("branches", F.lit(0))).alias("n_children"),
        F.when(several, F.col("leaves")).otherwise(F.lit(1)).cast("long").alias("n_leaves"),
        F.when(several, F.col("weighted") - (F.col("members") - 1) * F.col("before") - F.col("new") - F.col("points"))
        .otherwise((F.col("in_class") - 1) * (F.col("points") - F.col("before")))
        .alias("saved_tokens"),
        F.when(F.col("turns") == F.col("depth"), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    known = at.filter("own IS NOT NULL OR depth = 0").select("*", F.col("own").alias("parent_conv_id"))
    looked = at.filter("own IS NULL AND depth > 0").withColumn("up_depth", F.col("depth") - 1)
    above = nodes.select(F.col("class").alias("up"), F.col("depth").alias("up_depth"), F.col("least").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return known.select(*names).unionByName(looked.join(above, ["up", "up_depth"]).select(*names))
