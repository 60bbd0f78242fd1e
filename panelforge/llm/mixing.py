"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Targets. Each source has a weight. The mix holds `epochs` times all words; a source gets its share by weight, but at most
`most` times its own words, and what that cuts off is shared again by weight. Sorted by the level at which they reach
their cap, the sources below the final level are the capped ones, so running sums over one row per source give the fixed
point directly.

Inclusion. A document's expected number of copies rises with its length class (the binary logarithm of its words), up to
`most`, by one factor per source that makes the expected words equal the target; the same running sums over the at most
33 length classes of a source give the factor. The whole part of that number is taken for certain. The rest is the
inclusion probability p of one more copy.

Order sampling. Documents are ranked by the Pareto ratio (u / (1 - u)) / (p / (1 - p)), u a hash of the document and the
seed, and the smallest ratios are taken until the words left in the target are filled. The cut is found from word counts
per (source, ratio range); only the range that holds it is sorted, so a source with a third of all rows meets no task of
its own. Selection is then a comparison of each row with its source's cut: the texts are never shuffled for it, and a
recomputed task decides the same.

Defined cases: NULL and empty texts have size 0 and take nothing; a NULL source is a source of its own and comes last;
a NULL id is allowed (u depends on id and text); repeated rows share u and are taken or left together; a source of size 0
has target 0; an empty table gives an empty result. Other columns may have any name in `mixed_rows` but those starting
with `_mix_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written

WEIGHTS = (3.0, 1.0, 2.0)
EPOCHS = 1.5
MOST = 2.0
RANGE_ROWS = 5000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def _key(source_col: str) -> Column:
    """A join key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _tilt(size: Column) -> Column:
    """Relative importance of a document by its length class."""
    return 1.0 + F.floor(F.log2(size + 1.0)) / 16.0


def _uniform(seed: int, *of: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the row alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """`sizes` (source, source_size), one row per source; adds `target`."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))  # one row per source
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("total", epochs * F.sum("source_size").over(whole))
    rows = rows.withColumn("level", (F.col("total") - before) / onward)
    reached = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole)
    rows = rows.withColumn("reached", reached)
    target = F.coalesce(F.least(F.col("reached") * F.col("weight"), F.col("cap")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _factors(classes: DataFrame, most: float) -> DataFrame:
    """Per source the factor c with sum(words * min(most, c * tilt)) = target. `classes`: key, tilt, words, target."""
    high_first = Window.partitionBy("key").orderBy(F.desc("tilt"))
    before = F.coalesce(F.sum(most * F.col("words")).over(high_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum(F.col("words") * F.col("tilt")).over(high_first.rowsBetween(0, Window.unboundedFollowing))
    factor = F.try_divide(F.col("target") - before, onward)
    rows = classes.withColumn("factor", factor)
    fits = F.max(F.when(F.col("factor") * F.col("tilt") <= most, F.col("factor"))).alias("factor")
    return rows.groupBy("key").agg(fits, F.first("target").alias("target"), F.sum("words").alias("source_size"))


def _expected(most: float) -> Column:
    """Expected copies; a source without a factor is wanted in full."""
    return F.least(F.lit(most), F.coalesce(F.col("_mix_factor") * F.col("_mix_tilt"), F.lit(most)))


def _decide(rows: DataFrame, most: float) -> DataFrame:
    """Certain copies and the Pareto ratio of the last one (NULL where no further copy is in question)."""
    whole = F.floor(_expected(most) + 1e-9)
    rows = rows.withColumn("_mix_whole", whole).withColumn("_mix_p", F.greatest(_expected(most) - whole, F.lit(0.0)))
    ratio = (F.col("_mix_u") / (1 - F.col("_mix_u"))) / (F.col("_mix_p") / (1 - F.col("_mix_p")))
    return rows.withColumn("_mix_ratio", F.when(F.col("_mix_p") > 0, ratio))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.withColumns(
        {
            "_mix_key": _key(source_col),
            "_mix_size": word_count(text_col),
            "_mix_u": _uniform(seed, F.col(id_col), F.col(text_col)),
        }
    ).withColumn("_mix_tilt", _tilt(F.col("_mix_size")))


def source_plan(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """One row per source: its words, target, factor and the Pareto ratio up to which documents get their last copy."""
    classes = base.groupBy("_mix_source", "_mix_key", "_mix_tilt").agg(
        F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("n")
    )
    classes = written(classes, "classes")
    rows = classes.agg(F.sum("n")).first()[0] or 0
    sizes = classes.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_key").alias("key")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, epochs, most).withColumn("key", _key("source"))
    known = classes.select(F.col("_mix_key").alias("key"), F.col("_mix_tilt").alias("tilt"), "words").join(targets.select("key", "target"), "key")
    names = {"key": "_mix_key", "factor": "_mix_factor", "target": "_mix_target", "source_size": "_mix_source_size"}
    factors = written(_factors(known, most).withColumnsRenamed(names), "factors")

    ranked = _decide(base.join(factors, "_mix_key"), most)
    ranges = max(16, math.ceil(rows / RANGE_ROWS))
    ranked = ranked.withColumn("_mix_range", F.floor(ranges * F.col("_mix_ratio") / (1 + F.col("_mix_ratio"))))
    certain = F.sum(F.col("_mix_whole") * F.col("_mix_size"))
    held = ranked.groupBy("_mix_key", "_mix_range").agg(
        certain.alias("certain"), F.sum(F.when(F.col("_mix_ratio").isNotNull(), F.col("_mix_size"))).alias("words")
    )
    held = written(held, "ranges")
    left = factors.join(held.groupBy("_mix_key").agg(F.sum("certain").alias("c")), "_mix_key").select(
        "_mix_key", (F.col("_mix_target") - F.col("c")).alias("_mix_left")
    )
    upto = Window.partitionBy("_mix_key").orderBy("_mix_range")
    sums = held.filter("_mix_range IS NOT NULL").withColumn("upto", F.sum("words").over(upto)).join(left, "_mix_key")
    cut = sums.filter(F.col("upto") > F.col("_mix_left")).groupBy("_mix_key").agg(
        F.min_by(F.struct("_mix_range", (F.col("upto") - F.col("words")).alias("before"), "_mix_left"), "_mix_range").alias("cut")
    )
    cut = written(cut.select("_mix_key", "cut.*"), "cuts")
    # the rows of one range per source, about RANGE_ROWS at a time
    inside = ranked.join(cut.select("_mix_key", "_mix_range", "before", "_mix_left"), ["_mix_key", "_mix_range"])
    place = Window.partitionBy("_mix_key").orderBy("_mix_ratio")
    upto_here = F.col("before") + F.sum("_mix_size").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        inside.withColumn("middle", upto_here - F.col("_mix_size") / 2)
        .filter(F.col("middle") <= F.col("_mix_left"))
        .groupBy("_mix_key")
        .agg(F.max("_mix_ratio").alias("_mix_last"))
    )
    limit = F.col("_mix_range") / float(ranges)
    cuts = cut.join(last, "_mix_key", "left").select(
        "_mix_key", F.coalesce("_mix_last", F.nullif(limit / (1 - limit), F.lit(0.0)) * (1 - 1e-12), F.lit(-1.0)).alias("_mix_cut")
    )
    # a source whose ratios never reach the words left takes them all
    plan = factors.join(cuts, "_mix_key", "left")
    return written(plan.withColumn("_mix_cut", F.coalesce("_mix_cut", F.lit(float("inf")))), "plan")


def _copies(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    rows = _decide(rows.join(plan, "_mix_key"), most)
    more = F.coalesce(F.col("_mix_ratio") <= F.col("_mix_cut"), F.lit(False)).cast("long")
    return rows.withColumn("_mix_copies", F.col("_mix_whole").cast("long") + more)


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """Every document with its size in words, its source's size and target, and the words the mix takes from it."""
    base = _base(docs, id_col, text_col, source_col, seed).select(
        F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), "_mix_key", "_mix_size", "_mix_u", "_mix_tilt"
    )
    base = written(base, "sizes")
    rows = _copies(base, source_plan(base, weights, epochs, most), most)
    return rows.select(
        F.col("_mix_id").alias("doc_id"),
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as it is taken. A document of size 0 has no
    words to take; it stays as often as its rank says, like any other."""
    rows = _base(docs, id_col, text_col, source_col, seed)
    base = rows.select(F.col(source_col).alias("_mix_source"), "_mix_key", "_mix_size", "_mix_u", "_mix_tilt")
    plan = source_plan(written(base, "sizes"), weights, epochs, most)
    taken = _copies(rows, plan, most).filter("_mix_copies > 0")
    repeated = taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return repeated.select(*docs.columns)
