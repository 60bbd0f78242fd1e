"""Row-local feature columns, category folding, type narrowing and text-to-number / text-to-date rescue."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.exprs import require_columns
from panelforge.core.scale import join_checked

RARE_LABEL = "_OTHER"


def split_location(df: DataFrame, column: str, key=None) -> DataFrame:
    """`A>B>C` path: first part province, last part district, the middle a region or NONE for two-part paths."""
    parts = F.split(F.col(column), ">")
    key = key or (lambda c: c)
    return df.withColumns(
        {
            "province": key(F.trim(F.element_at(parts, 1))),
            "district": key(F.trim(F.element_at(parts, -1))),
            "region": F.when(F.size(parts) >= 3, F.trim(F.get(parts, F.lit(1)))).otherwise(F.lit("NONE")),
        }
    )


def identifier_features(df: DataFrame, column: str, prefixes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """Numeric value when all digits, length, and numeric prefixes of an identifier."""
    text = F.col(column).cast("string")
    new = {
        f"{column}_num": F.when(text.rlike(r"^\d+$"), text.try_cast("double")),
        f"{column}_length": F.length(text).cast("double"),
    }
    for n in prefixes:
        new[f"{column}_first{n}"] = F.substring(text, 1, n).try_cast("double")
    return df.withColumns(new)


def pair_features(df: DataFrame, pairs: Sequence[tuple[str, str]], epsilon: float = 1e-9) -> DataFrame:
    """Ratio (NULL for a near-zero denominator), difference and product of column pairs."""
    new: dict[str, Column] = {}
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        new[f"{a}_over_{b}"] = F.when(F.abs(y) >= F.lit(epsilon), x / F.nullif(y, F.lit(0.0)))
        new[f"{a}_minus_{b}"] = x - y
        new[f"{a}_times_{b}"] = x * y
    return df.withColumns(new)


def combine_categories(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """`a__b` text per group of columns; NULL when any part is NULL."""
    new = {}
    for g in groups:
        parts: list[Column] = []
        for i, c in enumerate(g):
            parts += ([F.lit("__")] if i else []) + [F.col(c).cast("string")]
        new["__".join(g)] = F.concat(*parts)
    return df.withColumns(new)


def fold_rare_categories(
    df: DataFrame, column: str, min_count: int = 10, reference: DataFrame | None = None, label: str = RARE_LABEL
) -> DataFrame:
    """Categories with fewer than `min_count` reference rows become `label`; NULL counts as a category."""
    source = reference if reference is not None else df
    # join_checked joins on equality, so NULL travels as a flag next to an empty text
    key = {"_cat": F.coalesce(F.col(column).cast("string"), F.lit("")), "_null": F.col(column).isNull()}
    kept = (
        source.withColumns(key)
        .groupBy("_cat", "_null")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_count)
    )
    joined = join_checked(df.withColumns(key), kept, ["_cat", "_null"])
    folded = F.when(F.col("_n").isNotNull(), F.col(column)).otherwise(F.lit(label))
    return joined.withColumn(column, folded).drop("_cat", "_null", "_n")


# Upper edges of the right-closed capacity bins.
CAPACITY_EDGES = (100, 160, 250, 400, 630, 1000, 1600)


def capacity_bucket(capacity: str | Column) -> Column:
    """Code 0..7 of the right-closed bin holding the capacity; -1 for NULL and values <= 0."""
    c = F.col(capacity) if isinstance(capacity, str) else capacity
    out = F.when(c.isNull() | (c <= 0), F.lit(-1))
    for code, edge in enumerate(CAPACITY_EDGES):
        out = out.when(c <= edge, F.lit(code))
    return out.otherwise(F.lit(len(CAPACITY_EDGES)))


def population_class(population: str | Column) -> Column:
    """urban from 50,000, suburban from 2,000, else rural; NULL or negative input fails the query."""
    p = F.col(population) if isinstance(population, str) else population
    bad = p.isNull() | (p < 0)
    return (
        F.when(bad, F.raise_error(F.lit("population must be present and not negative")).cast("string"))
        .when(p >= 50_000, F.lit("urban"))
        .when(p >= 2_000, F.lit("suburban"))
        .otherwise(F.lit("rural"))
    )


def downcast_plan(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row per numeric column with the smallest type that keeps it: one pass over min, max and the float error."""
    types = dict(df.dtypes)
    integers = {"tinyint", "smallint", "int", "bigint"}
    chosen = [c for c in (columns or df.columns) if types[c] in integers | {"float", "double"}]
    aggs = []
    for c in chosen:
        x = F.col(c).cast("double")
        aggs += [
            F.min(x).alias(f"{c}|lo"),
            F.max(x).alias(f"{c}|hi"),
            F.max(F.abs(x - F.col(c).cast("float").cast("double"))).alias(f"{c}|err"),
            F.max(F.abs(x)).alias(f"{c}|scale"),
        ]
    one = df.agg(*aggs)
    items = []
    for c in chosen:
        lo, hi = F.col(f"`{c}|lo`"), F.col(f"`{c}|hi`")
        if types[c] in integers:
            fit = (
                F.when(lo.isNull(), F.lit(types[c]))
                .when((lo >= -128) & (hi <= 127), F.lit("tinyint"))
                .when((lo >= -32768) & (hi <= 32767), F.lit("smallint"))
                .when((lo >= -2147483648) & (hi <= 2147483647), F.lit("int"))
                .otherwise(F.lit("bigint"))
            )
        else:
            scale = F.when(F.col(f"`{c}|scale`") == 0, F.lit(1.0)).otherwise(F.col(f"`{c}|scale`"))
            rel = F.col(f"`{c}|err`") / scale
            fit = F.when(rel.isNull() | (rel < tolerance), F.lit("float")).otherwise(F.lit("double"))
        items.append(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type_now"), fit.alias("type_fit")))
    return one.select(F.inline(F.array(*items)))


def downcast(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Casts numeric columns as planned by `downcast_plan` (the driver reads one row per column)."""
    plan = {r["column"]: r["type_fit"] for r in downcast_plan(df, columns, tolerance).collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan.items()}) if plan else df


# The two readings of a number written with separators.
NUMBER_READINGS = {
    "dot_decimal": (r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$", ",", "."),
    "comma_decimal": (r"^[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$", ".", ","),
}


def number_reading(text: Column, reading: str) -> Column:
    pattern, thousands, decimal = NUMBER_READINGS[reading]
    t = F.trim(text)
    clean = F.replace(t, F.lit(thousands), F.lit(""))
    if decimal != ".":
        clean = F.replace(clean, F.lit(decimal), F.lit("."))
    return F.when(t.rlike(pattern), clean.try_cast("double"))


def rescue_number(df: DataFrame, column: str, out: str, min_share: float = 0.5) -> DataFrame:
    """Reads a text column as numbers under whichever decimal convention parses more rows (the dot on a tie); fails
    the query when fewer than `min_share` of the non-empty values parse."""
    text = F.col(column).cast("string")
    filled = F.coalesce(F.trim(text) != "", F.lit(False))
    stats = df.agg(
        F.count_if(filled).alias("n"),
        F.count(number_reading(text, "dot_decimal")).alias("dot"),
        F.count(number_reading(text, "comma_decimal")).alias("comma"),
    ).select(
        F.when(F.greatest("dot", "comma") < F.col("n") * min_share, F.raise_error(F.lit(f"{column} is not numeric")))
        .otherwise(F.when(F.col("comma") > F.col("dot"), F.lit("comma")).otherwise(F.lit("dot")))
        .alias("pick")
    )
    return (
        df.withColumn("_pick", stats.scalar())
        .withColumn(
            out,
            F.when(F.col("_pick") == "comma", number_reading(text, "comma_decimal")).otherwise(
                number_reading(text, "dot_decimal")
            ),
        )
        .drop("_pick")
    )


_DMY = r"^\s*(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
_YMD = r"^\s*\d{4}[./-]"
_DATE_AND_TIME = r"^\s*(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?\s*$"


def date_order(df: DataFrame, column: str) -> DataFrame:
    """One row: `day_first`, `month_first` or `ambiguous`, proven by a component above 12; `unknown` without dates."""
    text = F.col(column).cast("string")
    year_first = text.rlike(_YMD)
    # the reading is decided by values that are not written year first
    first = F.when(~year_first, F.nullif(F.regexp_extract(text, _DMY, 1), F.lit("")).cast("int"))
    second = F.when(~year_first, F.nullif(F.regexp_extract(text, _DMY, 2), F.lit("")).cast("int"))
    s = df.agg(
        F.coalesce(F.bool_or(year_first), F.lit(False)).alias("iso"),
        F.max(first).alias("a"),
        F.max(second).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return s.select(
        F.when(a.isNull() & F.col("iso"), F.lit("month_first"))
        .when(a.isNull(), F.lit("unknown"))
        .when(F.col("iso"), F.lit("ambiguous"))
        .when((a > 12) & (b <= 12), F.lit("day_first"))
        .when((b > 12) & (a <= 12), F.lit("month_first"))
        .otherwise(F.lit("ambiguous"))
        .alias("date_order")
    )


def parse_dates(df: DataFrame, column: str, out: str, max_unparsed: float = 0.02, strict: bool = True) -> DataFrame:
    """Parses a text date column, with or without a time of day, under its proven component order. Strict mode fails the query when the order is
    ambiguous or more than `max_unparsed` of the rows do not parse."""
    order = date_order(df, column).scalar()
    text = F.regexp_replace(F.regexp_extract(F.col(column).cast("string"), _DATE_AND_TIME, 1), r"[./]", "-")
    iso = F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    dmy = F.try_to_timestamp(text, F.lit("d-M-yyyy")).cast("date")
    mdy = F.try_to_timestamp(text, F.lit("M-d-yyyy")).cast("date")
    ordered = df.withColumn("_order", order)
    parsed = ordered.withColumn(
        out,
        F.when(text.rlike(r"^\d{4}-"), iso).when(F.col("_order") == "day_first", dmy).otherwise(mdy),
    )
    if not strict:
        return parsed.drop("_order")
    gate = parsed.agg(
        F.when(F.max("_order") == "ambiguous", F.raise_error(F.lit(f"{column}: day-first or month-first is unproven")))
        .when(
            F.avg(F.col(out).isNull().cast("double")) > max_unparsed,
            F.raise_error(F.lit(f"{column}: too many dates do not parse")),
        )
        .otherwise(F.lit(True))
        .alias("ok")
    ).scalar()
    return parsed.withColumn("_ok", gate).filter(F.col("_ok")).drop("_order", "_ok")


def _id_candidates(keys: Sequence[str], time: str | None, separators: Sequence[str], max_parts: int):
    spelled: list[tuple[str, str, Column]] = [(k, k, F.col(k).cast("string")) for k in keys]
    if time:
        for label, fmt in DATE_SPELLINGS.items():
            spelled.append((time, f"{time}:{label}", F.date_format(F.to_date(time), fmt)))
    for n in range(1, max_parts + 1):
        for combo in permutations(spelled, n):
            if len({c[0] for c in combo}) != n:
                continue
            for sep in separators if n > 1 else ("",):
                parts: list[Column] = []
                for i, c in enumerate(combo):
                    parts += ([F.lit(sep)] if i and sep else []) + [c[2]]
                yield " + ".join(c[1] for c in combo), sep, F.concat(*parts)


DATE_SPELLINGS = {"iso": "yyyy-MM-dd", "compact": "yyyyMMdd", "dotted": "dd.MM.yyyy"}


def id_patterns(
    test: DataFrame,
    sample: DataFrame,
    sample_id: str,
    keys: Sequence[str],
    time: str | None = None,
    separators: Sequence[str] = ("_", "-", "", "|"),
    max_parts: int = 3,
) -> DataFrame:
    """Which combination of key columns and date spellings reproduces the ids of a sample table.

    Every candidate is two order-free checksums in one scan of the test rows, without a shuffle. The driver reads that
    single row; only candidates with the sample's checksums are then compared id by id. One row per such candidate:
    how many ids it makes, how many are wanted, and how many are on one side only.
    """
    found = list(_id_candidates(keys, time, separators, max_parts))
    sums = []
    for i, (_, _, c) in enumerate(found):
        h = F.xxhash64(c)
        sums += [F.bit_xor(h).alias(f"x{i}"), F.sum(F.pmod(h, F.lit(1 << 31))).alias(f"s{i}")]
    want_h = F.xxhash64(F.trim(F.col(sample_id).cast("string")))
    want = sample.agg(F.bit_xor(want_h).alias("x"), F.sum(F.pmod(want_h, F.lit(1 << 31))).alias("s")).first()
    made = test.agg(*sums).first()
    hits = [i for i in range(len(found)) if made[f"x{i}"] == want["x"] and made[f"s{i}"] == want["s"]]
    wanted = sample.select(F.trim(F.col(sample_id).cast("string")).alias("id")).distinct()
    parts = []
    for i in hits or [0]:  # without a hit the report has its columns and no row
        pattern, sep, c = found[i]
        ids = test.select(c.alias("id")).distinct()
        side = ids.withColumn("_m", F.lit(1)).join(wanted.withColumn("_w", F.lit(1)), "id", "full")
        parts.append(
            side.agg(
                F.count("_m").alias("made"),
                F.count("_w").alias("wanted"),
                F.count_if(F.col("_m").isNull()).alias("missing"),
                F.count_if(F.col("_w").isNull()).alias("extra"),
            ).select(F.lit(pattern).alias("pattern"), F.lit(sep).alias("separator"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if hits else out.filter(F.lit(False))


def apply_id_pattern(
    test: DataFrame, pattern: str, separator: str, out: str
) -> DataFrame:
    """Builds the id column for a pattern found by `id_patterns`."""
    cols: list[Column] = []
    for i, item in enumerate(pattern.split(" + ")):
        name, _, label = item.partition(":")
        require_columns(test, [name])
        c = F.date_format(F.to_date(name), DATE_SPELLINGS[label]) if label else F.col(name).cast("string")
        cols += ([F.lit(separator)] if i and separator else []) + [c]
    return test.withColumn(out, F.concat(*cols))
