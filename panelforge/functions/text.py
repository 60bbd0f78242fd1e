"""Locale-correct text keys, key alignment pieces and the reason taxonomy, as built-in expressions; only the keywords of the
taxonomy are looked for with Arrow's matcher."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div

# The 29-letter alphabet and the accent folding of join keys.
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"
FOLD_FROM, FOLD_TO = "çğıöşü", "cgiosu"
COMBINING_DOT = "̇"
# Base letter + combining mark pairs that compose to a folded letter.
DECOMPOSED = (("c", "̧"), ("s", "̧"), ("g", "̆"), ("o", "̈"), ("u", "̈"))
COMPOSITE_SEPARATORS = ("|", "/", "-", "_")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _letters(x: Column, source: str, target: str) -> Column:
    """Letter for letter. A chain of replaces scans bytes; translate() looks every character up in a map."""
    for a, b in zip(source, target, strict=True):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def locale_lower(x: str | Column) -> Column:
    """Dotted capital I becomes i and dotless I becomes ı before lowering."""
    return F.lower(_letters(_c(x), "İI", "iı"))


def locale_upper(x: str | Column) -> Column:
    """The dotted letter first, or the capital made of the dotless one would be dotted again."""
    return F.upper(_letters(_c(x), "iı", "İI"))


# White space other than the plain space, ASCII and beyond, as members of a character class. Listed one by
# one because the regular expression engine tests single characters with a table and ranges one after the other.
ASCII_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
WIDE_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = r";,/\\\-_()\[\]"


def _collapse(x: Column, also: str = "") -> Column:
    """Runs of white space (and of the class members in `also`) become one space. Single plain spaces, which are most of
    them, match nothing, and pure ASCII text is spared the wide spaces."""

    def squeeze(members: str) -> Column:
        return F.regexp_replace(x, f"[{members}][{members} ]*| [{members} ]+", " ")

    ascii_only = F.octet_length(x) == F.length(x)
    return F.trim(
        F.when(ascii_only, squeeze(ASCII_SPACE + also)).otherwise(squeeze(ASCII_SPACE + WIDE_SPACE + also))
    )


def _folded(x: str | Column) -> Column:
    text = locale_lower(x)
    for base, mark in DECOMPOSED:
        text = F.replace(text, F.lit(base + mark), F.lit(base))
    return _letters(text, FOLD_FROM, FOLD_TO)


def join_key(x: str | Column) -> Column:
    """Trimmed, locale-lowered, composed, accent-folded, single-spaced key. A lone combining dot survives, so that
    `has_combining_dot` can flag it."""
    return _collapse(_folded(x))


def has_combining_dot(x: str | Column) -> Column:
    return F.instr(_c(x), COMBINING_DOT) > 0


def codepoints(x: str | Column) -> Column:
    """Array of U+XXXX, one per character."""
    chars = F.filter(F.split(_c(x), ""), lambda ch: ch != "")
    return F.transform(chars, lambda ch: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), 4, "0")))


def alphabet_sort_key(x: str | Column) -> Column:
    """Text whose code-point order is the order of the 29-letter alphabet; characters outside it sort last."""
    ranks = "".join(chr(0x21 + i) for i in range(len(ALPHABET)))
    low = F.regexp_replace(locale_lower(x), f"[^{ALPHABET}]", "~")
    return F.translate(low, ALPHABET, ranks)


def alphabet_sorted(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    key = alphabet_sort_key(column)
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.col(column))


def strip_qualifier(x: str | Column) -> Column:
    """Text before `/`, `(` or ` - `, tried in this order; a separator with nothing before it changes nothing."""
    text = _c(x)
    for sep in ("/", "(", " - "):
        head = F.trim(F.substring_index(text, sep, 1))
        text = F.when((F.instr(text, sep) > 0) & (head != ""), head).otherwise(text)
    return text


def split_composite(x: str | Column) -> tuple[Column, Column]:
    """(left, right) at the first of | / - _ that leaves text on both sides; (NULL, text) without one."""
    text = F.trim(_c(x))
    left: Column = F.lit(None).cast("string")
    right: Column = text
    for sep in reversed(COMPOSITE_SEPARATORS):
        head = F.trim(F.substring_index(text, sep, 1))
        tail = F.trim(F.substring(text, F.instr(text, sep) + 1, F.length(text)))
        usable = (F.instr(text, sep) > 0) & (head != "") & (tail != "")
        left = F.when(usable, head).otherwise(left)
        right = F.when(usable, tail).otherwise(right)
    return left, right


def qualifier_key(x: str | Column) -> Column:
    return join_key(strip_qualifier(x))


def composite_key(x: str | Column) -> Column:
    return join_key(split_composite(x)[1])


def normalized_names(names: Sequence[str]) -> list[str]:
    """Unique ASCII snake_case column names; a list of column names, so plain Python."""
    import re
    import unicodedata

    out: list[str] = []
    for raw in names:
        low = raw.strip().translate(str.maketrans({"İ": "i", "I": "ı"})).lower()
        folded = unicodedata.normalize("NFC", low).translate(str.maketrans(FOLD_FROM, FOLD_TO))
        base = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", folded)).strip("_") or "column"
        if base[0].isdigit():
            base = f"c_{base}"
        name, n = base, 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


# Reason families in priority order with code, fault flag and keywords.
REASON_FAMILIES: tuple[tuple[str, int, bool, tuple[str, ...]], ...] = (
    (
        "HAVA", 1, True,
        (
            "olumsuz hava", "hava sart", "elverissiz hava", "hava kosul", "firtina", "yildirim", "kar ", "buzlanma",
            "sel ", "dolu ", "ruzgar",
        ),
    ),
    ("AGAC", 2, True, ("agac", "dal ", "bitki", "orman")),
    ("HAYVAN", 3, True, ("kus ", "hayvan", "kedi", "leylek", "yilan")),
    (
        "UCUNCU_SAHIS", 4, True,
        (
            "3.sahis", "3. sahis", "ucuncu sahis", "kazi", "arac carpma", "is makinesi", "vinc", "hasar",
            "yabanci cisim",
        ),
    ),
    ("UST_SEBEKE", 17, True, ("teias", "iletim", "ust sebeke", "enterkonnekte")),
    ("IDARI_KESME", 22, False, ("borctan kesme", "yikimdan kesme", "kacak", "usulsuz", "tahsilat")),
    ("EMNIYET", 23, False, ("emniyet", "can ve mal", "guvenlik", "tehlike onleyici", "tedbir amacli")),
    (
        "MANEVRA", 20, False,
        (
            "manevra", "scada", "sebeke calis", "planli", "bakim", "yatirim", "yeni baglanti", "revizyon",
            "kolon islem", "deplase", "dahili onarim", "veri duzeltme", "kesinti talep",
        ),
    ),
    ("TALEP", 21, False, ("abone talep", "musteri talep", "resmi kurum")),
    (
        "ASIRI_YUK", 5, True,
        ("asiri yuk", "yuklenme", "overload", "asiri akim", "termik ac", "asiri akim toprak"),
    ),
    (
        "KABLO", 6, True,
        (
            "kablo", "iletken", "hat kop", "kop", "havai hat", "jumper", "rekortmen", "rekortman", "notr ariza",
        ),
    ),
    ("TRAFO", 7, True, ("trafo", "transformator", "guc trafo")),
    ("SIGORTA", 8, True, ("sigorta", "nh sigorta")),
    (
        "KESICI", 9, True,
        ("kesici", "ayirici", "rekloser", "fider ac", "tms", "salter", "kontaktor", "sekonder koruma"),
    ),
    ("IZOLATOR", 10, True, ("izolator", "mesnet", "atlama", "flashover")),
    ("KLEMENS", 11, True, ("klemens", "oksit", "ek yeri", "bag")),
    ("SAYAC", 12, True, ("sayac", "olcu", "pano")),
    ("DIREK", 14, True, ("direk", "trvers", "traves", "konsol")),
    ("KUTU", 15, True, ("dagitim kutusu", "kofre", "saha dagitim", "buat")),
    ("EKONOMIK_OMUR", 13, True, ("ekonomik omur", "yaslanma", "eskime", "korozyon", "asinma")),
    ("SEBEKE", 16, True, ("og ariza", "ag ariza", "og-ariza", "ag-ariza", "sebeke ariza", "aydinlatma")),
    ("GECICI", 30, True, ("gecici", "transient", "otomatik tekrar")),
    ("BILINMEYEN", 99, True, ("bilinmeyen", "belirsiz", "tespit edilemedi", "girilmemis", "girilmemistir")),
)
OTHER_REASON = ("DIGER", 0, True)
#: Texts that are matched, and the open ones of them copied, together.
SOME_TEXTS = 500


def _plain_letters(text: Column) -> Column:
    """`_folded`, which of ASCII text leaves the lower-case letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(_folded(text))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), _collapse(text, PUNCTUATION), F.lit(" "))


def reason_text(x: str | Column) -> Column:
    """Join key with punctuation as spaces and one space on both sides, so that keywords can end at a word."""
    return _spaced(_plain_letters(_c(x)))


def reason_code(text: Column) -> Column:
    """Code of the first family, in priority order, with a keyword in a `reason_text`; 0 when none matches. One pattern of all
    keywords finds the texts that have any; they are read once per family until they have a code."""
    families = [(code, "|".join(re.escape(w) for w in words)) for _, code, _, words in REASON_FAMILIES]
    every, other = "|".join(pattern for _, pattern in families), OTHER_REASON[1]

    @F.arrow_udf("int")
    def code_of(texts: pa.Array) -> pa.Array:
        codes = np.full(len(texts), other, dtype=np.int32)
        for at in range(0, len(texts), SOME_TEXTS):
            some = texts.slice(at, SOME_TEXTS)
            rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(some, every), False))
            for code, pattern in families:
                if len(rows) == 0:
                    break
                found = np.asarray(pc.match_substring_regex(some.take(rows), pattern))
                codes[at + rows[found]] = code
                rows = rows[~found]
        return pa.array(codes)

    return F.when(F.trim(text) == "", F.lit(other)).otherwise(code_of(text))  # blank texts need no Python


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins, so that the text itself isn't moved or compared again."""
    return [F.xxhash64(F.lit(1), text).alias("_key1"), F.xxhash64(F.lit(2), text).alias("_key2")]


def classified_texts(df: DataFrame, column: str) -> DataFrame:
    """(_text, _rows, _code): every distinct text once, with its number of rows and its code. Repeated texts collapse before
    they are shuffled, and the shuffle deals the texts out evenly, whatever the files they come from; the keyword chain,
    which costs far more than moving a text, runs behind it. NULL counts as empty."""
    texts = df.select(F.coalesce(_c(column), F.lit("")).alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("_rows"))
    # the steps of `reason_text`, each a column of its own so that it is built once and not wherever the next step names it
    folded = texts.withColumn("_folded", _plain_letters(F.col("_text"))).withColumn("_spaced", _spaced(F.col("_folded")))
    return folded.withColumn("_code", reason_code(F.col("_spaced"))).drop("_folded", "_spaced")


def _reason_lookups(code: Column) -> tuple[Column, Column]:
    """Family and fault flag of a code."""
    name, fault = F.lit(None).cast("string"), F.lit(None).cast("int")
    for fam, c, is_fault, _ in [*REASON_FAMILIES, (*OTHER_REASON, ())]:
        name = F.when(code == c, F.lit(fam)).otherwise(name)
        fault = F.when(code == c, F.lit(int(is_fault))).otherwise(fault)
    return name, fault


def add_reason_features(df: DataFrame, column: str, prefix: str = "reason") -> DataFrame:
    """Code, family, fault and weather flags. Every distinct text is classified once; rows meet its code by a key of 128
    bits, and the rest are lookups on the code."""
    keys = ["_key1", "_key2"]
    codes = classified_texts(df, column).select(*_text_key(F.col("_text")), F.col("_code").alias(f"{prefix}_code"))
    keyed = df.select("*", *_text_key(F.coalesce(_c(column), F.lit(""))))
    code = F.col(f"{prefix}_code")
    name, fault = _reason_lookups(code)
    return keyed.join(codes, keys).drop(*keys).withColumns(
        {f"{prefix}_family": name, f"{prefix}_fault": fault, f"{prefix}_weather": (code == 1).cast("int")}
    )


def reason_family_report(df: DataFrame, column: str) -> DataFrame:
    """Rows, fault flag and percent of all rows per family, from the distinct texts and their numbers of rows."""
    name, fault = _reason_lookups(F.col("_code"))
    counts = (
        classified_texts(df, column)
        .select(name.alias("reason_family"), fault.alias("fault"), "_rows")
        .groupBy("reason_family")
        .agg(F.sum("_rows").alias("rows"), F.max("fault").alias("fault"))
    )
    # over one row per family: a second aggregate would classify every text again
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("_n", total).select(
        "reason_family", "rows", "fault", F.round(safe_div(F.col("rows") * 100, "_n"), 2).alias("percent")
    )


NOT_FOUND = "NOT_FOUND"


def align_keys(
    df: DataFrame, column: str, reference: DataFrame, ref_column: str, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """Aligned key and the rescue that found it, in the order direct, qualifier, composite, alias, NOT_FOUND.

    Works on the distinct raw keys; the reference is met by equality joins. `df` may be rows: the mapping has one row
    per distinct raw key.
    """
    raw = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("raw")).distinct()
    base = join_key("raw")
    alias = F.lit(None).cast("string")
    for k, v in (aliases or {}).items():
        alias = F.when(base == k, F.lit(v)).otherwise(alias)
    tries = raw.select(
        "raw",
        base.alias("base"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("rank"), F.lit(m).alias("method"), c.alias("candidate"))
                    for i, (m, c) in enumerate(
                        (
                            ("direct", base),
                            ("qualifier", qualifier_key("raw")),
                            ("composite", composite_key("raw")),
                            ("alias", alias),
                        )
                    )
                ]
            )
        ),
    ).filter(F.col("candidate") != "")
    known = reference.select(F.col(ref_column).cast("string").alias("candidate")).distinct().withColumn("_k", F.lit(1))
    hits = tries.join(known, "candidate", "left")
    best = F.min_by(F.struct("candidate", "method"), F.when(F.col("_k") == 1, F.col("rank")))
    found = hits.groupBy("raw").agg(
        best.alias("b"), F.count("_k").alias("_n"), F.max("base").alias("base")
    )
    # a key with no usable candidate at all has an empty base
    return (
        raw.join(found, "raw", "left")
        .select(
            "raw",
            F.when(F.col("_n") > 0, F.col("b.candidate")).otherwise(F.coalesce("base", F.lit(""))).alias("key"),
            F.when(F.col("_n") > 0, F.col("b.method")).otherwise(F.lit(NOT_FOUND)).alias("method"),
        )
    )


def pick_group_column(
    df: DataFrame, candidates: Sequence[str], reference: DataFrame, ref_column: str
) -> DataFrame:
    """Match ratio over distinct values per candidate column and whether it is the one to group by (the first of the
    best; the first candidate when nothing matches)."""
    present = [c for c in candidates if c in df.columns]
    parts = None
    for i, c in enumerate(present):
        aligned = align_keys(df, c, reference, ref_column)
        one = aligned.agg(
            F.coalesce(
                safe_div(F.count_if(F.col("method") != NOT_FOUND), F.count(F.lit(1))), F.lit(0.0)
            ).alias("match_ratio")
        ).select(F.lit(c).alias("column"), F.lit(i).alias("position"), "match_ratio")
        parts = one if parts is None else parts.unionByName(one)
    # one row per candidate column
    best = parts.agg(F.min_by("column", F.struct(-F.col("match_ratio"), F.col("position"))).alias("c")).scalar()
    return parts.withColumn("_best", best).select(
        "column", "match_ratio", (F.col("column") == F.col("_best")).cast("int").alias("chosen")
    )


def diagnose_join(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row of counts: distinct keys, raw and normalised matches, keys only on one side, rescues by qualifier or
    composite part, and keys with a combining dot."""
    lraw = left.select(F.col(left_column).cast("string").alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    rraw = right.select(F.col(right_column).cast("string").alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    raw_both = lraw.join(rraw, "raw", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    lnorm = lraw.select(join_key("raw").alias("k")).distinct()
    rnorm = rraw.select(join_key("raw").alias("k")).distinct()
    flagged = rnorm.withColumn("_r", F.lit(1))
    rest = lnorm.join(rnorm, "k", "left_anti").select(
        "k", qualifier_key("k").alias("q"), composite_key("k").alias("c")
    )
    rescued = (
        rest.join(flagged.select(F.col("k").alias("q"), F.col("_r").alias("_rq")), "q", "left")
        .join(flagged.select(F.col("k").alias("c"), F.col("_r").alias("_rc")), "c", "left")
        .agg(
            F.count(F.lit(1)).alias("normalized_left_only"),
            F.count_if(F.col("_rq") == 1).alias("qualifier_rescue"),
            F.count_if(F.col("_rq").isNull() & (F.col("_rc") == 1) & (F.col("c") != F.col("k"))).alias(
                "composite_rescue"
            ),
        )
    )
    n_left = lnorm.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_right = rnorm.agg(F.count(F.lit(1)).alias("n")).scalar()
    dotted = (
        lraw.unionAll(rraw).agg(F.count_if(has_combining_dot("raw")).alias("n")).scalar()
    )
    left_unique = lraw.agg(F.count(F.lit(1)).alias("n")).scalar()
    right_unique = rraw.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = rescued.withColumns(
        {
            "left_unique": left_unique,
            "right_unique": right_unique,
            "raw_matched": raw_both,
            "_nl": n_left,
            "_nr": n_right,
            "combining_dot_keys": dotted,
        }
    )
    matched = F.col("_nl") - F.col("normalized_left_only")
    return out.select(
        "left_unique",
        "right_unique",
        "raw_matched",
        matched.alias("normalized_matched"),
        (matched - F.col("raw_matched")).alias("recovered"),
        (F.col("normalized_left_only") - F.col("qualifier_rescue") - F.col("composite_rescue")).alias("left_only"),
        (F.col("_nr") - matched).alias("right_only"),
        "qualifier_rescue",
        "composite_rescue",
        "combining_dot_keys",
    )
