"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: byte trigrams of the letters of the whole text, under one model per language and a flat one for `und` (no known
  language). Trigrams depend on each other, so their mean log likelihood counts as at most `EVIDENCE` of them.
* Declared language (markup, metadata): P(declared | language), from counts over all documents.
* Address suffix (last label of the host and a language-like first path segment): P(suffix | language), likewise.
* Host: a prior smoothed from the corpus to the domain to the host, from counts over all documents.

The counts are sums of the text posteriors, by grouped aggregation; a document's own share is taken out of its host and
domain counts before they become its prior. Grouping sums on the map side, so one host with a third of all rows is a row per task.
The text models are fitted on a bounded sample of rows with a declared language (`sample_rows` per language, by hash of
the id); declared languages with at least `min_rows` rows are the known ones.

A document is rejected if it has no letters, if `und` is likeliest, or if the likeliest language has a posterior below
`threshold`.

Defined cases: NULL and empty texts are rejected; a missing declaration, suffix or host is no evidence (the host prior is
then the corpus prior); declared values that are no known language count as one value, `other`; ties go to the language
that is first in the alphabet; repeated rows get a row each; without any declared language every document is rejected; an
empty table gives an empty result. Input columns may have any name but those starting with `_lid_`.
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from panelforge.core.scale import written
from panelforge.llm.words import LETTERS, text_blocks

SAMPLE_ROWS = 1500
MIN_ROWS = 5
EVIDENCE = 60
THRESHOLD = 0.6
STRENGTH = 5.0
#: Share of the flat model in each language's model.
FLAT = 0.2
_BITS = 16
UNKNOWN = "und"
#: Bytes of text scored at once. Its trigrams take some fifty times as much, in every running task.
SCORED_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    """Known languages in alphabetical order, then `und`; log P(trigram | language) by hashed trigram."""

    languages: list[str]
    table: np.ndarray


def tag(declared: str | Column) -> Column:
    """Primary subtag in lower case, NULL if there is none: en-US is en."""
    declared = F.col(declared) if isinstance(declared, str) else declared
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def markup_language(html: str) -> Column:
    """The lang attribute of the html element."""
    return F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(markup.unescape, na_action="ignore")


def page_text(html: str) -> Column:
    """The text of a page: scripts, styles, comments and tags are spaces, character references are characters."""
    hidden = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|</?[a-z!?][^>]*>"
    return _unescape(F.regexp_replace(html, hidden, " "))


def host_of(url: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(url: str) -> Column:
    """Last label of the host with a two-letter first path segment: net/en, de, com."""
    last = F.regexp_extract(host_of(url), r"([^.]+)$", 1)
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return F.when(host_of(url).isNotNull(), F.when(path != "", F.concat(last, F.lit("/"), path)).otherwise(last))


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams whose middle is a letter, row after row, and where each row begins."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = LETTERS[data].astype(np.uint32)
    code[(data >= 48) & (data <= 57)] = 0  # digits have no language
    first_byte = np.zeros(n + 1, bool)
    first_byte[offsets] = True
    before = np.where(first_byte[:n], 0, np.concatenate([[0], code[:-1]])).astype(np.uint32)
    after = np.where(first_byte[1:], 0, np.concatenate([code[1:], [0]])).astype(np.uint32)
    places = np.flatnonzero(code)
    key = (before[places] << np.uint32(16)) | (code[places] << np.uint32(8)) | after[places]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int64), np.searchsorted(places, offsets)


def likelihoods(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Per row and language the tempered log likelihood; rows without letters get NaN."""
    keys, first = _trigrams(data, offsets)
    n = np.diff(first)
    sums = np.zeros((len(n), model.table.shape[1]))
    some = n > 0
    if some.any():
        for j in range(sums.shape[1]):
            run = np.concatenate([[0.0], np.cumsum(model.table[keys, j], dtype=np.float64)])
            sums[:, j] = run[first[1:]] - run[first[:-1]]
    sums *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
    sums[~some] = np.nan
    return sums


def fit_texts(rows: DataFrame, sample_rows: int, min_rows: int) -> Model:
    """`rows` (id, text, declared). Trigram models of the declared languages from a bounded sample."""
    known = rows.filter(F.col("declared").isNotNull() & (F.length("text") > 0))
    counts = {r.declared: r["count"] for r in known.groupBy("declared").count().collect()}  # subtags of 2 or 3 letters
    languages = sorted(k for k, n in counts.items() if n >= min_rows)
    if not languages:
        return Model([], np.zeros((1 << _BITS, 1), np.float32))
    share = F.lit(0.0)
    for k in languages:
        share = F.when(F.col("declared") == k, F.lit(min(1.0, sample_rows / counts[k]))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / float(1 << 53)
    sample = known.filter(draw < share).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 << _BITS, np.int64) for k in languages}
        for b in batches:
            names = b.column(0).to_pylist()
            for at, _, data, offsets in text_blocks(b.column(1), SCORED_BYTES):
                keys, first = _trigrams(data, offsets)
                for i in range(len(first) - 1):
                    total[names[at + i]] += np.bincount(keys[first[i] : first[i + 1]], minlength=1 << _BITS)
        for k, v in total.items():
            hit = np.flatnonzero(v)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(hit)), pa.array(hit), pa.array(v[hit])], ["lang", "key", "n"])

    found = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((1 << _BITS, len(languages) + 1))
    lang = np.array([languages.index(x) for x in found.column("lang").to_pylist()], dtype=np.int64)
    table[found.column("key").to_numpy(), lang] += found.column("n").to_numpy()
    table = (1 - FLAT) * table / np.maximum(table.sum(axis=0), 1) + FLAT / (1 << _BITS)
    table[:, -1] = 1.0 / (1 << _BITS)
    return Model(languages, np.log(table).astype(np.float32))


def with_likelihoods(rows: DataFrame, text_col: str, model: Model, keep: list[str]) -> DataFrame:
    """Adds `_lid_text`, the tempered log likelihoods (NULL for texts without letters), to the kept columns."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    at_text = rows.columns.index(text_col)
    at_keep = [rows.columns.index(k) for k in keep]
    schema = rows.select(*[F.col(f"`{k}`") for k in keep]).schema.add("_lid_text", ArrayType(DoubleType()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(at_text), SCORED_BYTES):
                values = likelihoods(data, offsets, sent.value)
                lists = pa.array([None if np.isnan(v[0]) else v for v in values], pa.list_(pa.float64()))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in at_keep], lists], [*keep, "_lid_text"])

    return rows.mapInArrow(score, schema)


@F.pandas_udf(ArrayType(DoubleType()))
def _softmax(logs: pd.Series) -> pd.Series:
    return pd.Series(list(_posterior(np.stack(logs)))) if len(logs) else logs


def _sums(n: int, column: str = "p") -> Column:
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(n)])


def _given(rows: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """log P(key value | language) with one imagined document per value, from text posteriors."""
    table = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(_sums(n).alias("c"))
    whole = table.agg(F.count(F.lit(1)).cast("double").alias("values"), _sums(n, "c").alias("all"))
    both = table.crossJoin(F.broadcast(whole))  # one row
    logs = F.zip_with("c", "all", lambda c, a: F.log((c + 1.0) / (a + F.col("values"))))
    return both.select(key, logs.alias(out))


@dataclass(frozen=True)
class Fitted:
    """What fusion needs besides the row: the text model and the tables of the other evidence."""

    model: Model
    corpus: list[float]
    declared: DataFrame
    suffix: DataFrame
    domains: DataFrame
    hosts: DataFrame


_KEYS = ("_lid_declared", "_lid_suffix", "_lid_host", "_lid_domain")


def _prepare(docs: DataFrame, text_col: str, declared: Column | None, suffix: Column | None, host: Column | None) -> DataFrame:
    """Adds the evidence columns; the domain is the last two labels of the host."""
    none = F.lit(None).cast("string")
    host = none if host is None else host.cast("string")
    return docs.withColumns(
        {
            "_lid_body": F.coalesce(F.col(text_col), F.lit("")),
            "_lid_declared": none if declared is None else tag(declared.cast("string")),
            "_lid_suffix": none if suffix is None else suffix.cast("string"),
            "_lid_host": host,
            "_lid_domain": F.regexp_extract(host, r"([^.]*\.?[^.]+)$", 1),
        }
    )


def fit(prepared: DataFrame, id_col: str, sample_rows: int, min_rows: int) -> tuple[Fitted | None, DataFrame]:
    """Text models, then the tables of the other evidence over all documents; also the scored slim rows."""
    texts = prepared.select(F.col(id_col).alias("id"), F.col("_lid_body").alias("text"), F.col("_lid_declared").alias("declared"))
    model = fit_texts(texts, sample_rows, min_rows)
    n = len(model.languages) + 1
    known = F.col("_lid_declared").isin(model.languages) if model.languages else F.lit(False)
    prepared = prepared.withColumn("_lid_declared", F.when(known, F.col("_lid_declared")).when(F.col("_lid_declared").isNotNull(), "other"))
    slim = prepared.select(F.col(id_col).alias("_lid_id"), "_lid_body", *_KEYS)
    slim = written(with_likelihoods(slim, "_lid_body", model, ["_lid_id", *_KEYS]), "likelihoods")
    if not model.languages:
        return None, slim
    scored = slim.filter(F.col("_lid_text").isNotNull()).withColumn("p", _softmax("_lid_text"))
    total = scored.agg(_sums(n).alias("c")).first()[0]
    total = [x or 0.0 for x in total]
    corpus = [(x + 1.0) / (sum(total) + n) for x in total]
    fitted = Fitted(
        model,
        corpus,
        written(_given(scored, "_lid_declared", n, "_lid_p_declared"), "declared"),
        written(_given(scored, "_lid_suffix", n, "_lid_p_suffix"), "suffixes"),
        written(scored.filter("_lid_domain IS NOT NULL").groupBy("_lid_domain").agg(_sums(n).alias("_lid_c_domain")), "domains"),
        written(scored.filter("_lid_host IS NOT NULL").groupBy("_lid_host").agg(_sums(n).alias("_lid_c_host")), "hosts"),
    )
    return fitted, slim


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fused(
    text: np.ndarray, known: np.ndarray, declared: np.ndarray, suffix: np.ndarray, domain: np.ndarray, host: np.ndarray, corpus: np.ndarray
) -> np.ndarray:
    """Posterior of every row. `known` says which rows have text evidence; logs and counts that a row lacks are 0. Counts
    lose the document's own share and are smoothed with STRENGTH imagined documents like the level above."""
    own = np.where(known[:, None], _posterior(text), 0.0)
    prior = np.broadcast_to(corpus, own.shape)
    for counts in (domain, host):
        rest = np.maximum(counts - own, 0)
        prior = (rest + STRENGTH * prior) / (rest.sum(axis=1, keepdims=True) + STRENGTH)
    return _posterior(text + np.log(prior) + declared + suffix)


_EVIDENCE = ("_lid_p_declared", "_lid_p_suffix", "_lid_c_domain", "_lid_c_host")


def _with_evidence(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """Adds what the tables say of each row's declaration, suffix, domain and host; zeros where they say nothing."""
    none = F.array(*[F.lit(0.0)] * (len(fitted.model.languages) + 1))
    rows = rows.join(fitted.declared, "_lid_declared", "left").join(fitted.suffix, "_lid_suffix", "left")
    rows = rows.join(fitted.domains, "_lid_domain", "left").join(fitted.hosts, "_lid_host", "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in _EVIDENCE})


def fuse(rows: DataFrame, fitted: Fitted | None, threshold: float) -> DataFrame:
    """Adds `_lid_lang` (NULL if rejected), `_lid_confidence` and `_lid_rejected` to rows with evidence columns."""
    if fitted is None:
        return rows.withColumns(
            {"_lid_lang": F.lit(None).cast("string"), "_lid_confidence": F.lit(0.0), "_lid_rejected": F.lit(True)}
        )
    names = [*fitted.model.languages, UNKNOWN]
    corpus = np.array(fitted.corpus)

    @F.pandas_udf("name string, confidence double")
    def best(text: pd.Series, known: pd.Series, declared: pd.Series, suffix: pd.Series, domain: pd.Series, host: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"name": pd.Series([], dtype=str), "confidence": pd.Series([], dtype=float)})
        p = fused(np.stack(text), known.to_numpy(dtype=bool), *(np.stack(x) for x in (declared, suffix, domain, host)), corpus)
        return pd.DataFrame({"name": [names[i] for i in p.argmax(axis=1)], "confidence": p.max(axis=1)})

    none = F.array(*[F.lit(0.0)] * len(names))
    known = F.col("_lid_text").isNotNull()
    rows = _with_evidence(rows, fitted).withColumn("_lid_best", best(F.coalesce("_lid_text", none), known, *_EVIDENCE))
    name, confidence = F.col("_lid_best.name"), F.col("_lid_best.confidence")
    rejected = ~known | (name == UNKNOWN) | (confidence < threshold)
    return rows.withColumns({"_lid_lang": F.when(~rejected, name), "_lid_confidence": confidence, "_lid_rejected": rejected})


def _not_rejected(rows: DataFrame, text_col: str, fitted: Fitted, threshold: float, keep: list[str]) -> DataFrame:
    """The kept columns of the rows that `fuse` would not reject. Texts are scored and fused in one pass, so that a task has
    one Python worker, which is sent every text once."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted.model)
    corpus = np.array(fitted.corpus)
    und = len(fitted.model.languages)
    at_text = keep.index(text_col)
    rows = _with_evidence(rows, fitted).select(*[F.col(f"`{k}`") for k in keep], *_EVIDENCE)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(at_text), SCORED_BYTES):
                part = batch.slice(at, end - at)
                text = likelihoods(data, offsets, sent.value)
                known = ~np.isnan(text[:, 0])
                evidence = [c.flatten().to_numpy().reshape(text.shape) for c in part.columns[len(keep) :]]
                p = fused(np.where(known[:, None], text, 0.0), known, *evidence, corpus)
                fine = known & (p.argmax(axis=1) != und) & (p.max(axis=1) >= threshold)
                if fine.any():
                    yield part.select(range(len(keep))).filter(pa.array(fine))

    return rows.mapInArrow(decide, rows.select(*[F.col(f"`{k}`") for k in keep]).schema)


def identify(
    docs: DataFrame,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    min_rows: int = MIN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Language, posterior and rejection of every document."""
    fitted, slim = fit(_prepare(docs, text_col, declared, suffix, host), id_col, sample_rows, min_rows)
    return fuse(slim, fitted, threshold).select(
        F.col("_lid_id").alias(id_col),
        F.col("_lid_lang").alias("language"),
        F.col("_lid_confidence").alias("confidence"),
        F.col("_lid_rejected").alias("rejected"),
    )


def accepted(
    docs: DataFrame,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    min_rows: int = MIN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    prepared = _prepare(docs, text_col, declared, suffix, host)
    fitted, _ = fit(prepared, id_col, sample_rows, min_rows)
    if fitted is None:
        return docs.limit(0)
    known = F.col("_lid_declared").isin(fitted.model.languages)
    prepared = prepared.withColumn("_lid_declared", F.when(known, F.col("_lid_declared")).when(F.col("_lid_declared").isNotNull(), "other"))
    return _not_rejected(prepared, text_col, fitted, threshold, docs.columns)
