"""Registered queries of the subpackage, one per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.collocations import collocations
from panelforge.llm.decontaminate import contamination
from panelforge.llm.exact_dedup import exact_duplicates
from panelforge.llm.jaccard_join import jaccard_links
from panelforge.llm.kd_sharding import kd_shards
from panelforge.llm.language_id import host_of, identify, markup_language, page_text, suffix_of
from panelforge.llm.mixing import mixture
from panelforge.llm.pii import personal_data
from panelforge.llm.prefix_trie import prefix_trie
from panelforge.llm.quality_cnn import quality_scores
from panelforge.llm.simhash_anchors import simhash_components
from panelforge.llm.token_counts import token_counts
from panelforge.llm.warc import roundtrip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def add_to(queries: dict, oracles: dict) -> None:
    import corpus_pipeline

    queries.update(QUERIES, pipeline=corpus_pipeline.run)
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    oracles.update(ORACLES)


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


ORACLES["op2_decontamination"] = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS number FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM low, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occurs AS (SELECT doc_id, i, k, item FROM place JOIN win USING (k, words)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS spot FROM occurs) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occurs) GROUP BY 1),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM low),
iw AS (SELECT item, number, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM item),
runs AS (
  SELECT doc_id, item, min(i) AS i, count(*) AS n
  FROM (SELECT doc_id, item, number, i, j, i - row_number() OVER (PARTITION BY doc_id, number, i - j ORDER BY i) AS run
        FROM dw JOIN iw USING (word))
  GROUP BY doc_id, item, number, j - i, run),
longest AS (
  SELECT doc_id, n, i - 1 AS spot, item FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i, item) = 1)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated,
       coalesce(longest.n, 0) AS longest, longest.spot AS longest_at, longest.item AS longest_item
FROM low LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


@_query
def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"), shards=16)


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(_table(spark, sf_dir, "pages"))


ORACLES["op8_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31) + 1, 1)
                        for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


@_query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


@_query
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared language of a document is its `lang`, its host is its `source`."""
    return identify(_table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


@_query
def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all kinds of evidence: text, markup, address suffix and the host under its domain."""
    pages = _table(spark, sf_dir, "pages").withColumn("text", page_text("html"))
    return identify(pages, markup_language("html"), suffix_of("url"), host_of("url"), id_col="page_id")


@_query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(_table(spark, sf_dir, "documents"), width=3, percent=90)


@_query
def op12_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), width=4, threshold=4)


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), min_count=100, longest=5, top=2000)


ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (
  SELECT lang, k, w[i:i + k - 1] AS ph
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM p, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY lang, k, ph),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM f WHERE k >= 2 AND a >= 100),
free AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT free.lang, free.phrase, free.a, n.n, j, x.a AS l, y.a AS r,
         ((1000::HUGEINT * free.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM free) AS free
  JOIN n ON n.lang = free.lang
  JOIN f AS x ON x.lang = free.lang AND x.k = j AND x.ph = free.ph[1:j]
  JOIN f AS y ON y.lang = free.lang AND y.k = free.k - j AND y.ph = free.ph[j + 1:free.k]),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


# crc32 bit by bit over the decimal digits; nodes by the text of their turns
ORACLES["op11_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, l, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 6 AS h
  FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l
  FROM h LEFT JOIN t AS b ON b.conv_id = h.base),
m AS (SELECT conv_id, len(l) AS turns, l, unnest(generate_series(0, len(l))) AS depth FROM r),
n AS (
  SELECT l[1:depth]::VARCHAR AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         min(CASE WHEN depth > 0 THEN l[1:depth - 1]::VARCHAR END) AS up,
         min(CASE WHEN depth > 0 THEN length(l[depth].t) ELSE 0 END) AS points,
         any_value(l[1:depth]) AS path,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
c AS (SELECT up AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
full_n AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (p, depth)),
below AS (
  SELECT path[1:d]::VARCHAR AS p, d AS depth, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
         sum((n_convs - 1) * points)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM full_n) GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM full_n v JOIN below b ON b.p = v.p AND b.depth = v.depth
LEFT JOIN n AS u ON u.p = v.up AND u.depth = v.depth - 1
"""


ORACLES["op1_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached AS (
  SELECT doc_id AS node, doc_id AS root FROM w
  UNION SELECT both_ways.b, reached.root FROM reached JOIN both_ways ON both_ways.a = reached.node),
c AS (SELECT node, min(root) AS component_id FROM reached GROUP BY 1),
l AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(l.n, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id LEFT JOIN l ON l.a = w.doc_id
"""
