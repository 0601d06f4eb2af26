"""The registered queries: each operator applied, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagecensus.llm import (
    bilinear, debruijn, fingerprints, forest, jaccard, licences, packing, pieces, pii, prefixes, quality, residues,
    suffixes,
)
from pagecensus.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Strings of 400 bytes are removed; passages of over 50 words in several documents, mostly shorter, are counted.
    return suffixes.digests(suffixes.remove_repeats(load(spark, sf_dir, "documents"), shared_words=51))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_edits(load(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(load(spark, sf_dir, "documents"), words=4, percent=85)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(licences.scan(load(spark, sf_dir, "documents")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(load(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.posteriors(docs, model).selectExpr(
        "doc_id", "_evidence AS evidence", "_host_share AS host_share", "_path_share AS path_share",
        "_good AS good", f"_good >= {quality.THRESHOLD} AS keep",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(load(spark, sf_dir, "documents"), model, with_ids=False)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.with_surrogates(load(spark, sf_dir, "documents"), pii.key_of(spark))
    return replaced.selectExpr(
        "doc_id", "text", "CAST(size(_entities) AS LONG) AS n_entities",
        "transform(_entities, e -> named_struct('kind', e.kind, 'start', e.start, 'surrogate', e.surrogate)) AS entities",
    )


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(debruijn.remove_repeats(load(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.ordered_turns(load(spark, sf_dir, "conversations"))
    return prefixes.with_digests(prefixes.trie(*prefixes.with_shared_openings(turns)))


def op12_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.scored(load(spark, sf_dir, "documents"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "if(vec_id % 7 = 0, (CAST(label AS LONG) + 1) % 10, label) AS label"
    )
    return residues.hard_negatives(vectors, "vec_id % 50 = 0")


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_repeats": op1_suffix_repeats,
        "op2_fingerprints": op2_fingerprints,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_licence_scan": op4_licence_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_forest": op6_forest,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_surrogates": op9_surrogates,
        "op10_debruijn": op10_debruijn,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_bilinear": op12_bilinear,
        "op13_residue_negatives": op13_residue_negatives,
    }


# Sets of shingles, pairs that share enough of them, and what can be reached through pairs.
OP3_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS s FROM split),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items AS a JOIN items AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON l.x = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM sets AS s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) AS m ON m.x = s.doc_id
"""

# Words in order, runs of 13 words, the first document of each, and the words such runs cover.
OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) AS split),
windows AS (
  SELECT *, CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS run FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
judged AS (
  SELECT doc_id, word, i, run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id AS later FROM windows),
covered AS (
  SELECT doc_id, word, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM judged),
steps AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered)
SELECT d.doc_id, count(s.i) AS n_words, CAST(count(*) FILTER (s.gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(s.word, ' ' ORDER BY s.i) FILTER (NOT s.gone), '')) AS kept_sha256,
  count(*) FILTER (s.opens) AS n_spans
FROM documents AS d LEFT JOIN steps AS s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


# Rebuilt conversations, all their prefixes, a node per distinct prefix, and totals over the nodes that
# each node's smallest member stands for further down. The CRC-32 is computed bit by bit.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha) AS pos, sha, words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL) AS t),
convs AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS source, xor(list_reduce(
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda acc, byte: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(acc, byte)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) AS c),
planned AS (
  SELECT c.conv_id, c.h, c.source, least(c.h, coalesce(s.n, 0)) AS given, least(c.h, coalesce(s.n, 0)) + greatest(c.n - c.h, 0) AS length
  FROM convs AS c LEFT JOIN convs AS s ON s.conv_id = c.source),
rebuilt AS (
  SELECT p.conv_id, t.pos, t.sha, t.words, p.length FROM planned AS p JOIN turns AS t ON t.conv_id = p.source AND t.pos <= p.given
  UNION ALL SELECT p.conv_id, t.pos - p.h + p.given, t.sha, t.words, p.length FROM planned AS p JOIN turns AS t ON t.conv_id = p.conv_id AND t.pos > p.h),
paths AS (
  SELECT conv_id, pos AS depth, string_agg(sha, '' ORDER BY pos) OVER so_far AS prefix, words, length FROM rebuilt
  WINDOW so_far AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0, length FROM planned),
nodes AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, prefix),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.prefix = left(n.prefix, 64 * (CAST(n.depth AS BIGINT) - 1))),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY parent_conv_id, depth - 1),
counted AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked AS l LEFT JOIN children AS c ON c.conv_id = l.conv_id AND c.depth = l.depth),
totals AS (
  SELECT p.depth, p.prefix, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.words) AS BIGINT) AS saved_tokens
  FROM counted AS u JOIN paths AS p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.depth, p.prefix)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, t.n_leaves, t.saved_tokens, c.ends_sha256
FROM counted AS c JOIN totals AS t ON t.depth = c.depth AND t.prefix = c.prefix
"""

# All scores of the anchors in double precision, which is exact for integers of this size.
OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors AS a JOIN vectors AS r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scores AS s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER best <= 3
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express on whole tables in reasonable time."""
    return {
        "op3_jaccard_join": OP3_SQL,
        "op10_debruijn": OP10_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op13_residue_negatives": OP13_SQL,
    }
