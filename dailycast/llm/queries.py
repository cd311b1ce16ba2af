"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dailycast.llm import (dialogue, fingerprints, jaccard, language, merkle, mixing, neighbours, packing, phrases, pieces, quality,
                           records, scoring)
from dailycast.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-copy component (five words, similarity 0.8)."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered once for each of its participants, turn by turn."""
    return dialogue.rotate(table(spark, sf_dir, "conversations"))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids through record files and their index, read back in order."""
    return records.record_table(table(spark, sf_dir, "documents"))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every text and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score against all other documents."""
    return scoring.backoff_scores(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by positive-unlabelled learning."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth id."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language with its calibrated probability."""
    return language.identify_language(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix by source weights takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and the root folded from its tampered text."""
    return merkle.manifest_table(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's first 2000 collocations of two to four words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentence-piece ids and decoded text, as digests."""
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_perspective_rotation, op3_binary_records, op4_imatch_fingerprints, op5_backoff_scores,
    op6_quality_classifier, op7_vantage_point_trees, op8_language_id, op9_mix_sources, op10_best_fit_packing,
    op11_merkle_manifest, op12_phrase_collocations, op13_sentence_pieces)}

ORACLE_SQL: dict[str, str] = {
    "op9_mix_sources": r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, 3 * source_size AS cap FROM sources),
lined AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS words_left,
         (sum(w) OVER after)::BIGINT AS weights
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
marked AS (SELECT *, cap * weights <= words_left * w AS is_full FROM lined),
level AS (SELECT words_left AS l, weights AS ws FROM marked WHERE NOT is_full ORDER BY cap / w, r LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (SELECT l FROM level)::DOUBLE * w / (SELECT ws FROM level) END AS target
  FROM marked),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('9:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it FROM sizes)
SELECT p.doc_id, p.source, p.size, t.source_size, t.target,
       (CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END * p.size
        + greatest(0, least(p.size, round(t.target)::BIGINT
            - CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END * t.source_size
            - p.before_it)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
""",
    # crc32 bit by bit over the decimal id's bytes: 256 + byte enters a byte, the eight steps after it shift it through
    "op11_merkle_manifest": r"""
WITH RECURSIVE
rows AS (
  SELECT doc_id, lang, text, row_number() OVER () AS r,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         CASE WHEN doc_id IS NULL THEN FALSE ELSE
           xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
                 lambda i: [256 + ascii(substr(doc_id::VARCHAR, i, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))),
               lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 3 = 0
         END AS hit
  FROM documents),
hashed AS (
  SELECT doc_id, lang, r, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS start
  FROM rows),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
low AS (
  SELECT lang, 0 AS level, idx::BIGINT AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS size FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, string_agg(h, '' ORDER BY idx), any_value(size + 7) // 8
  FROM (SELECT lang, level, idx, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h, size FROM low) p
  WHERE size > 1 GROUP BY lang, level, idx // 8),
nodes AS (SELECT lang, level, idx, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h, size FROM low),
subroots AS (
  SELECT lang, level AS top, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
high AS (
  SELECT 0 AS level, k::BIGINT AS idx, h, size FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, string_agg(h, '' ORDER BY idx), any_value(size + 7) // 8
  FROM (SELECT level, idx, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h, size FROM high) p
  WHERE size > 1 GROUP BY level, idx // 8),
above AS (SELECT level, idx, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h, size FROM high),
links AS (  -- each node with the nodes to its left and right in its run
  SELECT n.lang, NULL::BIGINT AS upper, n.level, n.idx, s.k, s.top,
         coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < n.idx), '') AS l,
         coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > n.idx), '') AS r
  FROM nodes n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang
       JOIN nodes o ON o.lang IS NOT DISTINCT FROM n.lang AND o.level = n.level AND o.idx // 8 = n.idx // 8
  WHERE n.size > 1 GROUP BY ALL),
uplinks AS (
  SELECT n.level, n.idx, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < n.idx), '') AS l,
         coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > n.idx), '') AS r
  FROM above n JOIN above o ON o.level = n.level AND o.idx // 8 = n.idx // 8
  WHERE n.size > 1 GROUP BY ALL),
climb AS (
  SELECT l.r, s.lang, s.top, s.k, 0 AS level, l.idx::BIGINT AS idx, l.start AS folded, '' AS proof, l.leaf, l.doc_id, s.h AS subroot
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT c.r, c.lang, c.top, c.k, c.level + 1, CASE WHEN c.level + 1 = c.top THEN c.k ELSE c.idx // 8 END,
         sha256(n.l || c.folded || n.r), c.proof || n.l || n.r, c.leaf, c.doc_id, c.subroot
  FROM climb c JOIN links n ON n.lang IS NOT DISTINCT FROM c.lang AND n.level = c.level AND n.idx = c.idx
  WHERE c.level < c.top),
climbed AS (SELECT r, k AS idx, 0 AS level, folded, proof, leaf, doc_id, subroot FROM climb WHERE level = top),
final AS (
  SELECT * FROM climbed
  UNION ALL
  SELECT c.r, c.idx // 8, c.level + 1, sha256(n.l || c.folded || n.r), c.proof || n.l || n.r, c.leaf, c.doc_id, c.subroot
  FROM final c JOIN uplinks n ON n.level = c.level AND n.idx = c.idx),
root AS (SELECT h, level FROM above WHERE size = 1)
SELECT f.doc_id, f.leaf, f.subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root,
       f.folded = root.h AS verified
FROM final f JOIN root ON f.level = root.level
""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?
-
]')) AS piece FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, g, count(*) AS f
  FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS g
        FROM runs) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE f >= 30),
opened AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM frequent WHERE len(g) > 1),
halves AS (SELECT *, g[1:k] AS first_part, g[k + 1:] AS rest FROM opened),
cuts AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM halves c JOIN frequent l ON l.lang = c.lang AND l.g = c.first_part JOIN frequent r ON r.lang = c.lang AND r.g = c.rest),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda n: list_transform(range(1, len(g) - n + 2), lambda i: g[i:i + n - 1])))) AS part
  FROM frequent WHERE len(g) > 2),
longest AS (SELECT lang, part, max(f) AS f FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM least c LEFT JOIN longest o ON o.lang = c.lang AND o.part = c.g
  WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * c.a),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
