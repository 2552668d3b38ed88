"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.collocations import collocations
from colloquy.llm.common import table
from colloquy.llm.decontaminate import contaminated
from colloquy.llm.hard_negatives import hard_negatives
from colloquy.llm.language import fit_language, language
from colloquy.llm.lm_scoring import lm_scores
from colloquy.llm.near_duplicates import near_duplicates
from colloquy.llm.ngram_join import ngram_join
from colloquy.llm.ogg import ogg_media
from colloquy.llm.packing import best_fit_packing
from colloquy.llm.quality import score_quality
from colloquy.llm.token_counts import token_counts
from colloquy.llm.toxicity import fit_toxicity, toxicity
from colloquy.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, fit_language(docs))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), g AS (  -- equal sets are one node
  SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY ALL
), e AS (
  SELECT rep, len(sh) AS n, unnest(sh) AS v FROM g
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.v = b.v AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(x, y) AS (
  SELECT rep, rep FROM g UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN g ON len(s.sh) > 0 AND g.sh = list_sort(s.sh) LEFT JOIN c ON c.x = g.rep
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS original,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(sha, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), relabel=True)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT * FROM n WHERE rank <= 5
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), g AS (  -- equal sets are one node
  SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY ALL
), e AS (
  SELECT rep, len(sh) AS n, unnest(sh) AS v FROM g
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.v = b.v AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(x, y) AS (
  SELECT rep, rep FROM g UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN g ON len(s.sh) > 0 AND g.sh = list_sort(s.sh) LEFT JOIN c ON c.x = g.rep
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i : i + m - 1])) AS run
  FROM w, (VALUES (1), (2), (3), (4)) AS sizes(m)
), f AS (
  SELECT lang, run, m, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, run, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= 30
), s AS (
  SELECT c.lang, c.run, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.run = c.run[: c.k] JOIN f y ON y.lang = c.lang AND y.run = c.run[c.k + 1 :]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, run ORDER BY score, k) = 1
), o AS (
  SELECT lang, run, m, f, unnest(range(2, m)) AS size FROM f WHERE m > 2 AND f >= 30
), i AS (
  SELECT lang, run[pos : pos + size - 1] AS run, max(f) AS around
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS pos FROM o) GROUP BY ALL
), t AS (
  SELECT b.lang, array_to_string(b.run, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.run = b.run WHERE i.around IS NULL OR 100::HUGEINT * i.around < 80::HUGEINT * b.a
)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM t JOIN n ON n.lang = t.lang QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_language": op3_language,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_lm_scores": op7_lm_scores,
        "op8_warc": op8_warc,
        "op9_ogg": op9_ogg,
        "op10_toxicity": op10_toxicity,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_ngram_join": op12_ngram_join,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": OP4_SQL, "op8_warc": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_collocations": OP13_SQL}
