"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode
from .centroids import cluster_vectors
from .common import recorded, release, table
from .filter_audit import audit
from .language import identify
from .lm_scoring import score_texts
from .media import fingerprint_media
from .neighbours import nearest_neighbours
from .packing import pack
from .quality import resample
from .secrets import scan
from .simhash import near_duplicates
from .substring_dedup import dedup_words
from .suffix_dedup import dedup_bytes


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), keep_text=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"), keep_text=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_media(table(spark, sf_dir, "documents"), keep_media=False)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _tidy(query):
    """The query, which deletes those of its own tables that the result doesn't read."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables: list[str] = []
        with recorded(tables):
            out = query(spark, sf_dir)
        release(tables, out)
        return out

    return run


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_neighbours": op4_neighbours,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_media": op8_media,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

QUERIES = {name: _tidy(query) for name, query in QUERIES.items()}



def _lloyd_sql(rounds: int) -> str:
    """Centroids c0, c1, ... by one assignment after another, over one row a component."""
    assigned = """a{i} AS MATERIALIZED (
  SELECT vec_id, min_by(k, (d, k)) k, min(d) d FROM (SELECT x.vec_id, c.k, sum((x.v - c.v) * (x.v - c.v))::BIGINT d FROM x JOIN c{i} c ON c.p = x.p GROUP BY x.vec_id, c.k) GROUP BY vec_id)"""
    moved = """c{j} AS MATERIALIZED (
  SELECT c.k, c.p, coalesce((s - (s % n + n) % n) // n, c.v)::BIGINT v
  FROM c{i} c LEFT JOIN (SELECT a.k, x.p, sum(x.v) s, count(*) n FROM a{i} a JOIN x USING (vec_id) GROUP BY a.k, x.p) m ON m.k = c.k AND m.p = c.p)"""
    parts = [assigned.format(i=0)]
    for i in range(rounds):
        parts += [moved.format(i=i, j=i + 1), assigned.format(i=i + 1)]
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) p, floor(256 * unnest(embedding)::DOUBLE)::BIGINT v FROM e),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 k FROM e QUALIFY k < 40),
c0 AS MATERIALIZED (SELECT k, p, v FROM first JOIN x USING (vec_id)),
{", ".join(parts)},
digests AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY p)) h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER "cluster", d distance, (sum(d) OVER (PARTITION BY k))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia, h centroid_sha256
FROM a{rounds} JOIN digests USING (k)"""


#: The given tables have no null doc_id and no doc_id twice.
SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) h FROM documents),
bytes AS (SELECT doc_id, h, unnest(range(1, octet_length(h) + 1)) p FROM d),
win AS (SELECT doc_id, p, CASE WHEN p + 49 <= octet_length(h) THEN h[p:p + 49] END k, hex(h[p:p]) x FROM bytes),
own AS (SELECT k, min(doc_id) owner FROM win WHERE k IS NOT NULL GROUP BY k),
dup AS (SELECT w.doc_id, p, x, owner < w.doc_id dup FROM win w LEFT JOIN own o ON w.k = o.k),
gone AS (SELECT doc_id, p, x, coalesce(max(CASE WHEN dup THEN p END) OVER (PARTITION BY doc_id ORDER BY p), -50) > p - 50 gone FROM dup),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) head FROM gone),
agg AS (SELECT doc_id, count_if(gone) n_removed, count_if(head) n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), '') kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, octet_length(h) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
FROM d LEFT JOIN agg a ON a.doc_id = d.doc_id""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) p, unnest(ws) word, len(ws) n FROM d),
win AS (SELECT w.doc_id, p, CASE WHEN p + 19 <= n THEN array_to_string(ws[p:p + 19], ' ') END k, word FROM words w JOIN d ON d.doc_id = w.doc_id),
dup AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 dup FROM win),
gone AS (SELECT doc_id, p, word, coalesce(max(CASE WHEN dup THEN p END) OVER (PARTITION BY doc_id ORDER BY p), -20) > p - 20 gone FROM dup),
agg AS (SELECT doc_id, count_if(gone) n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN agg a ON a.doc_id = d.doc_id""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY text) first FROM d),
m AS MATERIALIZED (SELECT part, len(ws) < 200 a, 100 * len(list_distinct(ws)) < 50 * len(ws) b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) c,
  regexp_matches(text, '[#$%&*|]') d, doc_id > first e, coalesce(quality = 1, false) good, coalesce(toxic = 1, false) toxic FROM w LEFT JOIN labels USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) l),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (SELECT o, step, o[step] f, o[1:step - 1] before FROM orders, range(1, 6) r(step)),
sets AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) failed,
  count(*) n, count_if(good) good, count_if(toxic) toxic FROM m GROUP BY ALL),
flags AS (SELECT part, o, step, f, n, good, toxic, failed, contains(failed, f) fails, before <> '' AND regexp_matches(failed, '[' || before || '_]') gone FROM sets, steps),
counts AS (SELECT part, o filter_order, step, f, sum(n) FILTER (WHERE NOT fails AND NOT gone) kept, sum(n) FILTER (WHERE fails AND NOT gone) removed, sum(n) FILTER (WHERE fails AND gone) redundant,
  sum(n) FILTER (WHERE failed = f) unique_fails, sum(good) FILTER (WHERE fails AND NOT gone) good_lost, sum(toxic) FILTER (WHERE fails AND NOT gone) toxic_lost FROM flags GROUP BY ALL)
SELECT part, filter_order, step::INTEGER step, coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant, coalesce(unique_fails, 0)::BIGINT unique_fails,
  coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT shapley FROM counts""",
    "op13_centroids": _lloyd_sql(5),
}
