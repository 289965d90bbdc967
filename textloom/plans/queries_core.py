"""Registered queries: corpus build, conversion, filters, counts, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.corpus import byte_chunks, chunk_summary
from .registry import duck_byte_ids, duck_strip, query

# ---------------------------------------------------------------------------
# flagship
# ---------------------------------------------------------------------------

def k01_sql(segment_rows: int) -> str:
    return f"""
WITH d AS (
  SELECT source AS src, doc_id AS row_idx, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {segment_rows} AS segment,
         [1] || {duck_byte_ids('text')} || [2] AS ids
  FROM documents
  WHERE text IS NOT NULL AND length(text) > 0 AND length({duck_strip('text')}) > 50
), o AS (
  SELECT src, row_idx, ids, len(ids) AS n, segment,
         CAST(coalesce(sum(len(ids)) OVER (PARTITION BY src, segment ORDER BY row_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d
), p AS (
  SELECT src, segment, off, n, ids, unnest(generate_series(off // 2048, (off + n - 1) // 2048)) AS c
  FROM o
), q AS (
  SELECT src, segment, c AS chunk_id, greatest(c * 2048, off) AS st,
         list_slice(ids, greatest(c * 2048, off) - off + 1, least((c + 1) * 2048, off + n) - off) AS piece
  FROM p
)
SELECT src, CAST(segment AS BIGINT) AS segment, CAST(chunk_id AS BIGINT) AS chunk_id,
       CAST(sum(len(piece)) AS BIGINT) AS n_tokens,
       CAST(sum(list_sum(piece)) AS BIGINT) AS id_sum,
       arg_min(piece[1], st) AS first_id, arg_max(piece[-1], st) AS last_id
FROM q GROUP BY src, segment, chunk_id
HAVING sum(len(piece)) >= 128
"""


K01_SQL = k01_sql(500_000)


@query("k01_byte_chunks_segments", k01_sql(20))
def k01_segments(spark, sf_dir):
    """W02 + K01: segments by position in the filtered source, here of 20 rows."""
    return chunk_summary(byte_chunks(spark, sf_dir, 2048, segment_rows=20))


@query("k01_byte_chunks", K01_SQL)
def k01_byte_chunks(spark, sf_dir):
    return chunk_summary(byte_chunks(spark, sf_dir, 2048))


# ---------------------------------------------------------------------------
# Record conversion over every shape of every conversation
# ---------------------------------------------------------------------------
from ..operators.convert import convert_batch, convert_to_text, detect_format, record_keys  # noqa: E402
from .records import conversation_records  # noqa: E402


def _nb(x):
    return f"nullif({duck_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '')"


def _pair_sql(a, b):
    return (f"CASE WHEN {_nb(b)} IS NULL THEN NULL WHEN {_nb(a)} IS NULL THEN {_nb(b)} "
            f"ELSE {_nb(a)} || chr(10) || chr(10) || {_nb(b)} END")


_JOIN_NB = ("nullif(array_to_string(list_filter(list_transform(texts, lambda x: " + _nb("x") +
            "), lambda x: x IS NOT NULL), chr(10) || chr(10)), '')")
_INST = duck_strip("u")
_OUT0 = duck_strip("coalesce(a, '')")
P01_SQL = f"""
WITH c AS (
  SELECT conv_id,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS u,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a,
         arg_min(text, turn) FILTER (WHERE role = 'system') AS s,
         list(text ORDER BY turn) AS texts
  FROM conversations GROUP BY conv_id
), r AS (
  SELECT conv_id, 'text' AS shape,
         CASE WHEN u IS NOT NULL AND length(u) > 0 THEN 'text' ELSE 'unknown' END AS fmt,
         CASE WHEN u IS NOT NULL AND length(u) > 0 THEN u END AS text FROM c
  UNION ALL SELECT conv_id, 'input_output', CASE WHEN a IS NULL THEN 'unknown' ELSE 'input_output' END,
         CASE WHEN a IS NOT NULL THEN {_pair_sql('s', 'a')} END FROM c
  UNION ALL SELECT conv_id, 'alpaca', CASE WHEN a IS NULL THEN 'unknown' ELSE 'input_output' END,
         CASE WHEN a IS NOT NULL THEN {_pair_sql('s', 'a')} END FROM c
  UNION ALL SELECT conv_id, 'instruction_output', CASE WHEN u IS NULL THEN 'unknown' ELSE 'instruction_output' END,
         CASE WHEN u IS NULL THEN NULL
              WHEN {_INST} = '' AND {_OUT0} = '' THEN NULL
              WHEN {_INST} = '' THEN {_OUT0}
              ELSE {_INST} || chr(10) || chr(10) || {_OUT0} END FROM c
  UNION ALL SELECT conv_id, 'messages', 'messages', {_JOIN_NB} FROM c
  UNION ALL SELECT conv_id, 'sharegpt', 'conversations', {_JOIN_NB} FROM c
  UNION ALL SELECT conv_id, 'reasoning', CASE WHEN u IS NULL THEN 'unknown' ELSE 'reasoning' END,
         CASE WHEN u IS NOT NULL THEN nullif(concat_ws(chr(10) || chr(10), {_nb('u')}, {_nb('s')}, {_nb('a')}), '') END FROM c
  UNION ALL SELECT conv_id, 'prompt_response', CASE WHEN a IS NULL OR u IS NULL THEN 'unknown' ELSE 'prompt_response' END,
         CASE WHEN a IS NOT NULL AND u IS NOT NULL THEN {_pair_sql('u', 'a')} END FROM c
  UNION ALL SELECT conv_id, 'question_answer', CASE WHEN a IS NULL OR u IS NULL THEN 'unknown' ELSE 'question_answer' END,
         CASE WHEN a IS NOT NULL AND u IS NOT NULL THEN {_pair_sql('u', 'a')} END FROM c
  UNION ALL SELECT conv_id, 'prompt_completion', CASE WHEN a IS NULL OR u IS NULL THEN 'unknown' ELSE 'prompt_completion' END,
         CASE WHEN a IS NOT NULL AND u IS NOT NULL THEN {_pair_sql('u', 'a')} END FROM c
  UNION ALL SELECT conv_id, 'unknown', 'unknown', NULL FROM c
)
SELECT conv_id, shape, fmt, text FROM r
"""


@query("p01_convert_records", P01_SQL)
def p01_convert_records(spark, sf_dir):
    r = conversation_records(spark, sf_dir)
    return r.select("conv_id", "shape", detect_format("rec").alias("fmt"), convert_to_text("rec").alias("text"))


@query("p11_unknown_shape_report")
def p11_unknown_shape_report(spark, sf_dir):
    """Key lists of records no branch recognises, with counts."""
    r = conversation_records(spark, sf_dir)
    return (r.filter(detect_format("rec") == "unknown")
            .groupBy(record_keys("json").alias("keys")).agg(F.count(F.lit(1)).alias("n_records")))


P13_SQL = f"""
SELECT conv_id, shape, text FROM ({P01_SQL}) WHERE coalesce(text, '') <> ''
"""


@query("p13_convert_batch_nonempty", P13_SQL)
def p13_convert_batch_nonempty(spark, sf_dir):
    """P13 + F06: project to text (NULL -> ''), drop unconvertible records."""
    r = conversation_records(spark, sf_dir)
    return convert_batch(r, keep=("conv_id", "shape")).filter(F.col("text") != "")
