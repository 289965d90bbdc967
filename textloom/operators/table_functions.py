"""SQL table functions for one-to-many rows (D06): lines, chunks and scoring windows.

Each is one generator over an expression of its arguments, so Catalyst inlines
a lateral call into the scan's own stage: no join, no shuffle, no Python.

    SELECT d.doc_id, l.* FROM documents d, LATERAL text_lines(d.text) l
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    # null gives no line, an empty text one empty line
    "text_lines(t STRING) RETURNS TABLE (line_no BIGINT, line STRING)":
        r"transform(split(t, '\n'), (x, i) -> named_struct('line_no', cast(i AS BIGINT), 'line', x))",
    # pieces of size code points, the last one may be shorter; null and empty texts give none (one pass over a text)
    "text_chunks(t STRING, size INT) RETURNS TABLE (chunk_no BIGINT, chunk STRING)":
        "transform(regexp_extract_all(t, concat('(?s).{1,', size, '}'), 0), "
        "(x, i) -> named_struct('chunk_no', cast(i AS BIGINT), 'chunk', x))",
    # windows of strided scoring: tokens start to stop are read, the last n_target of them are scored
    "score_windows(n BIGINT, max_length BIGINT, stride BIGINT) RETURNS TABLE (start BIGINT, stop BIGINT, n_target BIGINT)":
        "transform(if(n > 0, sequence(0L, n - 1, stride), cast(array() AS ARRAY<BIGINT>)), "
        "i -> named_struct('start', greatest(i + stride - max_length, 0L), 'stop', least(i + stride, n), "
        "'n_target', least(i + stride, n) - i))",
}


def register_table_functions(spark: SparkSession) -> None:
    """Make ``text_lines``, ``text_chunks`` and ``score_windows`` callable from this session's SQL."""
    for head, rows in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN SELECT * FROM inline({rows})")
