"""Registered queries: filters, counts, sampling, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PRETOKEN_PATTERN, md5_prefix, py_strip
from ..operators import filters as flt
from ..operators import sample as smp
from ..operators import stats as st
from ..operators.setops import concat_sources
from ..operators.windows import stage_sequence
from ..sources.catalog import LANGUAGE_CONFIGS, language_configs
from ..sources.tables import table
from .corpus import corpus, keep_for_training
from .registry import duck_strip, query

STRIPPED_LEN = f"length({duck_strip('text')})"

# --------------------------------------------------------------- filters ---


@query("f01_nonempty_text", "SELECT doc_id, source FROM documents WHERE length(text) > 0")
def f01(spark, sf):
    return table(spark, sf, "documents").filter(flt.nonempty("text")).select("doc_id", "source")


F02_SQL = f"""
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, {duck_strip('line')} AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM documents)
WHERE {duck_strip('line')} <> ''
"""


@query("f02_nonblank_lines", F02_SQL)
def f02(spark, sf):
    """S01 + X19 + F02 over the documents' lines: one record per non-blank line."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return (d.filter(flt.nonblank("line"))
            .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), py_strip("line").alias("line")))


@query("f03_min_stripped_length",
       f"SELECT doc_id, source, CAST({STRIPPED_LEN} AS BIGINT) AS n_chars FROM documents WHERE {STRIPPED_LEN} > 50")
def f03(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(flt.min_stripped_length("text", 50)).select(
        "doc_id", "source", F.length(py_strip("text")).cast("bigint").alias("n_chars"))


_LANG_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_CONFIGS.items())
F08_SQL = f"""
SELECT d.lang, c.config, count(*) AS n_docs
FROM documents d JOIN (VALUES {_LANG_VALUES}) AS c(lang, config) ON d.lang = c.lang
GROUP BY d.lang, c.config
"""


@query("f08_language_membership", F08_SQL)
def f08(spark, sf):
    """S09 + F08: documents whose language has a corpus config (broadcast join
    against the fixed 13-row language table)."""
    d = table(spark, sf, "documents")
    return (d.join(F.broadcast(language_configs(spark)), "lang")
            .groupBy("lang", "config").agg(F.count(F.lit(1)).alias("n_docs")))


F09_SQL = f"""
SELECT c.config, count(*) AS n_docs
FROM documents d JOIN (VALUES {_LANG_VALUES}) AS c(lang, config) ON d.lang = c.lang
WHERE lower(c.config) LIKE '%ko%' OR lower(c.config) LIKE '%en%'
GROUP BY c.config
"""


@query("f09_config_mentions", F09_SQL)
def f09(spark, sf):
    d = table(spark, sf, "documents")
    return (d.join(F.broadcast(language_configs(spark)), "lang")
            .filter(flt.config_mentions("config"))
            .groupBy("config").agg(F.count(F.lit(1)).alias("n_docs")))


# ------------------------------------------------------------ aggregates ---


@query("a01_rows_per_source",
       "SELECT source AS src, count(*) AS n_rows FROM documents GROUP BY ROLLUP (source)")
def a01(spark, sf):
    return st.rows_per_group(corpus(spark, sf), "src")


@query("a02_rows_per_language",
       "SELECT lang, count(*) AS n_rows FROM documents GROUP BY ROLLUP (lang)")
def a02(spark, sf):
    return st.rows_per_group(table(spark, sf, "documents"), "lang")


# DuckDB has no look-ahead, so the whitespace alternatives of the pattern are
# rebuilt from whitespace runs: a run followed by a non-space yields its
# body minus the last char, and the last char unless it is a plain space
# (which attaches to the next pre-token); a run at the end is one token.
# Unicode White_Space, spelled out for RE2 (whose \s is ASCII).
_WS = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NO_WS = (PRETOKEN_PATTERN.replace(r"|\s+(?!\S)|\s+", "").replace(r"[^\s", "[^" + _WS)
          .replace("'", "''"))
_PREFIXED = "CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END"
A03_SQL = f"""
WITH t AS (SELECT {_PREFIXED} AS t FROM documents),
w AS (
  SELECT unnest(regexp_extract_all(t, '{_NO_WS}')) AS word FROM t
  UNION ALL
  SELECT word FROM (
    SELECT CASE WHEN regexp_matches(run, '[{_WS}]$') THEN [run]
                ELSE list_filter([left(run, length(run) - 2),
                                  CASE WHEN substr(run, length(run) - 1, 1) <> ' '
                                       THEN substr(run, length(run) - 1, 1) END],
                                 lambda x: x IS NOT NULL AND x <> '') END AS toks
    FROM (SELECT unnest(regexp_extract_all(t, '[{_WS}]+(?:[^{_WS}]|$)')) AS run FROM t)
  ), unnest(toks) AS u(word)
)
SELECT word, count(*) AS cnt FROM w GROUP BY word
"""


@query("a03_word_counts", A03_SQL)
def a03(spark, sf):
    """X03 + A03: byte-level pre-tokens (with prefix space) counted over all documents."""
    return st.word_counts(table(spark, sf, "documents"))


A05_SQL = """
SELECT ch, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents)
GROUP BY ch
"""


@query("a05_char_counts", A05_SQL)
def a05(spark, sf):
    return st.char_counts(table(spark, sf, "documents"))


A06_SQL = """
WITH c AS (SELECT ch, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch),
r AS (SELECT ch, cnt, sum(cnt) OVER (ORDER BY cnt DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(cnt) OVER () AS total FROM c)
SELECT ch, cnt, round(cum / total, 6) AS cum_share FROM r WHERE (cum - cnt) / total < 0.9995
"""


@query("a06_character_coverage", A06_SQL)
def a06(spark, sf):
    return st.character_coverage(st.char_counts(table(spark, sf, "documents")), 0.9995)


@query("a07_min_frequency",
       "SELECT word, cnt FROM (" + A03_SQL + ") WHERE cnt >= 2")
def a07(spark, sf):
    return st.min_frequency(st.word_counts(table(spark, sf, "documents")), 2)


@query("l06_top_vocab",
       "SELECT word, cnt FROM (" + A03_SQL + ") ORDER BY cnt DESC, word LIMIT 1000")
def l06(spark, sf):
    """The vocabulary cap: 1,000 most frequent pre-tokens (ties by word)."""
    return smp.top_k(st.word_counts(table(spark, sf, "documents")), 1000, "cnt", "word")


A08_SQL = """
SELECT lang, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(strlen(text) + 2) AS BIGINT) AS total_tokens,
       CASE WHEN sum(strlen(text) + 2) > 0 THEN round(sum(length(text)) / sum(strlen(text) + 2), 6) ELSE 0.0 END AS chars_per_token
FROM documents GROUP BY ROLLUP (lang)
"""


@query("a08_fertility_bytes", A08_SQL)
def a08(spark, sf):
    """A08 with the byte vocabulary: tokens = UTF-8 bytes + <s> + </s>."""
    d = table(spark, sf, "documents")
    return st.fertility(d, "text", F.octet_length("text") + 2, by="lang")


A09_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(avg(length({c})), 6) AS mean_len, CAST(min(length({c})) AS BIGINT) AS min_len, "
    f"CAST(max(length({c})) AS BIGINT) AS max_len, round(median(length({c})), 6) AS median_len FROM documents"
    for c in ("text", "lang", "source"))


@query("a09_length_stats", A09_SQL)
def a09(spark, sf):
    """F10 + A09: length statistics of every string column (whole table)."""
    d = table(spark, sf, "documents")
    return st.length_stats(d, flt.string_columns(d))


A11_SQL = f"""
SELECT CAST(ceil(n / 8) AS BIGINT) AS batches_per_epoch, CAST(floor(ceil(n / 8) * 3 / 4) AS BIGINT) AS total_steps,
       CAST(32 AS BIGINT) AS effective_batch
FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND {STRIPPED_LEN} > 50)
"""


@query("a11_step_arithmetic", A11_SQL)
def a11(spark, sf):
    """Batch size 8, 3 epochs, accumulation 4, one device."""
    n = keep_for_training(corpus(spark, sf)).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*st.step_arithmetic(F.col("n"), 8, 3, 4, 1))


# ---------------------------------------------------------- sample/limit ---

L01_SQL = f"""
SELECT source AS src, doc_id AS row_idx FROM documents
WHERE text IS NOT NULL AND length(text) > 0 AND {STRIPPED_LEN} > 50
ORDER BY source, doc_id LIMIT 300
"""


@query("l01_max_samples", L01_SQL)
def l01(spark, sf):
    """``max_samples=300`` applied after the length filter, source order."""
    return smp.max_samples(keep_for_training(corpus(spark, sf)).select("src", "row_idx"), 300, ["src", "row_idx"])


@query("l03_row_range",
       "SELECT doc_id AS row_idx, source AS src FROM documents WHERE doc_id >= 100 AND doc_id < 600")
def l03(spark, sf):
    """Rows [100, 600) of the corpus (a range filter pushed to the scan)."""
    return smp.row_range(corpus(spark, sf), 100, 600).select("row_idx", "src")


W03_SQL = """
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents
  WHERE length(""" + duck_strip("text") + """) > 50) WHERE rn <= 100
"""


@query("w03_first_n_per_language", W03_SQL)
def w03(spark, sf):
    """W03 + U02: ``max_samples_per_lang=100`` over the length-filtered corpus."""
    d = table(spark, sf, "documents").filter(flt.min_stripped_length("text", 50))
    return smp.first_n_per_group(d.select("lang", "doc_id"), 100, "lang", "doc_id")


W05_SQL = """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 2
"""


@query("w05_last_turns", W05_SQL)
def w05(spark, sf):
    """The last two turns of every conversation (history trimming)."""
    return smp.last_n_per_group(table(spark, sf, "conversations").select("conv_id", "turn", "role"),
                                2, "conv_id", "turn")


W07_SQL = """
SELECT source AS name, CAST(row_number() OVER (ORDER BY idx) AS BIGINT) AS stage,
       lag(source) OVER (ORDER BY idx) AS prev_name
FROM (SELECT source, min(doc_id) AS idx FROM documents GROUP BY source)
"""


@query("w07_stage_sequence", W07_SQL)
def w07(spark, sf):
    """One stage per source, in order of first appearance."""
    src = (table(spark, sf, "documents").groupBy(F.col("source").alias("name"))
           .agg(F.min("doc_id").alias("idx")))
    return stage_sequence(src, "idx", "name").select("name", "stage", "prev_name")


L08_SQL = f"""
SELECT src, row_idx, CAST(idx // 8 AS BIGINT) AS batch_id FROM (
  SELECT source AS src, doc_id AS row_idx, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx,
         count(*) OVER () AS n
  FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND {STRIPPED_LEN} > 50)
WHERE idx // 8 < n // 8
"""


@query("l08_fixed_batches_drop_last", L08_SQL)
def l08(spark, sf):
    """Batches of 8 in source order, incomplete last batch dropped;
    the position comes from :func:`sequential_index` (no global window)."""
    d = keep_for_training(corpus(spark, sf)).select("src", "row_idx")
    idx = smp.sequential_index(d, ["src", "row_idx"])
    return smp.fixed_batches(idx, 8, drop_last=True).select("src", "row_idx", "batch_id")


# ----------------------------------------------------------- set ops -------

U01_SQL = f"""
SELECT src_idx, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT 0 AS src_idx, text FROM documents WHERE length(text) > 0
  UNION ALL SELECT 1, text FROM conversations WHERE length(text) > 0)
GROUP BY src_idx
"""


@query("u01_concat_sources", U01_SQL)
def u01(spark, sf):
    """Documents and conversation turns as one corpus (bag union)."""
    d = table(spark, sf, "documents").select("text").filter(flt.nonempty())
    c = table(spark, sf, "conversations").select("text").filter(flt.nonempty())
    u = concat_sources([d, c])
    return u.groupBy("src_idx").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.sum(F.length("text")).cast("bigint").alias("n_chars"))


# ------------------------------------------------------------ scalar fns ---

X17_SQL = """
SELECT source AS src, substr(md5(source || '_' || 'v1'), 1, 16) AS cache_key, count(*) AS n_rows
FROM documents GROUP BY source
"""


@query("x17_md5_cache_key", X17_SQL)
def x17(spark, sf):
    """X17 / S18 key: 16-hex md5 prefix of ``name_version`` per source."""
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "cache_key", md5_prefix(F.concat(F.col("src"), F.lit("_v1")), 16))


X20_SQL = """
SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n
FROM events GROUP BY event_type
"""


@query("x20_json_props", X20_SQL)
def x20(spark, sf):
    """Parse a JSON string per row and aggregate a field of it."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.groupBy("event_type").agg(F.sum(k).cast("bigint").alias("sum_k"), F.count(F.lit(1)).alias("n"))
