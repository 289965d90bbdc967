"""Registered queries: token-array functions, truncation, packing, collation
(byte vocabulary, so DuckDB can rebuild every id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import pack as pk
from ..operators import sample as smp
from ..sources.tables import table
from .corpus import corpus, keep_for_training
from .registry import duck_byte_ids, duck_strip, query

_TURN_IDS = f"[1] || {duck_byte_ids('text')} || [2]"


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tk.add_specials(tk.byte_ids("text")).alias("ids"))


def _asum(c):
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


X_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_TURN_IDS} AS ids FROM conversations),
u AS (SELECT conv_id, turn, ids, [1] || ids[2:len(ids) - 1][1:62] || [2] AS tr FROM t),
v AS (SELECT conv_id, turn, ids, tr, tr || list_transform(range(0, greatest(64 - len(tr), 0)), lambda i: 0) AS padded FROM u)
SELECT conv_id, turn,
       CAST(len(tr) AS BIGINT) AS n_trunc,
       CAST(list_sum(padded) AS BIGINT) AS padded_sum,
       CAST(len(list_filter(padded, lambda x: x = 0)) AS BIGINT) AS n_label_ignored,
       CAST(len(list_filter(tr, lambda x: x < 7)) AS BIGINT) AS n_special,
       CAST(len(ids) AS BIGINT) AS n_eos,
       CAST(list_sum(ids[1:len(ids) - 1]) AS BIGINT) AS input_sum,
       CAST(list_sum(ids[2:len(ids)]) AS BIGINT) AS label_sum
FROM v
"""


@query("x08_x14_token_arrays", X_SQL)
def x08_x14(spark, sf):
    """X08 template, X09 truncation to 64 (specials included), X10 right
    padding, X11 mask, X12 labels (pads -> -100), X13 special mask, X14
    EOS append (a no-op after X08), W06 next-token shift."""
    t = _turns(spark, sf)
    inner = F.slice("ids", 2, F.size("ids") - 2)
    tr = tk.truncate_with_specials(inner, 64)
    padded = tk.pad_right(tr, 64)
    return t.select(
        "conv_id", "turn",
        F.size(tr).cast("bigint").alias("n_trunc"),
        _asum(padded).alias("padded_sum"),
        F.size(F.filter(tk.labels_from_ids(padded), lambda x: x == -100)).cast("bigint").alias("n_label_ignored"),
        _asum(tk.special_tokens_mask(tr)).alias("n_special"),
        F.size(tk.append_eos_if_missing("ids")).cast("bigint").alias("n_eos"),
        _asum(tk.shift_inputs("ids")).alias("input_sum"),
        _asum(tk.shift_labels("ids")).alias("label_sum"))


@query("x11_attention_mask", f"""
WITH t AS (SELECT conv_id, turn, {_TURN_IDS} AS ids FROM conversations)
SELECT conv_id, turn, CAST(least(len(ids), 128) AS BIGINT) AS mask_ones, CAST(128 AS BIGINT) AS mask_len FROM t""")
def x11(spark, sf):
    t = _turns(spark, sf)
    m = tk.attention_mask(F.least(F.size("ids"), F.lit(128)), 128)
    return t.select("conv_id", "turn", _asum(m).alias("mask_ones"), F.size(m).cast("bigint").alias("mask_len"))


K06_SQL = f"""
WITH d AS (SELECT doc_id, {duck_byte_ids('text')} AS b FROM documents
           WHERE text IS NOT NULL AND length(text) > 0 AND length({duck_strip('text')}) > 50)
SELECT doc_id, CAST(len(b[1:510]) + 2 AS BIGINT) AS n_tokens, CAST(1 + list_sum(b[1:510]) + 2 AS BIGINT) AS id_sum FROM d
"""


@query("k06_tokenize_truncate", K06_SQL)
def k06(spark, sf):
    """Whole-document tokenisation in truncation mode (max 512 with specials)."""
    d = keep_for_training(corpus(spark, sf))
    ids = tk.truncate_with_specials(tk.byte_ids("text", limit=510), 512)
    return d.select(F.col("row_idx").alias("doc_id"), F.size(ids).cast("bigint").alias("n_tokens"),
                    _asum(ids).alias("id_sum"))


def k02_sql(segment_rows: int) -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT source AS src, doc_id AS row_idx, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {segment_rows} AS segment,
         strlen(text) + 2 AS n, [1] || {duck_byte_ids('text')} || [2] AS ids
  FROM documents
), d AS (SELECT *, row_number() OVER (PARTITION BY src, segment ORDER BY row_idx) AS rn FROM e
), r AS (
  SELECT src, segment, rn, row_idx, CAST(0 AS BIGINT) AS pack_id, least(n, 2048) AS cur, least(n, 2048) AS take
  FROM d WHERE rn = 1
  UNION ALL
  SELECT d.src, d.segment, d.rn, d.row_idx,
         CASE WHEN r.cur + d.n <= 2048 THEN r.pack_id WHEN r.cur > 0 THEN r.pack_id + 1 ELSE r.pack_id END,
         CASE WHEN r.cur + d.n <= 2048 THEN r.cur + d.n ELSE least(d.n, 2048) END,
         CASE WHEN r.cur + d.n <= 2048 THEN d.n ELSE least(d.n, 2048) END
  FROM r JOIN d ON d.src = r.src AND d.segment = r.segment AND d.rn = r.rn + 1
)
SELECT r.src, CAST(r.segment AS BIGINT) AS segment, r.pack_id, CAST(sum(r.take) AS BIGINT) AS n_tokens,
       CAST(sum(list_sum(d.ids[1:r.take])) AS BIGINT) AS id_sum, CAST(count(*) AS BIGINT) AS n_docs
FROM r JOIN d ON d.src = r.src AND d.row_idx = r.row_idx
WHERE r.take > 0
GROUP BY r.src, r.segment, r.pack_id
"""


def _next_fit(spark, sf, segment_rows: int):
    p = pk.next_fit_pack(corpus(spark, sf), 2048, ids=tk.add_specials(tk.byte_ids("text")),
                         n=F.octet_length("text") + 2, segment_rows=segment_rows)
    return p.select("src", "segment", "pack_id", "n_tokens", _asum("input_ids").alias("id_sum"), "n_docs")


@query("k02_next_fit_pack", k02_sql(50_000))
def k02(spark, sf):
    """Greedy next-fit packing of byte-tokenised documents into 2048
    tokens per 50,000-row segment, padded with 0."""
    return _next_fit(spark, sf, 50_000)


@query("k02_next_fit_segments", k02_sql(20))
def k02_segments(spark, sf):
    """K02 in segments of 20 positions of a source."""
    return _next_fit(spark, sf, 20)


K05_SQL = f"""
WITH t AS (SELECT conv_id, turn, len({_TURN_IDS}) AS n,
                  (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id FROM conversations)
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id, CAST(max(n) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_len,
       CAST(max(n) OVER (PARTITION BY batch_id) - n AS BIGINT) AS n_ignored FROM t
"""


@query("k05_collate_batches", K05_SQL)
def k05(spark, sf):
    """L08 + K05: batches of 8 turns in order, padded to the batch maximum,
    pads labelled -100."""
    t = smp.sequential_index(_turns(spark, sf), ["conv_id", "turn"])
    b = smp.fixed_batches(t, 8).withColumnRenamed("ids", "input_ids")
    c = pk.collate(b)
    return c.select("conv_id", "turn", "batch_id", F.size("input_ids").cast("bigint").alias("padded_len"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_ignored"))


A15_SQL = """
WITH c AS (""" + __import__("textloom.plans.queries_core", fromlist=["K01_SQL"]).K01_SQL + """)
SELECT CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_packs, CAST(count(*) * 2048 AS BIGINT) AS capacity,
       round(sum(n_tokens) / (count(*) * 2048), 6) AS efficiency FROM c
"""


@query("a15_packing_efficiency", A15_SQL)
def a15(spark, sf):
    """A15 over the flagship's chunks: tokens, packs, capacity, efficiency."""
    from .corpus import byte_chunks
    ch = byte_chunks(spark, sf, 2048).withColumn("n_tokens", F.size("input_ids"))
    return pk.packing_metrics(ch, 2048, n_sequences=F.lit(0)).drop("n_sequences")


@query("a15_balanced_metrics", f"""
SELECT count(*) AS n_sequences, CAST(sum(least(strlen(text) + 2, 512)) AS BIGINT) AS n_tokens FROM documents
WHERE text IS NOT NULL AND length(text) > 0 AND length({duck_strip('text')}) > 50""")
def a15_balanced(spark, sf):
    """A15's sequence and token counts over the balanced packs."""
    p = pk.balanced_pack(keep_for_training(corpus(spark, sf)), 512, ids=tk.add_specials(tk.byte_ids("text")),
                         n=F.octet_length("text") + 2)
    return pk.packing_metrics(p, 512).select("n_sequences", "n_tokens")


@query("k03_balanced_totals", f"""
SELECT source AS src, CAST(0 AS BIGINT) AS segment, CAST(sum(least(strlen(text) + 2, 512)) AS BIGINT) AS n_tokens,
       count(*) AS n_sequences FROM documents
WHERE text IS NOT NULL AND length(text) > 0 AND length({duck_strip('text')}) > 50 GROUP BY source""")
def k03_totals(spark, sf):
    """K03 packs every sequence once: tokens and sequences of each segment."""
    return k03(spark, sf).groupBy("src", "segment").agg(
        F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.sum("n_sequences").cast("bigint").alias("n_sequences"))


@query("k03_balanced_pack")
def k03(spark, sf):
    """K03 + A15: best-fit-decreasing packing of byte-tokenised documents
    (512 tokens per pack), with per-pack lengths and padding."""
    p = pk.balanced_pack(keep_for_training(corpus(spark, sf)), 512, ids=tk.add_specials(tk.byte_ids("text")),
                         n=F.octet_length("text") + 2)
    return p.select("src", "segment", "pack_id", "n_tokens", "padding", F.size("sequence_lengths").alias("n_sequences"))
