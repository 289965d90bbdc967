"""Packing and batching.

All packers keep the reference's per-segment semantics: the rows that reach
the packer are cut, source by source, into segments of consecutive positions
(500,000 for concat-and-chunk, 50,000 for next-fit) and every segment is
packed independently.  Positions and running token offsets come from prefix
sums over the narrow ``(src, row_idx, n)`` rows; only then do texts or token
arrays join, and they are shuffled by row and by chunk, never by source or
segment, so a source with a third of the rows is spread like any other.
Token arrays are never exploded to one row per token.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import (EOS_ID, MIN_CHUNK_LENGTH, PAD_ID, append_eos_if_missing,
                                attention_mask, labels_from_ids, pad_right)
from ..session import cut_lineage

CHUNK_SEGMENT_ROWS = 500_000
NEXTFIT_SEGMENT_ROWS = 50_000
ROWS_PER_RANGE = 100_000


def token_offsets(lengths: DataFrame, segment_rows: int | None = CHUNK_SEGMENT_ROWS,
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """W01 + W02: ``(src, row_idx, n)`` -> ``segment`` (position in the source
    div ``segment_rows``) and ``off`` (tokens before the row in its segment).

    Two levels of prefix sums: inside ranges of ``rows_per_range`` ids of a
    source, and over the ranges (a row each).  No window holds a whole source.
    ``lengths`` is read more than once and should be a cut (checkpointed) table.
    """
    before = Window.partitionBy("src", "_range").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    d = lengths.select("src", "row_idx", "n", F.floor(F.col("row_idx") / rows_per_range).alias("_range"))
    ranges = d.groupBy("src", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_sum"))
    over = Window.partitionBy("src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("src").alias("_s"), F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_rows").over(over), F.lit(0)).alias("_pos0"),
                           F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_run0"))
    d = (d.withColumn("_pos", F.count(F.lit(1)).over(before))
         .withColumn("_run", F.coalesce(F.sum("n").over(before), F.lit(0)))
         .join(starts, F.col("src").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))))
    seg = F.floor((F.col("_pos0") + F.col("_pos")) / segment_rows) if segment_rows else F.lit(0)
    d = d.select("src", "row_idx", "n", seg.cast("bigint").alias("segment"),
                 (F.col("_run0") + F.col("_run")).alias("_run"))
    if not segment_rows:
        return d.withColumnRenamed("_run", "off")
    first = d.groupBy(F.col("src").alias("_s"), F.col("segment").alias("_g")).agg(F.min("_run").alias("_first"))
    return (d.join(first, F.col("src").eqNullSafe(F.col("_s")) & (F.col("segment") == F.col("_g")))
            .select("src", "row_idx", "n", "segment", (F.col("_run") - F.col("_first")).cast("bigint").alias("off")))


def _lengths(df: DataFrame, src: str, order: str, n: Column) -> DataFrame:
    return cut_lineage(df.select(F.col(src).alias("src"), F.col(order).alias("row_idx"), n.cast("bigint").alias("n"))
                       .filter(F.col("n") > 0))


def _joined(df: DataFrame, plan: DataFrame, src: str, order: str) -> DataFrame:
    """The rows with their plan; both sides grow with the data, so they meet by row."""
    p = plan.withColumnRenamed("src", "_src").withColumnRenamed("row_idx", "_row")
    return df.join(p, F.col(src).eqNullSafe(F.col("_src")) & (F.col(order) == F.col("_row"))).drop("_src", "_row")


def concat_and_chunk(df: DataFrame, max_seq_length: int = 2048, ids: str | Column = "input_ids",
                     src: str = "src", order: str = "row_idx", eos_id: int = EOS_ID,
                     segment_rows: int | None = CHUNK_SEGMENT_ROWS,
                     min_chunk_length: int = MIN_CHUNK_LENGTH, n: Column | None = None) -> DataFrame:
    """Drop empty sequences (F05), append EOS where missing (X14),
    concatenate in ``order`` per (src, segment), cut every ``max_seq_length``
    tokens and drop chunks shorter than ``min_chunk_length`` (F04).

    ``ids`` may be an expression over the rows of ``df``; with ``n``, its length
    after X14, offsets need no tokens, and rows travel as what they are (texts,
    say) until they are cut.  Chunk groups hold at most ``max_seq_length``
    tokens.  Output: ``src, segment, chunk_id, input_ids, attention_mask``.
    """
    L = int(max_seq_length)
    seq = append_eos_if_missing(F.col(ids) if isinstance(ids, str) else ids, eos_id)
    plan = token_offsets(_lengths(df, src, order, F.size(seq) if n is None else n), segment_rows)
    c = F.col("c")
    start = F.greatest(c * L, F.col("off"))
    end = F.least((c + 1) * L, F.col("off") + F.col("n"))
    rows = _joined(df.drop(*({"n", "off", "segment"} & set(df.columns))), plan, src, order)
    pieces = (rows.select(F.col(src).alias("src"), "segment", "off", "n", seq.alias("ids"))
              .withColumn("c", F.explode(F.sequence(F.floor(F.col("off") / L),
                                                     F.floor((F.col("off") + F.col("n") - 1) / L))))
              .select(F.col("src").alias(src), "segment", F.col("c").alias("chunk_id"),
                      F.struct(start.alias("pos"),
                               F.slice("ids", (start - F.col("off") + 1).cast("int"),
                                       (end - start).cast("int")).alias("piece")).alias("p")))
    chunks = (pieces.groupBy(src, "segment", "chunk_id")
              .agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")),
                                         lambda x: x["piece"])).alias("input_ids")))
    return (chunks.filter(F.size("input_ids") >= min_chunk_length)
            .withColumn("attention_mask", attention_mask(F.size("input_ids"))))


# ---------------------------------------------------------------------------
# Greedy next-fit packing (sequential inside each 50,000-row segment)
# ---------------------------------------------------------------------------

def _next_fit_assign(L: int):
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", kind="stable")
        n = pdf["n"].to_numpy()
        pack = np.empty(len(n), dtype=np.int64)
        take = np.empty(len(n), dtype=np.int64)
        cur, p = 0, 0
        for i, k in enumerate(n):
            if cur + k <= L:
                pack[i], take[i] = p, k
                cur += k
            else:
                if cur > 0:
                    p += 1
                pack[i], take[i] = p, min(k, L)
                cur = take[i]
        return pd.DataFrame({"src": pdf["src"].to_numpy(), "segment": pdf["segment"].to_numpy(),
                             "row_idx": pdf["row_idx"].to_numpy(), "pack_id": pack, "take": take})
    return assign


def _packed_rows(df: DataFrame, assign, src: str, order: str, ids: str | Column, n: Column | None,
                 segment_rows: int | None) -> DataFrame:
    """Rows with ``segment``, ``pack_id`` and their kept tokens, by a sequential
    rule over the narrow rows of each segment (at most ``segment_rows``)."""
    seq = F.col(ids) if isinstance(ids, str) else ids
    narrow = token_offsets(_lengths(df, src, order, F.size(seq) if n is None else n), segment_rows)
    plan = narrow.select("src", "segment", "row_idx", "n").groupBy("src", "segment").applyInPandas(
        assign, "src string, segment long, row_idx long, pack_id long, take long")
    rows = _joined(df.drop(*({"segment", "pack_id", "take"} & set(df.columns))), plan, src, order)
    return rows.filter(F.col("take") > 0).select(
        F.col(src).alias("src"), "segment", "pack_id",
        F.struct(F.col(order).alias("row_idx"), F.slice(seq, 1, F.col("take").cast("int")).alias("piece")).alias("p"))


def next_fit_pack(df: DataFrame, max_seq_length: int = 2048, ids: str | Column = "input_ids",
                  src: str = "src", order: str = "row_idx",
                  segment_rows: int | None = NEXTFIT_SEGMENT_ROWS, pad_id: int = PAD_ID,
                  n: Column | None = None) -> DataFrame:
    """Append whole sequences while they fit, else pad and start a new
    pack; over-long sequences are truncated to ``max_seq_length``.

    ``ids`` and ``n`` as in ``concat_and_chunk``.  Output: ``src, segment,
    pack_id, input_ids`` (padded to the length), ``n_tokens`` (before padding)
    and ``n_docs``.
    """
    L = int(max_seq_length)
    pieces = _packed_rows(df, _next_fit_assign(L), src, order, ids, n, segment_rows)
    packs = (pieces.groupBy("src", "segment", "pack_id")
             .agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"])).alias("ids"),
                  F.count(F.lit(1)).alias("n_docs")))
    out = packs.select("src", "segment", "pack_id", pad_right("ids", L, pad_id).alias("input_ids"),
                       F.size("ids").cast("bigint").alias("n_tokens"), "n_docs")
    if src != "src":
        out = out.withColumnRenamed("src", src)
    return out


# ---------------------------------------------------------------------------
# Balanced packing (best-fit decreasing inside each segment)
# ---------------------------------------------------------------------------

def _best_fit_assign(L: int):
    import bisect

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "row_idx"], ascending=[False, True], kind="stable")
        rem: list[tuple[int, int]] = []      # sorted (remaining capacity, pack id)
        packs = np.empty(len(pdf), dtype=np.int64)
        takes = np.empty(len(pdf), dtype=np.int64)
        next_id = 0
        for i, k in enumerate(pdf["n"].to_numpy()):
            k = int(min(k, L))
            j = bisect.bisect_left(rem, (k, -1))
            if j < len(rem):
                cap, pid = rem.pop(j)
                bisect.insort(rem, (cap - k, pid))
            else:
                pid = next_id
                next_id += 1
                bisect.insort(rem, (L - k, pid))
            packs[i], takes[i] = pid, k
        return pd.DataFrame({"src": pdf["src"].to_numpy(), "segment": pdf["segment"].to_numpy(),
                             "row_idx": pdf["row_idx"].to_numpy(), "pack_id": packs, "take": takes})
    return assign


def balanced_pack(df: DataFrame, max_seq_length: int = 2048, ids: str | Column = "input_ids",
                  src: str = "src", order: str = "row_idx",
                  segment_rows: int | None = NEXTFIT_SEGMENT_ROWS, pad_id: int = PAD_ID,
                  n: Column | None = None) -> DataFrame:
    """K03 (our definition of the documented balanced packer): whole
    sequences, longest first, each into the fullest pack that still has
    room (best-fit decreasing); over-long sequences are truncated.

    Output: ``src, segment, pack_id, input_ids, sequence_lengths, n_tokens,
    padding`` with ``input_ids`` padded to ``max_seq_length``.
    """
    L = int(max_seq_length)
    pieces = _packed_rows(df, _best_fit_assign(L), src, order, ids, n, segment_rows)
    packs = (pieces.groupBy("src", "segment", "pack_id")
             .agg(F.array_sort(F.collect_list("p")).alias("ps")))
    flat = F.flatten(F.transform("ps", lambda x: x["piece"]))
    return (packs.select("src", "segment", "pack_id",
                         pad_right(flat, L, pad_id).alias("input_ids"),
                         F.transform("ps", lambda x: F.size(x["piece"])).alias("sequence_lengths"))
            .withColumn("n_tokens", F.aggregate("sequence_lengths", F.lit(0), lambda a, x: a + x))
            .withColumn("padding", F.lit(L) - F.col("n_tokens")))


def packing_metrics(packs: DataFrame, max_seq_length: int, n_tokens: str = "n_tokens",
                    n_sequences: Column | None = None) -> DataFrame:
    """Sequences, tokens, packs, capacity and efficiency of a packing."""
    nseq = n_sequences if n_sequences is not None else F.size("sequence_lengths")
    return packs.agg(
        F.sum(nseq).cast("bigint").alias("n_sequences"),
        F.sum(n_tokens).cast("bigint").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_packs"),
        (F.count(F.lit(1)) * max_seq_length).cast("bigint").alias("capacity"),
        F.round(F.sum(n_tokens) / (F.count(F.lit(1)) * max_seq_length), 6).alias("efficiency"))


# ---------------------------------------------------------------------------
# Batches and collation
# ---------------------------------------------------------------------------

def collate(df: DataFrame, batch_col: str = "batch_id", ids: str = "input_ids",
            pad_id: int = PAD_ID) -> DataFrame:
    """Pad every sequence to the longest in its batch; mask and labels
    (pads -> -100).  The batch maximum is a window over the batch key."""
    w = Window.partitionBy(batch_col)
    out = df.withColumn("_n", F.size(ids)).withColumn("_L", F.max("_n").over(w))
    return (out.withColumn("labels", labels_from_ids(pad_right(ids, F.col("_L"), pad_id), pad_id))
            .withColumn("attention_mask", attention_mask(F.col("_n"), F.col("_L")))
            .withColumn(ids, pad_right(ids, F.col("_L"), pad_id))
            .drop("_n", "_L"))
