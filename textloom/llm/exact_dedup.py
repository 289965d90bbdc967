"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Misra-Gries counters over the digests find every digest that more than the
support's share of the rows has (and maybe others).  Their exact counts and
winners are verified in a second pass; that table is bounded by the support
and is broadcast, so the rows of heavy groups are judged map-side and none is
shuffled.  The remaining digests, none of them heavy, go through an ordinary
shuffle.

Defined cases: a null text is empty; null doc_ids are smaller than all others;
of rows with the winner's doc_id and text (repeated rows) exactly one stays;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows (checkpointed): doc_id, digest (SHA-256, binary) and a row number without meaning."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
                                   F.monotonically_increasing_id().alias("uid")))


def heavy_digests(rows: DataFrame, support: float) -> DataFrame:
    """Candidates of Misra-Gries: all digests above ``support`` of the rows, at most 1 / support of them."""
    return rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("tl_digest"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row for each input row: doc_id, digest, keep_id, group_size, kept.

    Of equal texts the row with the largest doc_id stays.
    """
    rows = digests(docs, id_col, text_col)
    best = F.max(F.struct("doc_id", "uid"))
    candidates = heavy_digests(rows, support)
    least = rows.count() * support
    heavy = cut_lineage(
        rows.join(F.broadcast(candidates), F.col("digest") == F.col("tl_digest"), "left_semi")
        .groupBy(F.col("digest").alias("tl_digest")).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least))
    known = rows.join(F.broadcast(heavy), F.col("digest") == F.col("tl_digest")).drop("tl_digest")
    w = Window.partitionBy("digest")
    rest = (rows.join(F.broadcast(heavy.select("tl_digest")), F.col("digest") == F.col("tl_digest"), "left_anti")
            .withColumn("best", best.over(w)).withColumn("group_size", F.count(F.lit(1)).over(w)))
    return known.select(*rest.columns).unionByName(rest).select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The documents without exact copies; columns as they were."""
    kept = judge(docs, id_col, text_col, support).where("kept").select(
        F.col("doc_id").alias("tl_id"), F.col("digest").alias("tl_digest"))
    own = F.unhex(F.sha2(F.encode(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), "UTF-8"), 256))
    return (docs.withColumn("tl_d", own)
            .join(kept, (F.col("tl_d") == F.col("tl_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("tl_id")))
            .dropDuplicates(["tl_digest"]).select(*docs.columns))
