"""Corpus build plans: documents -> filter -> tokens -> packed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.tokens import add_specials, byte_ids
from ..operators.pack import concat_and_chunk
from ..sources.tables import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a text corpus: ``(src, row_idx, text)``.

    ``doc_id`` is the row order; ``source`` plays the reference's source
    index.  Only these three columns reach the scan (column pruning).
    """
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("src"), F.col("doc_id").alias("row_idx"), "text")


def keep_for_training(df: DataFrame, text: str = "text", min_chars: int = 50) -> DataFrame:
    """F01 + F06 + F03: non-null, non-empty, stripped length > ``min_chars``."""
    t = F.col(text)
    return df.filter(t.isNotNull() & (F.length(t) > 0) & (F.length(py_strip(t)) > min_chars))


def byte_chunks(spark: SparkSession, sf_dir: str, max_seq_length: int = 2048, segment_rows: int | None = None) -> DataFrame:
    """Flagship: byte-vocabulary tokens with ``<s> … </s>``, concatenated per
    source and cut into ``max_seq_length`` chunks (short tails dropped).

    A byte is a token, so offsets come from byte lengths; texts travel as
    texts and become ids where they are cut."""
    docs = keep_for_training(corpus(spark, sf_dir))
    return concat_and_chunk(docs, max_seq_length, ids=add_specials(byte_ids("text")), n=F.octet_length("text") + 2,
                            **({"segment_rows": segment_rows} if segment_rows else {}))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """One scalar row per chunk (what the oracle compares)."""
    ids = F.col("input_ids")
    return chunks.select(
        "src", "segment", "chunk_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.element_at(ids, 1).alias("first_id"),
        F.element_at(ids, -1).alias("last_id"))
