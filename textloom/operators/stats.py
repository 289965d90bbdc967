"""Aggregations (A01-A16): all single-pass, partial+final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_level, chars, pretokens


def rows_per_group(df: DataFrame, key: str, label: str = "n_rows") -> DataFrame:
    """Count per key plus the grand total (key NULL) via ROLLUP."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias(label))


def word_counts(df: DataFrame, text: str = "text", add_prefix_space: bool = True) -> DataFrame:
    """Pre-token frequency over the corpus (map-side combine, one shuffle)."""
    return (df.select(F.explode(pretokens(text, add_prefix_space)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def symbolize(words: DataFrame, word: str = "word") -> DataFrame:
    """Byte-level symbols of each distinct word (X04): one printable char per byte."""
    return words.withColumn("symbols", chars(byte_level(word)))


def pair_counts(words: DataFrame, symbols: str = "symbols", cnt: str = "cnt") -> DataFrame:
    """Adjacent symbol-pair frequency weighted by word count."""
    s = F.col(symbols)
    pairs = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("l"),
                         F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("r"))
    return (words.filter(F.size(s) > 1)
            .select(F.explode(pairs).alias("p"), F.col(cnt))
            .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
            .agg(F.sum(cnt).cast("bigint").alias("cnt")))


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Character frequency (code points)."""
    return (df.select(F.explode(chars(text)).alias("ch"))
            .groupBy("ch").agg(F.count(F.lit(1)).alias("cnt")))


def limit_alphabet(counts: DataFrame, limit: int, keep: list[str] | None = None) -> DataFrame:
    """The ``limit`` most frequent characters, plus ``keep`` (always kept).

    The character table is bounded by the size of Unicode, so the ranking
    window over it is small whatever the corpus size.
    """
    w = Window.orderBy(F.col("cnt").desc(), F.col("ch"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    cond = F.col("rank") <= limit
    if keep:
        cond = cond | F.col("ch").isin(list(keep))
    return ranked.filter(cond)


def character_coverage(counts: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Smallest set of most frequent characters covering ``coverage``."""
    w = Window.orderBy(F.col("cnt").desc(), F.col("ch"))
    total = Window.partitionBy()
    c = (counts.withColumn("cum", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("total", F.sum("cnt").over(total))
         .withColumn("prev_share", (F.col("cum") - F.col("cnt")) / F.col("total")))
    return (c.filter(F.col("prev_share") < coverage)
            .select("ch", "cnt", F.round(F.col("cum") / F.col("total"), 6).alias("cum_share")))


def min_frequency(counts: DataFrame, k: int = 2, cnt: str = "cnt") -> DataFrame:
    """Keep entries seen at least ``k`` times."""
    return counts.filter(F.col(cnt) >= k)


def fertility(df: DataFrame, text: str, n_tokens: Column, by: str | None = None) -> DataFrame:
    """Total chars, total tokens, chars per token (0 if no tokens)."""
    aggs = [F.sum(F.length(text)).cast("bigint").alias("total_chars"),
            F.sum(n_tokens).cast("bigint").alias("total_tokens")]
    g = df.rollup(by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("chars_per_token",
                        F.when(F.col("total_tokens") > 0,
                               F.round(F.col("total_chars") / F.col("total_tokens"), 6))
                        .otherwise(F.lit(0.0)))


def length_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """mean/min/max/median of the character length of each column, in one scan."""
    one = []
    for c in cols:
        n = F.length(c)
        one.append(F.struct(F.lit(c).alias("field"), F.round(F.avg(n), 6).alias("mean_len"),
                            F.min(n).cast("bigint").alias("min_len"), F.max(n).cast("bigint").alias("max_len"),
                            F.round(F.median(n), 6).alias("median_len")))
    return df.agg(F.array(*one).alias("s")).select(F.inline("s"))


def step_arithmetic(n_rows: Column, batch_size: int, epochs: int, accum: int, n_gpus: int = 1) -> list[Column]:
    """Batches per epoch, optimizer steps, effective batch size."""
    batches = F.ceil(n_rows / F.lit(batch_size)).cast("bigint")
    return [batches.alias("batches_per_epoch"),
            F.floor(batches * epochs / accum).cast("bigint").alias("total_steps"),
            F.lit(batch_size * accum * n_gpus).cast("bigint").alias("effective_batch")]


def windowed_mean(df: DataFrame, step: str, value: str, k: int) -> DataFrame:
    """Mean of ``value`` per block of ``k`` consecutive steps."""
    return (df.groupBy(F.floor((F.col(step) - 1) / k).cast("bigint").alias("window"))
            .agg(F.round(F.avg(value), 6).alias("mean_loss"), F.count(F.lit(1)).alias("n_steps"),
                 F.max(step).cast("bigint").alias("last_step")))


def throughput(df: DataFrame, name: str = "throughput") -> DataFrame:
    """A10: rows processed, elapsed seconds, rows per second for one full
    run of ``df`` (counted with ``observe`` on the way, no second pass)."""
    import time

    from pyspark.sql import Observation
    obs = Observation(name)
    t = time.time()
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    el = max(time.time() - t, 1e-9)
    rows = obs.get["rows"]
    return df.sparkSession.createDataFrame([(int(rows), float(el), float(rows / el))],
                                           "rows long, elapsed_sec double, rows_per_sec double")


def profile(df: DataFrame, first_n_columns: int = 5) -> DataFrame:
    """Column names and types (first ``first_n_columns``), row count."""
    n = df.count()
    fields = df.schema.fields[:first_n_columns]
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in fields],
                                           "column string, type string, n_rows long")
