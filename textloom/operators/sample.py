"""Sort, limit, top-k, sampling and batching.

Limits appear only where the limit is the feature (max_samples, top-V,
first-N per language, last-N history).  Ordered limits compile to
TakeOrderedAndProject; per-key limits to a WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def max_samples(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in source order (after any filters)."""
    return df.orderBy(*order).limit(n)


def row_range(df: DataFrame, start: int, end: int, order: str = "row_idx") -> DataFrame:
    """Rows with ``start <= row_idx < end`` (a pushed-down range filter)."""
    return df.filter((F.col(order) >= start) & (F.col(order) < end))


def sample_k(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """Repeatable uniform sample of ``k`` rows without replacement."""
    return df.orderBy(_hash_key(key, seed), F.col(key)).limit(k)


def _hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def shuffle(df: DataFrame, key: str, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Full, repeatable shuffle: range-partition on a hash, sort inside."""
    d = df.withColumn("_h", _hash_key(key, seed))
    d = d.repartitionByRange(partitions, "_h") if partitions else d.repartitionByRange("_h")
    return d.sortWithinPartitions("_h", key).drop("_h")


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """``k`` largest by ``by`` (ties by ``tie`` ascending)."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def first_n_per_group(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """First ``n`` rows of each group in order (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_n_per_group(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """Last ``n`` rows of each group (e.g. chat history, training log)."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sequential_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based position of each row in a total order, without a global window.

    Distributed sort (range partitioning) -> per-partition counts (one row
    per partition reaches the driver-side join, bounded by the partition
    count) -> prefix sums -> local index.  The sorted, tagged table is
    checkpointed first so both uses see the same partitioning; it holds the
    order's columns only, and the rest of a wide row joins by them.  ``order``
    must be unique.
    """
    if set(df.columns) != set(order):
        on = [F.col(f"_o{i}").eqNullSafe(F.col(c)) for i, c in enumerate(order)]
        index = sequential_index(df.select(*order), order, name).select(
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], name)
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return df.join(index, cond).drop(*[f"_o{i}" for i in range(len(order))])
    tagged = cut_lineage(df.orderBy(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                         F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (tagged.join(F.broadcast(starts.select("_pid", "_start", "_first")), "_pid")
            .withColumn(name, (F.col("_start") + F.col("_mid") - F.col("_first")).cast("bigint"))
            .drop("_pid", "_mid", "_start", "_first"))


def fixed_batches(df: DataFrame, batch_size: int, idx: str = "idx", drop_last: bool = False) -> DataFrame:
    """``batch_id = idx div B``; optionally drop the incomplete last batch
    (a filter on the index, once the row count is known)."""
    out = df.withColumn("batch_id", F.floor(F.col(idx) / batch_size).cast("bigint"))
    if drop_last:
        n = df.agg(F.max(idx)).first()[0]
        out = out.filter(F.col("batch_id") < ((n + 1) // batch_size if n is not None else 0))
    return out


def length_grouped_batches(df: DataFrame, batch_size: int, length: Column, key: list[str],
                           mega_batch: int = 50, seed: int = 42) -> DataFrame:
    """Shuffled mega-batches of ``mega_batch * batch_size`` rows, sorted
    by length inside each, then cut into batches of similar length.  The
    columns ``key`` are unique; the order is that of an MD5 of seed and key."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    sh = sequential_index(df.withColumn("_h", h), ["_h", *key], "_sidx")
    mb = F.floor(F.col("_sidx") / (mega_batch * batch_size)).cast("bigint")
    w = Window.partitionBy("_mb").orderBy(F.col("_len").desc(), *key)
    return (sh.withColumn("_mb", mb).withColumn("_len", length)
            .withColumn("_r", F.row_number().over(w) - 1)
            .withColumn("batch_id", F.col("_mb") * mega_batch + F.floor(F.col("_r") / batch_size))
            .drop("_h", "_sidx", "_mb", "_len", "_r"))
