"""Deterministic random token table (n × L ids below V, labels = ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_tokens(spark: SparkSession, n: int, length: int, vocab_size: int, seed: int = 42,
                  partitions: int | None = None) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                      lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(vocab_size)).cast("int"))
    df = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(n)
    return df.select(F.col("id").alias("row_idx"), ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))
