"""Columnar table scans."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` (or a directory of parquet files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_split(spark: SparkSession, root: str, name: str, config: str | None = None,
               split: str | None = "train") -> DataFrame:
    """``<root>/<name>[/<config>][/<split>]``; falls back to the whole
    dataset when the named split directory does not exist."""
    base = os.path.join(root, name, config) if config else os.path.join(root, name)
    if split:
        p = os.path.join(base, split)
        if _exists(spark, p):
            return spark.read.parquet(p)
    return spark.read.parquet(base)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
