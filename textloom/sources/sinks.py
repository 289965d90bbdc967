"""Sinks and stage bookkeeping."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import md5_prefix


def shard_count(n_rows: int, cpu_count: int) -> int:
    """S11 rule: base = max(8, cpu//2); >5M rows -> min(64, 2·base);
    >1M -> min(48, base); else min(32, base)."""
    base = max(8, cpu_count // 2)
    if n_rows > 5_000_000:
        return min(64, base * 2)
    if n_rows > 1_000_000:
        return min(48, base)
    return min(32, base)


def write_shards(df: DataFrame, path: str, n_shards: int | None = None,
                 mode: str = "overwrite", max_records_per_file: int | None = None) -> int:
    """Sharded Parquet write; Spark's ``_SUCCESS`` is the completion marker.

    By default the rows are dealt out by size (adaptive execution rebalances
    them to its advisory partition size) and files are cut at
    ``max_records_per_file``.  ``n_shards`` asks for a number of shards, which
    ``shard_count`` picks by the count-based rule.  Returns the files' number."""
    w = (df.repartition(n_shards) if n_shards else df.hint("rebalance")).write.mode(mode)
    w.option("maxRecordsPerFile", max_records_per_file or 1_000_000).parquet(path)
    return len(df.sparkSession.read.parquet(path).inputFiles())


def write_metadata(spark: SparkSession, path: str, **fields) -> DataFrame:
    """One-row metadata table written as JSON beside the data."""
    row = spark.createDataFrame([tuple(str(v) for v in fields.values())],
                                ", ".join(f"{k} string" for k in fields))
    row.coalesce(1).write.mode("overwrite").json(path)
    return row


def write_results(df: DataFrame, path: str) -> None:
    """``{prompt, response}`` (or any rows) as JSON Lines."""
    df.write.mode("overwrite").json(path)


def cache_version_key(vocab_size: int, tokenizer_type: str, n_special: int, extra: str = "") -> str:
    """S18 version string; hashed to 8 hex digits with :func:`cache_key`."""
    return f"vocab_{vocab_size}_type_{tokenizer_type}_tokens_{n_special}_{extra}"


def cache_path(root: str, name: str, version: str) -> str:
    """``root/<md5(name + '_' + md5(version)[:8])[:16]>``."""
    import hashlib
    v = hashlib.md5(version.encode()).hexdigest()[:8]
    k = hashlib.md5(f"{name}_{v}".encode()).hexdigest()[:16]
    return os.path.join(root, k)


def cache_keys(df: DataFrame, name: str = "name", version: str = "version"):
    """S18 as a column expression (for a table of stages)."""
    v = md5_prefix(F.col(version), 8)
    return md5_prefix(F.concat(F.col(name), F.lit("_"), v), 16)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Data and completion marker both present."""
    _, p, fs = _hadoop(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(p)


def _chosen(spark: SparkSession, path: str) -> str | None:
    """The attempt that was committed, if any."""
    jvm, p, fs = _hadoop(spark, os.path.join(path, "_COMMITTED"))
    if not fs.exists(p):
        return None
    into = fs.open(p)
    try:
        return os.path.join(path, jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8"))
    finally:
        into.close()


def _commit(spark: SparkSession, path: str, attempt: str) -> bool:
    """Make ``attempt`` the stage's result unless another one is: a rename that never overwrites."""
    from py4j.protocol import Py4JJavaError

    jvm, note, fs = _hadoop(spark, os.path.join(path, f".note-{attempt}"))
    out = fs.create(note, True)
    try:
        out.write(bytearray(attempt.encode()))
    finally:
        out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(kinds, 1)
    none[0] = kinds.valueOf("NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(note, jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_COMMITTED")), none)
        return True
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False


def cached_stage(spark: SparkSession, path: str, build) -> DataFrame:
    """Reuse a finished stage, else build it, write it and reload it.

    Every build writes a folder of its own under ``path``; the marker that
    names it is put in place last, by a rename that fails if there is one.  So
    an interrupted build is never read, and of several builds at once the first
    to finish is what all of them read.  The rename must be atomic (HDFS, local
    disks; not plain object stores).
    """
    if _chosen(spark, path) is None:
        attempt = f"attempt-{uuid.uuid4().hex}"
        build().write.parquet(os.path.join(path, attempt))
        _commit(spark, path, attempt)
    return spark.read.parquet(_chosen(spark, path))


def manifest(df: DataFrame, path: str, src: str = "src") -> DataFrame:
    """One row per source with its row count and storage path."""
    return df.groupBy(src).agg(F.count(F.lit(1)).alias("num_samples")).withColumn("cache_path", F.lit(path))


def write_tokenizer_json(vocab: DataFrame, merges: DataFrame, path: str, model_type: str = "BPE") -> None:
    """S16 export.  The artefact is bounded by the vocabulary size, so it is
    assembled as one JSON document."""
    v = {r["token"]: int(r["id"]) for r in vocab.collect()}
    m = [f"{r['l']} {r['r']}" for r in merges.orderBy("rank").collect()]
    text = json.dumps({"model": {"type": model_type, "vocab": v, "merges": m}}, ensure_ascii=False)
    spark = vocab.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
