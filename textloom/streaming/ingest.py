"""Incremental corpus ingestion with Structured Streaming.

The reference pulls records lazily from iterators and emits fixed batches;
here a file source with ``maxFilesPerTrigger`` is the bounded pull, each
micro-batch is the batch, and checkpoints give exactly-once sinks.  All
queries use ``trigger(availableNow=True)`` so a run consumes what exists and
stops (re-running resumes from the checkpoint).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.filters import min_stripped_length


def stream_records(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                   max_files_per_trigger: int = 1, min_chars: int | None = 50, text: str = "text") -> DataFrame:
    """A streaming scan with back-pressure (files per trigger) and
    the length filter (F03) applied before anything else."""
    s = (spark.readStream.format(fmt).schema(schema)
         .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
    if min_chars is not None:
        s = s.filter(min_stripped_length(text, min_chars))
    return s


def stream_sources(spark: SparkSession, sources: dict[str, str], schema: str, fmt: str = "parquet",
                   max_files_per_trigger: int = 1, min_chars: int | None = 50, text: str = "text") -> DataFrame:
    """Several sources in one stream, each record with its source's name in ``src``."""
    out = None
    for name, path in sources.items():
        s = stream_records(spark, path, schema, fmt, max_files_per_trigger, min_chars, text).withColumn("src", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                  foreach_batch: Callable | None = None, query_name: str | None = None) -> None:
    """Run a streaming query over everything currently available, then stop."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if query_name:
        w = w.queryName(query_name)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).start(sink)
    q.awaitTermination()


def running_counts(stream: DataFrame, key: str = "lang") -> DataFrame:
    """Running count per key (complete/update output mode)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def _first_per_key(key: str, order: str, limit: int):
    """The first ``limit`` records of each key among a task's, in ``order``; holds at most twice that."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def best(p: pd.DataFrame) -> pd.DataFrame:
            return p.sort_values(order, kind="stable").groupby(key, dropna=False, sort=False).head(limit)

        for pdf in pdfs:
            held = best(pdf if held is None else pd.concat([held, best(pdf)]))
        if held is not None and len(held):
            yield held

    return run


def cap_per_key(stream: DataFrame, key: str, order: str, limit: int, schema: str) -> DataFrame:
    """Pass through at most ``limit`` records per key over the whole
    stream (state = records already emitted for the key); a micro-batch gives
    its first ones in ``order``.

    Every task keeps only its own first ``limit`` records of a key, so a key's
    group holds at most ``limit`` records for each task however hot it is.
    """
    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        emitted = state.get[0] if state.exists else 0
        rows = pd.concat(list(pdfs)) if emitted < limit else None
        if rows is not None:
            take = rows.sort_values(order, kind="stable").iloc[:limit - emitted]
            emitted += len(take)
            if len(take):
                yield take
        state.update((emitted,))

    first = stream.mapInPandas(_first_per_key(key, order, limit), stream.schema)
    return first.groupBy(key).applyInPandasWithState(
        fn, schema, "emitted long", "append", GroupStateTimeout.NoTimeout)


def pack_batches(pack: Callable[[DataFrame], DataFrame], sink: str) -> Callable:
    """``foreachBatch`` body: pack one micro-batch (its own segment) and
    append it as the shard ``batch_id=<id>``; idempotent per batch id."""
    def body(batch: DataFrame, batch_id: int) -> None:
        out = pack(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return body
