"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat_sources(frames: list[DataFrame], src_names: list[str] | None = None) -> DataFrame:
    """Bag union by column name, tagging each input's source index."""
    tagged = []
    for i, f in enumerate(frames):
        f = f.withColumn("src_idx", F.lit(i))
        if src_names is not None and "src" not in f.columns:
            f = f.withColumn("src", F.lit(src_names[i]))
        tagged.append(f)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def vocab_union(base: DataFrame, added: DataFrame) -> DataFrame:
    """Base vocabulary plus new entries; base ids win on conflicts."""
    new_only = added.join(base.select("token"), "token", "left_anti")
    return base.select("token", "id").unionByName(new_only.select("token", "id"))


def dedup_merges(merges: DataFrame) -> DataFrame:
    """One row per (l, r), keeping the lowest rank."""
    w = Window.partitionBy("l", "r").orderBy("rank")
    return merges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
