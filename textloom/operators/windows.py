"""Order-dependent computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_of(order: str, rows: int):
    """Segment id = ``row_idx div rows``."""
    return F.floor(F.col(order) / rows).cast("bigint")


def assign_new_ids(new_tokens: DataFrame, base_max_id: int, order: str, budget: int | None = None,
                   token: str = "token") -> DataFrame:
    """Ids ``max+1, max+2, …`` in ``order``, at most ``budget`` of them.

    The candidate table is a vocabulary (bounded by the requested vocabulary
    size), so a single ordered window over it is small.
    """
    w = Window.orderBy(order)
    out = new_tokens.withColumn("_rn", F.row_number().over(w))
    if budget is not None:
        out = out.filter(F.col("_rn") <= budget)
    return out.select(token, (F.lit(base_max_id) + F.col("_rn")).cast("int").alias("id"))


def stage_sequence(sources: DataFrame, idx: str = "idx", name: str = "name") -> DataFrame:
    """Stages in source-list order; each names its predecessor."""
    w = Window.orderBy(idx)
    return (sources.withColumn("stage", F.row_number().over(w).cast("bigint"))
            .withColumn("prev_name", F.lag(name).over(w)))
