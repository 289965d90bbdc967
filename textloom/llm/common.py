"""Small Spark helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

#: A word of the contracts: a run of anything but U+0020 and U+0009-U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in several places of ``body``.

    A higher-order function evaluates an expression that it captures for each
    element; binding it to a lambda variable first makes that one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, null and blank giving an empty array."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder and read it back.

    The folder is the one named by ``spark.checkpoint.dir``; the table survives
    lost executors and carries its size, so adaptive execution can judge it.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order_key: str, ties: list[str],
           rank: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``rank``: the place of a row, from 0, in its group by (order_key, ties).

    ``order_key`` is a lower-case hex digest, spread evenly.  A group of any
    size is cut into ranges of the digest's first 16 bits, about
    ``rows_per_bucket`` rows each, so no group has to fit in a task; a range's
    first rank is a prefix sum over the counts of the ranges.  That table has
    at most ``groups + rows / rows_per_bucket`` rows.  ``df`` is read twice and
    should be a written table.
    """
    prefix = F.conv(F.substring(order_key, 1, 4), 16, 10).cast("long")
    on = [F.col(g).eqNullSafe(F.col(f"tl_g_{g}")) for g in group]
    if group:
        ways = df.groupBy(*group).agg(F.count(F.lit(1)).alias("tl_n")).select(
            *[F.col(g).alias(f"tl_g_{g}") for g in group],
            F.least(F.lit(65536), F.ceil(F.col("tl_n") / rows_per_bucket)).cast("long").alias("tl_ways"))
        b = df.join(F.broadcast(ways), on).drop(*[f"tl_g_{g}" for g in group])
    else:
        b = df.withColumn("tl_ways", F.lit(min(65536, -(-df.count() // rows_per_bucket))).cast("long"))
    b = b.withColumn("tl_bucket", F.floor(prefix * F.col("tl_ways") / 65536).cast("int")).drop("tl_ways")
    first = (b.groupBy(*group, "tl_bucket").agg(F.count(F.lit(1)).alias("tl_n"))
             .withColumn("tl_first", F.sum("tl_n").over(
                 Window.partitionBy(*group).orderBy("tl_bucket").rowsBetween(Window.unboundedPreceding, -1)))
             .select(*[F.col(g).alias(f"tl_g_{g}") for g in group], F.col("tl_bucket").alias("tl_b"),
                     F.coalesce("tl_first", F.lit(0)).alias("tl_first")))
    within = F.row_number().over(Window.partitionBy(*group, "tl_bucket").orderBy(order_key, *ties))
    return (b.withColumn("tl_within", within)
            .join(F.broadcast(first), on + [F.col("tl_bucket") == F.col("tl_b")])
            .withColumn(rank, F.col("tl_first") + F.col("tl_within") - 1)
            .drop("tl_bucket", "tl_b", "tl_first", "tl_within", *[f"tl_g_{g}" for g in group]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Roots of the components of an undirected graph: ``node``, ``root`` (its smallest node).

    Alternating large-star and small-star steps: each round hangs neighbours
    on the smallest node in sight, so the edges end as one star for each
    component.  The rounds grow as the logarithm of the longest path.  Every
    round is minima by key (combined map-side) and an equi-join whose skewed
    keys adaptive execution splits; a round's edges are checkpointed in the
    shared folder.  Nodes without an edge to another node are not returned;
    a root is its own root.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("k")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        e = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
                        .where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(u, v))")).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
