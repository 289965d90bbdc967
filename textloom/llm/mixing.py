"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's rate is the number of times its documents should occur on average:
its target share of the output over its size.  Each document draws its count
by inverting the Poisson distribution of that mean at a uniform number hashed
from the seed and its doc_id, is exploded by the count, and all copies are
shuffled globally by another hash.

Defined cases: a null source is a source of its own; a null doc_id hashes as
the word null with the text's digest; repeated rows draw the same count each;
null and empty texts have size 1; a source whose weight is 0 draws nothing; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ranked

#: Sources up to this number, with up to this number of steps in all (32 MB), are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 65_536
MAX_BROADCAST_STEPS = 4_000_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``tl_source``, ``size`` (UTF-8 bytes plus 1 a row), ``weight`` (of the output) and ``rate``.

    ``weights`` are the target shares by source, others getting none; without
    them a source's share is in proportion to ``size ** alpha``.  The output is
    ``epochs`` times the input's size on average.
    """
    size = F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)
    by = docs.groupBy(F.col(source_col).cast("string").alias("tl_source")).agg(size.alias("size"))
    if weights is None:
        by = by.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        if any(w < 0 for w in weights.values()) or not any(weights.values()):
            raise ValueError("weights must not be negative, nor all zero")
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        by = by.withColumn("w", F.coalesce(F.try_element_at(table, F.coalesce("tl_source", F.lit(""))), F.lit(0.0)))
    by = cut_lineage(by)
    total = by.agg(F.sum("size").cast("double").alias("size"), F.sum("w").alias("w")).first()
    share = F.col("w") / F.lit(total["w"] or 1.0)
    return by.select("tl_source", "size", share.alias("weight"),
                     (share * F.lit((total["size"] or 0.0) * epochs) / F.col("size")).alias("rate"))


def first_step(rate: Column) -> Column:
    """The smallest count that a draw can give, or one below: the mass under it is less than 1e-30."""
    first = F.floor(rate - 12 * F.sqrt(rate) - 30).cast("long")
    return F.when(first >= 64, first).otherwise(F.lit(0).cast("long"))


def poisson_steps(rate: Column, first: Column | None = None) -> Column:
    """The distribution function at ``first`` (0 if not given), first + 1, ... until the tail is under double precision.

    From ``first_step`` on it has 24 steps for each unit of the rate's root, and 60, however large the rate.
    """
    first = F.lit(0).cast("long") if first is None else first
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    n = first.cast("double")  # ln (first - 1)! by Stirling's series, from 64 on to the last bits of a double
    below = (n - 0.5) * F.log(n) - n + F.lit(0.9189385332046727) + 1 / (12 * n) - 1 / (360 * n * n * n)
    start = F.struct(F.array().cast("array<double>").alias("steps"), F.lit(0.0).alias("sum"),
                     F.when(first > 0, below).otherwise(F.lit(0.0)).alias("log_fact"))

    def step(acc: Column, k: Column) -> Column:
        log_fact = acc["log_fact"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
        p = F.when(rate > 0, F.exp(k * F.log(F.greatest(rate, F.lit(1e-300))) - rate - log_fact)).otherwise(
            F.when(k == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.struct(F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"), (acc["sum"] + p).alias("sum"),
                        log_fact.alias("log_fact"))

    return F.aggregate(F.sequence(first, last), start, step)["steps"]


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the seed and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
              seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              columns: list[str] | None = None) -> DataFrame:
    """Copies of the documents: the chosen columns and n_copies, copy (from 1), rate, shuffle_key."""
    rates = cut_lineage(source_rates(docs, weights, alpha, epochs, source_col, text_col).select(
        "tl_source", F.col("rate").alias("tl_rate"), first_step(F.col("rate")).alias("tl_first")).withColumn(
        "tl_steps", poisson_steps(F.col("tl_rate"), F.col("tl_first"))))
    size = rates.agg(F.count(F.lit(1)).alias("sources"), F.sum(F.size("tl_steps")).alias("steps")).first()
    if size["sources"] <= MAX_BROADCAST_SOURCES and (size["steps"] or 0) <= MAX_BROADCAST_STEPS:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col(id_col).cast("string"),
                      F.concat(F.lit("null"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string")))
    own = columns if columns is not None else docs.columns
    drawn = (docs.withColumn("tl_name", name)
             .join(rates, F.col(source_col).cast("string").eqNullSafe(F.col("tl_source")))
             .withColumn("tl_u", uniform(seed, F.col("tl_name")))
             .withColumn("tl_n", (F.col("tl_first") + F.size(F.filter("tl_steps", lambda c: c <= F.col("tl_u")))).cast("int"))
             .where("tl_n > 0"))
    return drawn.select(*[F.col(c) for c in own], "tl_name", "tl_rate", "tl_n",
                        F.explode(F.sequence(F.lit(1), F.col("tl_n"))).alias("tl_copy")).withColumn(
        "tl_shuffle", F.md5(F.concat_ws("|", F.lit(f"{seed}+"), "tl_name", F.col("tl_copy").cast("string"))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
        seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents, columns as they were, in a global random order (a range partitioning and sort)."""
    out = replicate(docs, weights, alpha, epochs, seed, id_col, source_col, text_col)
    return out.orderBy("tl_shuffle").select(*docs.columns)


def mixing_plan(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
                seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One narrow row for each copy: doc_id, source, n_copies, copy, rate, position (global, from 0)."""
    copies = replicate(docs, weights, alpha, epochs, seed, id_col, source_col, text_col, columns=[id_col, source_col])
    narrow = cut_lineage(copies.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                       F.col("tl_n").alias("n_copies"), F.col("tl_copy").alias("copy"),
                                       F.col("tl_rate").alias("rate"), "tl_shuffle"))
    return ranked(narrow, [], "tl_shuffle", ["doc_id", "copy"], "position").drop("tl_shuffle")
