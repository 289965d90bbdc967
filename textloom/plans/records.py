"""Heterogeneous record fixtures derived from the ``conversations`` table.

Every conversation is rendered in every record shape the converter knows
(plus one unknown shape), as JSON Lines text parsed to ``VARIANT``.  The
per-conversation pivot is a ``groupBy(conv_id)``: a group is one
conversation, so its size is bounded by the conversation, not the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

SHAPES = ["text", "input_output", "alpaca", "instruction_output", "messages", "sharegpt",
          "reasoning", "prompt_response", "question_answer", "prompt_completion", "unknown"]


def conversation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    return c.groupBy("conv_id").agg(
        first("user").alias("u"), first("assistant").alias("a"), first("system").alias("s"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, shape, json, rec VARIANT)``: 11 records per conversation."""
    p = conversation_pivot(spark, sf_dir)
    u, a, s = F.col("u"), F.col("a"), F.col("s")
    s0, a0 = F.coalesce(s, F.lit("")), F.coalesce(a, F.lit(""))
    msgs = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    share = F.transform("turns", lambda t: F.struct(
        F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt")
        .otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    shapes = {
        "text": F.struct(u.alias("text")),
        "input_output": F.struct(s0.alias("input"), a.alias("output")),
        "alpaca": F.struct(u.alias("instruction"), s0.alias("input"), a.alias("output")),
        "instruction_output": F.struct(u.alias("instruction"), a0.alias("output")),
        "messages": F.struct(msgs.alias("messages")),
        "sharegpt": F.struct(share.alias("conversations")),
        "reasoning": F.struct(u.alias("input"), a0.alias("content"), s.alias("reasoning_content")),
        "prompt_response": F.struct(u.alias("prompt"), a.alias("response")),
        "question_answer": F.struct(u.alias("question"), a.alias("answer")),
        "prompt_completion": F.struct(u.alias("prompt"), a.alias("completion")),
        "unknown": F.struct(u.alias("title")),
    }
    recs = F.array(*[F.struct(F.lit(k).alias("shape"), F.to_json(v).alias("json"))
                     for k, v in shapes.items()])
    return (p.select("conv_id", F.explode(recs).alias("r"))
            .select("conv_id", "r.shape", "r.json")
            .withColumn("rec", F.parse_json("json")))
