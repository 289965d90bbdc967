"""Instruction-tuning text from mixed inputs (P20): format, template, shuffle.

Records are ``VARIANT`` values with the name of the input that they come from.
The format ``auto`` is settled for each input by a vote of its records, so that
a stray record of another shape doesn't change how an input is read; one
aggregate counts all inputs' votes.  Records that don't have their input's
format, or give no text, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank
from .chat import render_template
from .convert import NL2, get_str, has_key
from .sample import sequential_index

# The formats, in the order that settles a tied vote.
SFT_FORMATS = ("alpaca", "sharegpt", "chat")
_TURN = "array<struct<role: string, text: string>>"


def sft_format(rec: str = "rec") -> Column:
    """The format of one record by its keys, null for any other shape."""
    return (F.when(has_key(rec, "messages"), "chat").when(has_key(rec, "conversations"), "sharegpt")
            .when(has_key(rec, "output") & (has_key(rec, "instruction") | has_key(rec, "input")), "alpaca"))


def sft_turns(fmt: Column, rec: str = "rec") -> Column:
    """A record of the given format as ``array<struct<role, text>>``.

    alpaca: the instruction with its input below it is the user's, the output the assistant's.
    """
    def turn(role, text):
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    parts = F.filter(F.array(nonblank(get_str(rec, "instruction")), nonblank(get_str(rec, "input"))), lambda x: x.isNotNull())
    alpaca = F.array(turn(F.lit("user"), F.array_join(parts, NL2)), turn(F.lit("assistant"), get_str(rec, "output")))
    share = F.try_variant_get(F.col(rec), "$.conversations", "array<struct<from: string, value: string>>")
    chat = F.try_variant_get(F.col(rec), "$.messages", "array<struct<role: string, content: string>>")
    named = F.transform(share, lambda t: turn(F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant")
                                              .otherwise(t["from"]), t["value"]))
    return (F.when(fmt == "alpaca", alpaca.cast(_TURN)).when(fmt == "sharegpt", named.cast(_TURN))
            .when(fmt == "chat", F.transform(chat, lambda t: turn(t["role"], t["content"])).cast(_TURN)))


def vote_formats(records: DataFrame, src: str = "src", rec: str = "rec") -> DataFrame:
    """``(src, format)``: the format that most of an input's records have; inputs without any known record go."""
    own = sft_format(rec)
    votes = records.groupBy(src).agg(*[F.count(F.when(own == f, 1)).alias(f) for f in SFT_FORMATS])
    best = F.greatest(*SFT_FORMATS)
    winner = F.coalesce(*[F.when(F.col(f) == best, F.lit(f)) for f in SFT_FORMATS])
    return votes.where(best > 0).select(src, winner.alias("format"))


def prepare_sft(records: DataFrame, fmt: str = "auto", template: str = "chatml", src: str = "src", rec: str = "rec",
                key: str = "row_idx", shuffle: bool = False, seed: int = 42) -> DataFrame:
    """``(src, key, format, text)``, with ``shuffle`` also ``position`` (from 0) in a seeded order over all inputs.

    ``key`` must tell the records of one input apart.
    """
    if fmt not in (*SFT_FORMATS, "auto"):
        raise ValueError(f"unknown format {fmt!r}")
    own = sft_format(rec)
    if fmt == "auto":
        # not hinted: adaptive execution broadcasts the votes if they are small, and splits a hot input if not
        records = records.join(vote_formats(records, src, rec), src)
    else:
        records = records.withColumn("format", F.lit(fmt))
    text = render_template(sft_turns(F.col("format"), rec), template)
    out = records.where(own == F.col("format")).select(src, key, "format", text.alias("text")).where(F.col("text") != "")
    if not shuffle:
        return out
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(src).cast("string"), F.lit("")), F.col(key).cast("string")))
    return sequential_index(out.withColumn("_order", order), ["_order"], "position").drop("_order")
