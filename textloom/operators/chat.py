"""Chat templates and response extraction.

Conversations are ``(conv_id, turn, role, text)`` rows.  Whole-conversation
templates collect one conversation's turns (a group is one conversation);
history prompts are windows over the preceding turns of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip

IM_START, IM_END = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def chatml_entry(role, content) -> Column:
    """``<|im_start|>{role}\\n{content}<|im_end|>`` (no trailing newline)."""
    return F.concat(F.lit(IM_START), _c(role), F.lit("\n"), F.coalesce(_c(content), F.lit("")), F.lit(IM_END))


def chatml_prompt(turns="turns", generation_prompt: bool = True) -> Column:
    """ChatML from an ordered ``array<struct<role, text>>``; roles other
    than system/user/assistant are dropped; ends with the assistant prefix."""
    kept = F.filter(_c(turns), lambda t: t["role"].isin(*ROLES))
    body = F.array_join(F.transform(kept, lambda t: F.concat(chatml_entry(t["role"], t["text"]), F.lit("\n"))), "")
    return F.concat(body, F.lit(f"{IM_START}assistant\n")) if generation_prompt else body


def single_turn_prompt(question) -> Column:
    """Wrap one user message with the assistant generation prefix."""
    return F.concat(F.lit(f"{IM_START}user\n"), _c(question), F.lit(f"{IM_END}\n{IM_START}assistant\n"))


def conversation_turns(conv: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Ordered turns per conversation: ``(key, turns array<struct<turn, role, text>>)``."""
    return conv.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("turns"))


def history_prompts(conv: DataFrame, keep_last: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each user turn, the ChatML history (last ``keep_last`` entries
    before it) plus the new message, joined by newlines, then the assistant
    prefix."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-keep_last, 0)
    e = conv.withColumn("_e", F.struct(order, chatml_entry("role", "text").alias("s")))
    hist = F.transform(F.array_sort(F.collect_list("_e").over(w)), lambda x: x["s"])
    return (e.withColumn("_h", hist).filter(F.col("role") == "user")
            .select(key, order, F.concat(F.array_join("_h", "\n"), F.lit(f"\n{IM_START}assistant\n")).alias("prompt")))


def plain_history_prompts(conv: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``User: …`` / ``Assistant: …`` history plus ``\\nAssistant:`` for
    each user turn (the whole preceding conversation, untrimmed)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ")
    e = conv.filter(F.col("role").isin("user", "assistant")).withColumn(
        "_e", F.struct(order, F.concat(label, F.col("text")).alias("s")))
    hist = F.transform(F.array_sort(F.collect_list("_e").over(w)), lambda x: x["s"])
    return (e.withColumn("_h", hist).filter(F.col("role") == "user")
            .select(key, order, F.concat(F.array_join("_h", "\n"), F.lit("\nAssistant:")).alias("prompt")))


# P20 templates: our own renderings of public chat formats.
def render_template(turns="turns", template: str = "chatml") -> Column:
    t = _c(turns)
    if template in ("chatml", "qwen"):
        return chatml_prompt(t, generation_prompt=False)
    if template == "simple":
        names = lambda r: F.when(r == "system", "System").when(r == "user", "User").otherwise("Assistant")
        kept = F.filter(t, lambda x: x["role"].isin(*ROLES))
        return F.array_join(F.transform(kept, lambda x: F.concat(names(x["role"]), F.lit(": "), x["text"])), "\n")
    if template == "llama":
        def one(x):
            return (F.when(x["role"] == "system", F.concat(F.lit("<<SYS>>\n"), x["text"], F.lit("\n<</SYS>>\n\n")))
                    .when(x["role"] == "user", F.concat(F.lit("[INST] "), x["text"], F.lit(" [/INST]")))
                    .otherwise(F.concat(F.lit(" "), x["text"], F.lit(" </s>"))))
        kept = F.filter(t, lambda x: x["role"].isin(*ROLES))
        return F.array_join(F.transform(kept, one), "")
    raise ValueError(f"unknown template {template!r}")


def strip_prompt(generated, prompt) -> Column:
    """The generated text minus the prompt prefix, stripped."""
    return py_strip(F.substring(_c(generated), F.length(_c(prompt)) + 1, 1 << 30))


def extract_assistant(generated) -> Column:
    """Text after the last ``<|im_start|>assistant``, up to the next
    ``<|im_end|>``, stripped (whole text when the marker is absent)."""
    tail = F.element_at(F.split(_c(generated), F.lit(r"\Q" + IM_START + r"assistant\E"), -1), -1)
    return py_strip(F.element_at(F.split(tail, F.lit(r"\Q" + IM_END + r"\E"), -1), 1))


def preview(text, n: int = 200) -> Column:
    """The first ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))
