"""Registered queries: chat templates and response extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chat as ch
from ..operators import sft
from ..sources.tables import table
from .records import conversation_records
from .registry import duck_strip, query

NL = "chr(10)"
_ENTRY = f"'<|im_start|>' || role || {NL} || coalesce(text, '') || '<|im_end|>'"


@query("p16_chatml_prompt", f"""
SELECT conv_id, string_agg({_ENTRY} || {NL}, '' ORDER BY turn) FILTER (WHERE role IN ('system', 'user', 'assistant'))
       || '<|im_start|>assistant' || {NL} AS prompt
FROM conversations GROUP BY conv_id""")
def p16(spark, sf):
    t = ch.conversation_turns(table(spark, sf, "conversations"))
    return t.select("conv_id", ch.chatml_prompt("turns").alias("prompt"))


@query("p17_history_prompt", f"""
SELECT conv_id, turn, prompt FROM (
  SELECT conv_id, turn, role,
         array_to_string(list({_ENTRY}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), {NL})
         || {NL} || '<|im_start|>assistant' || {NL} AS prompt
  FROM conversations) WHERE role = 'user'""")
def p17(spark, sf):
    return ch.history_prompts(table(spark, sf, "conversations"), 10)


@query("p18_plain_history_prompt", f"""
SELECT conv_id, turn, prompt FROM (
  SELECT conv_id, turn, role,
         array_to_string(list(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {NL})
         || {NL} || 'Assistant:' AS prompt
  FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user'""")
def p18(spark, sf):
    return ch.plain_history_prompts(table(spark, sf, "conversations"))


@query("p19_single_turn_prompt", f"""
SELECT conv_id, turn, '<|im_start|>user' || {NL} || text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS prompt
FROM conversations WHERE role = 'user'""")
def p19(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", ch.single_turn_prompt("text").alias("prompt"))


@query("p20_sft_simple_template", f"""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END
       || ': ' || text, {NL} ORDER BY turn) AS text
FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""")
def p20(spark, sf):
    """P20: conversations rendered with the ``simple`` SFT template."""
    t = ch.conversation_turns(table(spark, sf, "conversations"))
    return t.select("conv_id", ch.render_template("turns", "simple").alias("text"))


@query("p20_sft_llama_template", f"""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<<SYS>>' || {NL} || text || {NL} || '<</SYS>>' || {NL} || {NL}
                                     WHEN 'user' THEN '[INST] ' || text || ' [/INST]'
                                     ELSE ' ' || text || ' </s>' END, '' ORDER BY turn) AS text
FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""")
def p20_llama(spark, sf):
    t = ch.conversation_turns(table(spark, sf, "conversations"))
    return t.select("conv_id", ch.render_template("turns", "llama").alias("text"))


_GEN_SQL = f"""
WITH g AS (
  SELECT conv_id, turn, '<|im_start|>user' || {NL} || text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS prompt,
         nxt, role
  FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations)
  WHERE role = 'user' AND nrole = 'assistant')
"""


def _generated(spark, sf):
    """A stand-in generation log from the table: the single-turn prompt of
    each user turn followed by the next assistant turn and ``<|im_end|>``."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("nxt", F.lead("text").over(w)).withColumn("nrole", F.lead("role").over(w))
    g = c.filter((F.col("role") == "user") & (F.col("nrole") == "assistant"))
    return g.select("conv_id", "turn", ch.single_turn_prompt("text").alias("prompt"), "nxt")


@query("p22_strip_prompt", _GEN_SQL + f"""
SELECT conv_id, turn, {duck_strip("substr(prompt || nxt, length(prompt) + 1)")} AS response FROM g""")
def p22(spark, sf):
    g = _generated(spark, sf).withColumn("gen", F.concat("prompt", "nxt"))
    return g.select("conv_id", "turn", ch.strip_prompt("gen", "prompt").alias("response"))


@query("p23_extract_assistant", _GEN_SQL + f"""
SELECT conv_id, turn,
  {duck_strip("split_part(string_split(prompt || nxt || '<|im_end|>', '<|im_start|>assistant')[-1], '<|im_end|>', 1)")} AS response
FROM g""")
def p23(spark, sf):
    g = _generated(spark, sf).withColumn("gen", F.concat("prompt", "nxt", F.lit(ch.IM_END)))
    return g.select("conv_id", "turn", ch.extract_assistant("gen").alias("response"))


@query("p24_preview", "SELECT doc_id, left(text, 200) || '...' AS preview FROM documents")
def p24(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ch.preview("text", 200).alias("preview"))


_NB = lambda x: f"nullif({duck_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '')"
P20_AUTO_SQL = f"""
WITH p AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user' AND text IS NOT NULL) AS u,
         arg_min(text, turn) FILTER (WHERE role = 'assistant' AND text IS NOT NULL) AS a,
         arg_min(text, turn) FILTER (WHERE role = 'system' AND text IS NOT NULL) AS s,
         coalesce(string_agg({_ENTRY} || {NL}, '' ORDER BY turn) FILTER (WHERE role IN ('system', 'user', 'assistant')), '') AS chat
  FROM conversations GROUP BY conv_id),
r AS (
  SELECT *, '<|im_start|>user' || {NL} || array_to_string(list_filter([{_NB('u')}, {_NB('s')}], lambda x: x IS NOT NULL), {NL} || {NL})
            || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || a || '<|im_end|>' || {NL} AS alpaca FROM p),
v AS (SELECT CASE WHEN count(a) >= count(s) THEN 'alpaca' ELSE 'chat' END AS winner FROM p),
t AS (
  SELECT 'a' AS src, conv_id, 'alpaca' AS format, alpaca AS text FROM r WHERE a IS NOT NULL
  UNION ALL SELECT 'b', conv_id, 'sharegpt', chat FROM r
  UNION ALL SELECT 'c', conv_id, 'chat', chat FROM r
  UNION ALL SELECT 'd', conv_id, 'alpaca', alpaca FROM r, v WHERE winner = 'alpaca' AND a IS NOT NULL
  UNION ALL SELECT 'd', conv_id, 'chat', chat FROM r, v WHERE winner = 'chat' AND s IS NOT NULL)
SELECT src, conv_id, format, text, row_number() OVER (ORDER BY md5('42|' || src || '|' || conv_id)) - 1 AS position
FROM t WHERE text <> ''
"""


@query("p20_sft_auto_shuffled", P20_AUTO_SQL)
def p20_auto(spark, sf):
    """P20: four inputs of the formats alpaca, sharegpt, chat and a mixture, told apart by
    vote, rendered as ChatML and shuffled together."""
    r = conversation_records(spark, sf)
    inputs = {"a": F.col("shape") == "alpaca", "b": F.col("shape") == "sharegpt", "c": F.col("shape") == "messages",
              "d": (F.col("shape") == "alpaca") | ((F.col("shape") == "messages") & F.col("json").contains('"role":"system"'))}
    each = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in inputs.items()]), lambda x: x.isNotNull()))
    recs = r.select("conv_id", each.alias("src"), "rec")
    return sft.prepare_sft(recs, key="conv_id", shuffle=True).withColumn("position", F.col("position").cast("bigint"))
