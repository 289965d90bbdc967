"""Record-format conversion.

Records are ``VARIANT`` values, so one table can mix shapes and a key that
is absent differs from a key holding JSON null (only presence is tested by
the dispatcher, as in the reference).  The whole dispatcher is one CASE
chain of native expressions: no UDF, so Catalyst can push the following
filters and prune everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank, safe_str

NL2 = "\n\n"

# Formats in the order the dispatcher tries them.
FORMATS = ["text", "input_output", "instruction_output", "messages", "conversations",
           "reasoning", "prompt_response", "question_answer", "prompt_completion"]

# Column names tried by text-column auto-detection, in order.
COMMON_TEXT_COLUMNS = [
    "text", "content", "sentence", "document", "body",
    "instruction", "input", "output", "response", "answer", "question",
    "prompt", "completion", "context", "passage",
    "query", "reply", "message", "description",
]


def _rec(rec) -> Column:
    return F.col(rec) if isinstance(rec, str) else rec


def has_key(rec, key: str) -> Column:
    """Key presence (a JSON null counts as present)."""
    return F.try_variant_get(_rec(rec), f"$.{key}", "variant").isNotNull()


def get_str(rec, key: str) -> Column:
    return F.try_variant_get(_rec(rec), f"$.{key}", "string")


def _joined_parts(parts: Column) -> Column:
    """Join the non-null parts with a blank line; NULL when none remain."""
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, NL2))


def _pair(first: Column, second: Column) -> Column:
    """``first\\n\\nsecond`` (or ``second`` alone); NULL if ``second`` is blank."""
    a, b = nonblank(first), nonblank(second)
    return F.when(b.isNull(), F.lit(None).cast("string")) \
        .when(a.isNull(), b).otherwise(F.concat(a, F.lit(NL2), b))


def _list_texts(rec, key: str, field: str) -> tuple[Column, Column]:
    arr = F.try_variant_get(_rec(rec), f"$.{key}", f"array<struct<{field}: string>>")
    truthy = has_key(rec, key) & (F.coalesce(F.size(arr), F.lit(0)) > 0)
    texts = F.transform(arr, lambda m: F.when(m.isNotNull(), nonblank(m[field])))
    return truthy, _joined_parts(texts)


def _alpaca(rec) -> Column:
    inst, out, inp = safe_str(get_str(rec, "instruction")), safe_str(get_str(rec, "output")), \
        safe_str(get_str(rec, "input"))
    inst2 = F.when(inp == "", inst).when(inst == "", inp).otherwise(F.concat(inst, F.lit("\n"), inp))
    return (F.when((inst2 == "") & (out == ""), F.lit(None).cast("string"))
            .when(inst2 == "", out).otherwise(F.concat(inst2, F.lit(NL2), out)))


def _branches(rec):
    """(format, condition, value) in dispatch order."""
    text = get_str(rec, "text")
    msg_ok, msg_txt = _list_texts(rec, "messages", "content")
    conv_ok, conv_txt = _list_texts(rec, "conversations", "value")
    h = lambda k: has_key(rec, k)
    reasoning = _joined_parts(F.array(nonblank(get_str(rec, "input")),
                                      nonblank(get_str(rec, "reasoning_content")),
                                      nonblank(get_str(rec, "content"))))
    return [
        ("text", text.isNotNull() & (F.length(text) > 0), text),
        ("input_output", h("input") & h("output"), _pair(get_str(rec, "input"), get_str(rec, "output"))),
        ("instruction_output", h("instruction") & h("output"), _alpaca(rec)),
        ("messages", msg_ok, msg_txt),
        ("conversations", conv_ok, conv_txt),
        ("reasoning", h("input") & h("content"), reasoning),
        ("prompt_response", h("prompt") & h("response"), _pair(get_str(rec, "prompt"), get_str(rec, "response"))),
        ("question_answer", h("question") & h("answer"), _pair(get_str(rec, "question"), get_str(rec, "answer"))),
        ("prompt_completion", h("prompt") & h("completion"),
         _pair(get_str(rec, "prompt"), get_str(rec, "completion"))),
    ]


def convert_to_text(rec="rec", mode: str = "reference") -> Column:
    """The first matching shape wins; unknown shapes give NULL.

    ``mode="keep_instruction"`` checks instruction/output before
    input/output, so Alpaca records keep their instruction.
    """
    br = _branches(rec)
    if mode == "keep_instruction":
        br[1], br[2] = br[2], br[1]
    elif mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    out = None
    for _name, cond, val in br:
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(None).cast("string"))


def detect_format(rec="rec", mode: str = "reference") -> Column:
    """Which shape a record matched (``unknown`` if none)."""
    br = _branches(rec)
    if mode == "keep_instruction":
        br[1], br[2] = br[2], br[1]
    out = None
    for name, cond, _val in br:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def record_keys(json_col) -> Column:
    """Sorted key list of a JSON object string (for the P11 report)."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.array_join(F.array_sort(F.json_object_keys(c)), ",")


def convert_batch(df: DataFrame, rec: str = "rec", keep: tuple[str, ...] = (),
                  mode: str = "reference") -> DataFrame:
    """Project to ``text`` only (NULL -> ''), plus any key columns to keep."""
    return df.select(*keep, F.coalesce(convert_to_text(rec, mode), F.lit("")).alias("text"))


def to_records(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columnar source -> VARIANT record: every column is a present key."""
    cols = cols or df.columns
    return df.withColumn("rec", F.to_variant_object(F.struct(*cols)))


def multi_column_text(cols: list[str]) -> Column:
    """Truthy values of ``cols`` as strings, joined by one space."""
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat_ws(" ", *parts)


def detect_text_columns(df: DataFrame, order_col: str, text_column: str = "text") -> list[str]:
    """Auto-detect the text columns from the *first* record.

    The named column if truthy; else every truthy column of
    ``COMMON_TEXT_COLUMNS``; else all string fields longer than 10 chars.
    Only one row reaches the driver.
    """
    first = df.orderBy(order_col).limit(1).collect()
    if not first:
        return [text_column]
    row = first[0].asDict()
    if row.get(text_column):
        return [text_column]
    found = [c for c in COMMON_TEXT_COLUMNS if row.get(c)]
    if found:
        return found
    return [k for k, v in row.items() if isinstance(v, str) and len(v) > 10] or [text_column]


def text_or_record(df: DataFrame, text: str = "text") -> Column:
    """P25: the ``text`` column, else the JSON form of the whole record."""
    if text in df.columns:
        return F.coalesce(F.col(text), F.to_json(F.struct(*df.columns)))
    return F.to_json(F.struct(*df.columns))
