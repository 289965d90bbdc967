"""Hand-derived goldens for every branch and the edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators.convert import (convert_to_text, detect_format, detect_text_columns,
                                        multi_column_text)

CASES = [
    # (record, expected text, expected format)
    ({"text": "hello"}, "hello", "text"),
    ({"text": "  spaced  "}, "  spaced  ", "text"),                 # text branch does not strip
    ({"text": "   "}, "   ", "text"),                               # whitespace-only survives
    ({"text": ""}, None, "unknown"),                                # empty text falls through
    ({"text": None, "input": "q", "output": "a"}, "q\n\na", "input_output"),
    ({"input": "", "output": " a "}, "a", "input_output"),
    ({"input": "q", "output": "  "}, None, "input_output"),         # output empty -> null, no fall-through
    ({"instruction": "do", "input": "ctx", "output": "ok"}, "ctx\n\nok", "input_output"),  # Alpaca trap
    ({"instruction": "do", "output": ""}, "do\n\n", "instruction_output"),
    ({"instruction": "", "output": ""}, None, "instruction_output"),
    ({"instruction": " ", "output": "x"}, "x", "instruction_output"),
    ({"messages": [{"role": "system", "content": " s "}, None, {"role": "user", "content": ""},
                   {"role": "weird", "content": "w"}]}, "s\n\nw", "messages"),
    ({"messages": [{"role": "user", "content": " "}]}, None, "messages"),
    ({"messages": [], "conversations": [{"from": "human", "value": "v1"}, {"from": "gpt", "value": "v2"}]},
     "v1\n\nv2", "conversations"),
    ({"conversations": []}, None, "unknown"),
    ({"input": "i", "content": "c", "reasoning_content": "r"}, "i\n\nr\n\nc", "reasoning"),
    ({"input": "", "content": ""}, None, "reasoning"),
    ({"prompt": "p", "response": "r"}, "p\n\nr", "prompt_response"),
    ({"prompt": "p", "completion": "c"}, "p\n\nc", "prompt_completion"),
    ({"question": "", "answer": "a"}, "a", "question_answer"),
    ({"question": "q", "answer": None}, None, "question_answer"),   # JSON null: key present
    ({"foo": "bar"}, None, "unknown"),
    ({"text": "　x "}, "　x ", "text"),
    ({"input": " \u0085q\x1c", "output": "a　"}, "q\n\na", "input_output"),
]


def test_branches(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("rec", F.parse_json("j"))
    out = {r.i: (r.t, r.f) for r in df.select("i", convert_to_text("rec").alias("t"),
                                              detect_format("rec").alias("f")).collect()}
    for i, (_, text, fmt) in enumerate(CASES):
        assert out[i] == (text, fmt), (CASES[i], out[i])


def test_keep_instruction_mode(spark):
    df = spark.createDataFrame([(json.dumps({"instruction": "do", "input": "ctx", "output": "ok"}),)], "j string")
    r = df.select(convert_to_text(F.parse_json("j"), mode="keep_instruction").alias("t")).first()
    assert r.t == "do\nctx\n\nok"
    with pytest.raises(ValueError):
        convert_to_text("rec", mode="nope")


def test_multi_column_and_detection(spark):
    df = spark.createDataFrame([(0, "", "Question body here", "answer text that is long", 5),
                                (1, "t", "q", "a", 6)], "i int, text string, question string, answer string, n int")
    assert detect_text_columns(df, "i") == ["answer", "question"]
    r = df.select(multi_column_text(["question", "answer", "n"]).alias("t")).orderBy("t").collect()
    assert [x.t for x in r] == ["Question body here answer text that is long 5", "q a 6"]
