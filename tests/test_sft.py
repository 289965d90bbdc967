"""P20: formats by vote, templates and the seeded shuffle."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import sft

CHAT = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}, {"role": "tool", "content": "t"}]}
SHARE = {"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "q"}, {"from": "gpt"}]}
ALPACA = {"instruction": "do", "input": " ", "output": "done"}


def _records(spark, rows):
    df = spark.createDataFrame([(s, i, json.dumps(x)) for s, i, x in rows], "src string, row_idx int, json string")
    return df.select("src", "row_idx", F.parse_json("json").alias("rec"))


def test_formats_by_vote_and_templates(spark):
    rows = [("a", 0, ALPACA), ("a", 1, ALPACA | {"input": "this"}), ("a", 2, CHAT), ("b", 0, SHARE), ("c", 0, CHAT),
            ("tie", 0, CHAT), ("tie", 1, ALPACA), ("none", 0, {"title": "x"}), ("c", 1, {"messages": []}), ("c", 2, {"messages": None})]
    df = _records(spark, rows)
    got = {(r.src, r.row_idx): (r.format, r.text) for r in sft.prepare_sft(df, template="simple").collect()}
    assert got == {("a", 0): ("alpaca", "User: do\nAssistant: done"), ("a", 1): ("alpaca", "User: do\n\nthis\nAssistant: done"),
                   ("b", 0): ("sharegpt", "System: s\nUser: q\nAssistant: "), ("c", 0): ("chat", "User: q\nAssistant: r"),
                   ("tie", 1): ("alpaca", "User: do\nAssistant: done")}
    only = sft.prepare_sft(df, "chat", "chatml").collect()
    assert {(r.src, r.row_idx) for r in only} == {("a", 2), ("c", 0), ("tie", 0)}
    assert only[0].text == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    with pytest.raises(ValueError):
        sft.prepare_sft(df, "parquet")
    assert sft.prepare_sft(df.limit(0)).count() == 0


def test_the_shuffle_mixes_inputs_by_seed(spark):
    df = _records(spark, [(s, i, ALPACA) for s in "ab" for i in range(100)])
    order = {seed: [(r.src, r.row_idx) for r in sft.prepare_sft(df, shuffle=True, seed=seed).orderBy("position").collect()] for seed in (1, 2)}
    assert len(order[1]) == 200 and sorted(order[1]) == sorted(order[2]) and order[1] != order[2] != sorted(order[2])
    assert 30 < sum(s == "a" for s, _ in order[1][:100]) < 70
