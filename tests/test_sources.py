"""S01-S19 sources and sinks on files written from small fixtures."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import catalog, files, sinks, synthetic


def _tmp():
    return tempfile.mkdtemp(prefix="textloom-src-")


def test_lines_jsonl_array_wholefiles(spark):
    d = _tmp()
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("  first line  \n\n   \nsecond　\nthird\n")
    lines = files.read_lines(spark, os.path.join(d, "a.txt")).orderBy("path", "block", "line_no")
    assert [r.text for r in lines.collect()] == ["first line", "second", "third"]
    with open(os.path.join(d, "r.jsonl"), "w") as f:
        f.write('{"text": "x"}\n\n{"prompt": "p", "response": "r"}\n')
    assert files.read_jsonl(spark, os.path.join(d, "r.jsonl")).count() == 2
    with open(os.path.join(d, "arr.json"), "w") as f:
        json.dump([{"text": "t"}, {"input": "i", "output": "o"}, {"messages": [{"role": "user", "content": "m"}]}], f)
    arr = files.read_json_array(spark, os.path.join(d, "arr.json")).orderBy("pos").collect()
    assert [r.pos for r in arr] == [0, 1, 2]
    sub = os.path.join(d, "nested", "deeper")
    os.makedirs(sub)
    for name, body in (("x.txt", "doc one\nstill one"), ("y.md", "skip")):
        with open(os.path.join(sub, name), "w") as f:
            f.write(body)
    whole = files.read_text_files(spark, d).collect()
    assert sorted(r.text for r in whole) == sorted(["  first line  \n\n   \nsecond　\nthird\n", "doc one\nstill one"])


def test_mandatory_text_and_tolerant_reads(spark):
    d = _tmp()
    good = os.path.join(d, "good.json")
    with open(good, "w") as f:
        f.write('{"text": "a"}\n{"text": "b"}\n')
    assert files.read_text_records(spark, good).count() == 2
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write('{"text": "a"}\n{"other": 1}\n')
    with pytest.raises(Exception):
        files.read_text_records(spark, bad).collect()
    broken = os.path.join(d, "broken.json")
    with open(broken, "w") as f:
        f.write('{"text": "ok"}\n{not json\n')
    missing, garbled = os.path.join(d, "missing.json"), os.path.join(d, "garbled.json.gz")
    with open(garbled, "wb") as f:
        f.write(b"this is no gzip file")
    data, report = files.read_tolerant(spark, [good, broken, missing, garbled], "text string")
    rep = {os.path.basename(r.path): (r.status, r.n_records, r.n_corrupt) for r in report.collect()}
    assert rep == {"good.json": ("read", 2, 0), "broken.json": ("read", 2, 1), "missing.json": ("missing", 0, 0),
                   "garbled.json.gz": ("unreadable", 0, 0)} and data.count() == 3
    data, report = files.read_tolerant(spark, missing, "text string")
    assert data.count() == 0 and [r.status for r in report.collect()] == ["missing"]


def test_shards_metadata_cache_manifest(spark):
    assert sinks.shard_count(100, 8) == 8 and sinks.shard_count(2_000_000, 64) == 32
    assert sinks.shard_count(6_000_000, 64) == 64 and sinks.shard_count(10, 2) == 8
    d = _tmp()
    df = spark.range(1000).select(F.col("id").alias("row_idx"), (F.col("id") % 3).cast("string").alias("src"))
    n = sinks.write_shards(df, os.path.join(d, "data"), n_shards=sinks.shard_count(1000, 8))
    assert n == 8 and sinks.write_shards(df, os.path.join(d, "by-size"), max_records_per_file=100) >= 10
    assert spark.read.parquet(os.path.join(d, "by-size")).count() == 1000 and spark.read.parquet(os.path.join(d, "data")).count() == 1000
    assert sinks.is_complete(spark, os.path.join(d, "data"))
    calls = []
    path = sinks.cache_path(d, "src", sinks.cache_version_key(300, "BPE", 7, "packing_2048"))
    for _ in range(2):
        sinks.cached_stage(spark, path, lambda: calls.append(1) or df)
    assert len(calls) == 1

    def broken():
        sinks._hadoop(spark, p2)[2].mkdirs(sinks._hadoop(spark, os.path.join(p2, "attempt-lost"))[1])
        raise RuntimeError("lost")

    p2 = sinks.cache_path(d, "other", "v")
    with pytest.raises(RuntimeError):
        sinks.cached_stage(spark, p2, broken)
    assert sinks.cached_stage(spark, p2, lambda: df).count() == 1000  # the interrupted build isn't read
    assert not sinks._commit(spark, p2, "attempt-late") and sinks.cached_stage(spark, p2, broken).count() == 1000
    m = sinks.manifest(df, "p").collect()
    assert sorted((r.src, r.num_samples) for r in m) == [("0", 334), ("1", 333), ("2", 333)]
    sinks.write_metadata(spark, os.path.join(d, "meta"), dataset="x", num_samples=1000)
    assert spark.read.json(os.path.join(d, "meta")).first().num_samples == "1000"


def test_specs_languages_synthetic(spark):
    specs = spark.createDataFrame([(0, "wiki:20231101.ko"), (1, "data/x.jsonl"), (2, "corpus")], "idx int, spec string")
    r = {x.idx: (x.kind, x.name, x.config) for x in catalog.parse_specs(specs, explicit_config="cfg").collect()}
    assert r == {0: ("hf", "wiki", "cfg"), 1: ("file", "data/x.jsonl", None), 2: ("hf", "corpus", None)}
    assert catalog.select_languages(spark, ["ko", "xx"]).count() == 1
    with pytest.raises(ValueError):
        catalog.select_languages(spark, ["xx"])
    t = synthetic.random_tokens(spark, 10, 16, 50).collect()
    assert all(len(r.input_ids) == 16 and max(r.input_ids) < 50 and r.labels == r.input_ids for r in t)
    assert synthetic.random_tokens(spark, 10, 16, 50).collect() == t


def test_dedup_merges_and_union(spark):
    from textloom.operators.setops import concat_sources, dedup_merges, vocab_union
    m = spark.createDataFrame([(0, "a", "b"), (1, "c", "d"), (2, "a", "b")], "rank int, l string, r string")
    assert sorted(map(tuple, dedup_merges(m).collect())) == [(0, "a", "b"), (1, "c", "d")]
    base = spark.createDataFrame([("x", 0), ("y", 1)], "token string, id int")
    add = spark.createDataFrame([("y", 5), ("z", 2)], "token string, id int")
    assert sorted(map(tuple, vocab_union(base, add).collect())) == [("x", 0), ("y", 1), ("z", 2)]
    u = concat_sources([base, add])
    assert sorted(r.src_idx for r in u.collect()) == [0, 0, 1, 1]


def test_results_sink_and_training_log(spark):
    from textloom.operators.sample import last_n_per_group
    from textloom.operators.stats import windowed_mean
    d = _tmp()
    res = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "prompt string, response string")
    sinks.write_results(res, os.path.join(d, "results"))
    assert sorted(map(tuple, spark.read.json(os.path.join(d, "results")).select("prompt", "response").collect())) \
        == [("p1", "r1"), ("p2", "r2")]
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        for s in range(1, 26):
            f.write(json.dumps({"step": s, "loss": 10.0 / s, "learning_rate": 1e-4}) + "\n")
    log = files.read_training_log(spark, os.path.join(d, "log.jsonl")).withColumn("run", F.lit(0))
    last = last_n_per_group(log, 10, "run", "step").collect()
    assert sorted(r.step for r in last) == list(range(16, 26))
    w = {r.window: r.n_steps for r in windowed_mean(log, "step", "loss", 10).collect()}
    assert w == {0: 10, 1: 10, 2: 5}
