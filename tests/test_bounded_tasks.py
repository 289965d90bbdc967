"""What a task holds or reads is bounded by the code's own figures, not by a batch, a file or the table."""

import collections
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import evaluate as ev
from textloom.operators import unigram as ug
from textloom.plans import queries_io as qi

SEQUENCES = [[1, 5, 5, 5, 2], None, [], [7], [1, 2], [2, 1, 2, 1, 2, 1], [9, 300, 70000]]


def _pairs(seqs):
    return collections.Counter(p for s in seqs for p in zip(s or (), (s or ())[1:]))


def test_pairs_are_counted_a_few_tokens_at_a_time(monkeypatch):
    lists = pa.array(SEQUENCES, pa.list_(pa.int32()))
    batches = [pa.RecordBatch.from_arrays([x], names=["input_ids"]) for x in (lists, lists.slice(2, 4), lists.slice(1, 2))]
    want = _pairs(SEQUENCES) + _pairs(SEQUENCES[2:6])
    for held in (1, 2, 3, 4, 1000):
        monkeypatch.setattr(ev, "COUNTED_TOKENS", held)
        got = collections.Counter()
        for b in ev._count_pairs(iter(batches)):
            assert held < 1000 or b.num_rows == len(want)
            for l, r, n in zip(*(c.to_pylist() for c in b.columns)):
                got[l, r] += n
        assert got == want


def test_windows_are_scored_a_few_rows_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQUENCES)], "k int, input_ids array<int>")
    sizes = []

    def scored(rows):
        monkeypatch.setattr(ev, "SCORED_ROWS", rows)
        w = ev.score_windows(df, lambda s: np.asarray(s[1:], float), ["k"], 4, 2)
        sizes.append(w.count())
        return sorted(map(tuple, w.collect()))

    assert scored(2) == scored(1000) and sizes[0] == sizes[1] > 4


def test_texts_are_normalised_a_few_at_a_time(spark, monkeypatch):
    texts = ["plain", None, "ﬁne", "", "Å", "ÅB", "ﬀ"]
    for held in (1, 2, 100):
        monkeypatch.setattr(tx, "TEXTS_HELD", held)
        assert tx._mapped(pa.array(texts), tx._nfkc).to_pylist() == [tx._nfkc(t) for t in texts]
    assert tx._mapped(pa.array([], pa.string()), tx._nfkc).to_pylist() == []
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(tx.nfkc("t"), tx.nfkc_casefold("t")).collect()]
    assert got == [(tx._nfkc(t), None if t is None else tx._nfkc(t).casefold()) for t in texts]


def test_best_paths_with_few_words_held(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the thing the thin", None, "other", "", "the Ünï 12"])], "k int, text string")
    vocab = spark.createDataFrame([(t, i, -1.0 - i / 9) for i, t in enumerate([*ug.CONTROL, *"▁theingor", "▁the", "thin"])],
                                  "token string, id int, score double")

    def encoded(words, texts):
        monkeypatch.setattr(ug, "WORDS_HELD", words)
        monkeypatch.setattr(ug, "TEXTS_HELD", texts)
        return sorted((r.k, tuple(r.input_ids), tuple(r.pieces)) for r in ug.encode(docs, ug.UnigramModel(vocab), ["k"]).collect())

    assert encoded(1, 1) == encoded(1000, 1000)


def _documents(spark, files):
    d = tempfile.mkdtemp()
    rows = [(i, f"text number {i} " * 8, "en" if i % 3 else "de", "src", 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files).write.option("maxRecordsPerFile", 400 // files).parquet(os.path.join(d, "documents.parquet"))
    return d


def test_stream_files_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(qi, "table", lambda s, sf, n: s.read.parquet(f"{sf}/{n}.parquet").repartition(10))
    sf = _documents(spark, 2)
    path, _, each = qi._stream_source(spark, sf)
    assert each == 3 and 4 < len(spark.read.parquet(path).inputFiles()) <= 12
    assert {(r.lang, r.n_kept) for r in qi.r03(spark, sf).collect()} == {("en", 100), ("de", 100)}
    ids = sorted(r.doc_id for r in qi.r03_ids(spark, sf).collect())
    assert ids == sorted([i for i in range(400) if i % 3][:25] + [i for i in range(400) if not i % 3][:25])
    batches = qi.r04(spark, sf).select("batch_id").distinct().count()
    assert batches == 4


def test_json_arrays_in_several_files(spark, monkeypatch):
    sf = tempfile.mkdtemp()
    rows = [(c, t, r, f"{r} says {c} {t}") for c in range(40) for t, r in enumerate(("system", "user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(os.path.join(sf, "conversations.parquet"))
    paths = []
    scratch = qi._scratch
    monkeypatch.setattr(qi, "_scratch", lambda s, n: paths.append(scratch(s, n)) or paths[-1])
    one = sorted(map(tuple, qi.s02(spark, sf).collect()))
    monkeypatch.setattr(qi, "ARRAY_BYTES", 5000)
    assert sorted(map(tuple, qi.s02(spark, sf).collect())) == one
    few, many = (spark.read.text(p).select(F.input_file_name()).distinct().count() for p in paths)
    assert few == 11 < many
