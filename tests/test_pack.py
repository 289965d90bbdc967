"""Invariants and hand fixtures."""

import itertools
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from textloom.operators.pack import balanced_pack, collate, concat_and_chunk, next_fit_pack
from textloom.plans import queries_io as qi


def _seqs(spark, lens, src="a", start=100):
    rows, v = [], start
    for i, n in enumerate(lens):
        ids = list(range(v, v + n)) if n else []
        v += n
        rows.append((src, i, ids))
    return spark.createDataFrame(rows, "src string, row_idx long, input_ids array<int>")


def _py_chunks(seqs, L, eos=2, min_len=128):
    flat = []
    for s in seqs:
        if not s:
            continue
        flat += s + ([] if s[-1] == eos else [eos])
    out = [flat[i:i + L] for i in range(0, len(flat), L)]
    return [c for c in out if len(c) >= min_len]


def test_concat_chunk_matches_python(spark):
    for lens, L in [([100, 0, 250, 150, 500, 200, 150, 400, 100], 256),
                    ([255, 255], 256),            # total (with EOS) an exact multiple of L
                    ([127, 255], 128),            # tails of 127/128
                    ([1000], 128), ([5], 512)]:
        df = _seqs(spark, lens)
        got = [r.input_ids for r in concat_and_chunk(df, L).orderBy("chunk_id").collect()]
        want = _py_chunks([list(r.input_ids) for r in df.orderBy("row_idx").collect()], L)
        assert got == want, (lens, L)


def test_concat_chunk_segments_are_independent(spark):
    df = _seqs(spark, [300, 300, 300, 300])
    out = concat_and_chunk(df, 256, segment_rows=2).groupBy("segment").agg(F.count("*").alias("n")).collect()
    assert {r.segment: r.n for r in out} == {0: 2, 1: 2}  # 602 tokens -> 2 full chunks + dropped tail each


def test_short_max_length_drops_everything(spark):
    assert concat_and_chunk(_seqs(spark, [500]), 100).count() == 0


def _py_next_fit(seqs, L, pad=0):
    out, cur = [], []
    for ids in seqs:
        if len(cur) + len(ids) <= L:
            cur += ids
        else:
            if cur:
                out.append(cur + [pad] * (L - len(cur)))
            cur = ids[:L]
    if cur:
        out.append(cur + [pad] * (L - len(cur)))
    return out


def test_next_fit_matches_python(spark):
    for lens in ([100, 250, 150, 500, 200, 150, 400, 100], [512, 1, 511, 513, 0, 3], [600], [0, 0]):
        df = _seqs(spark, lens)
        got = [r.input_ids for r in next_fit_pack(df, 512).orderBy("pack_id").collect()]
        want = _py_next_fit([list(r.input_ids) for r in df.orderBy("row_idx").collect()], 512)
        assert got == want, lens


def test_balanced_pack_fixture(spark):
    df = _seqs(spark, [100, 250, 150, 500, 200, 150, 400, 100])
    p = balanced_pack(df, 512).collect()
    assert len(p) == 4
    assert sum(r.n_tokens for r in p) == 1850
    assert all(r.n_tokens <= 512 and len(r.input_ids) == 512 for r in p)
    assert sorted(sorted(r.sequence_lengths) for r in p) == sorted([[500], [100, 400], [200, 250], [100, 150, 150]])


def test_collate(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [8]), (1, [9, 0])], "batch_id int, input_ids array<int>")
    r = {tuple(x.input_ids): x for x in collate(df).collect()}
    assert r[(8, 0, 0)].labels == [8, -100, -100] and r[(8, 0, 0)].attention_mask == [1, 0, 0]
    assert r[(9, 0)].labels == [9, -100]  # a real 0 is a pad to the collator too
    assert np.array_equal(r[(5, 6, 7)].attention_mask, [1, 1, 1])


def test_stream_shards_hold_the_packed_tokens(spark):
    texts = {i: f"{i:04d} é한 " + chr(97 + i % 26) * (200 + 37 * i % 900) for i in range(60)} | {60: "too short", 61: None}
    sf = tempfile.mkdtemp()
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], t) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(os.path.join(sf, "documents.parquet"))
    packed = qi.r04(spark, sf).collect()
    assert all(r.n_tokens == len(r.input_ids) == len(r.attention_mask) <= 2048 and set(r.attention_mask) == {1} for r in packed)
    assert len({r.batch_id for r in packed}) == 4
    of, found = {i: src for i, src, _ in rows}, []
    packed.sort(key=lambda r: (r.batch_id, r.src or "", r.segment, r.chunk_id))
    for (_, src), chunks in itertools.groupby(packed, lambda r: (r.batch_id, r.src)):
        chunks = list(chunks)
        assert [r.chunk_id for r in chunks] == list(range(len(chunks)))
        assert all(r.n_tokens == 2048 for r in chunks[:-1])
        ids = [x for r in chunks for x in r.input_ids]
        seqs = [[*y] for end, y in itertools.groupby(ids, lambda x: x == 2) if not end]
        docs = [int(bytes(x - 7 for x in s[1:5])) for s in seqs]
        assert docs == sorted(docs) and all(of[i] == src for i in docs)
        for s, i in zip(seqs, docs):
            want = [1] + [7 + x for x in texts[i].encode()]
            # whole, but for the last one, whose short tail isn't kept
            assert s == want or (i == docs[-1] and s == want[:len(s)] and len(want) - len(s) < 128)
        found += docs
    assert sorted(found) == list(range(60))
