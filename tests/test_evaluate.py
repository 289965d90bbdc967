"""E01/E02 windows and the bigram scorer."""

import math

from pyspark.sql import functions as F

import pytest

from textloom.operators import evaluate as ev


def _ref_windows(n, mx, s):
    out = []
    for b in range(0, n, s):
        e = min(b + mx, n)
        out.append((b, e))
        if e == n:
            break
    return out


def test_stride_windows(spark):
    ns = [5000, 1, 300, 2048, 2049, 511, 512, 513]
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    got = {r.n: [(w.begin, w.end) for w in r.w] for r in df.select("n", ev.stride_windows("n", 2048, 512).alias("w")).collect()}
    for n in ns:
        assert got[n] == _ref_windows(n, 2048, 512), n
    assert got[5000][-1] == (3072, 5000) and len(got[5000]) == 7


def _py_ppl(seqs, nll_fn, mx, s, mode):
    tot, cnt = 0.0, 0
    for ids in seqs:
        n = len(ids)
        if mode == "reference":
            for b, e in _ref_windows(n, mx, s):
                ls = [nll_fn(ids[j - 1], ids[j]) for j in range(b + 1, e)]
                if ls:
                    tot += sum(ls) / len(ls) * (e - b)
                    cnt += e - b
        else:
            for i in range(0, n, s):
                e = min(i + s, n)
                ls = [nll_fn(ids[j - 1], ids[j]) for j in range(max(i, 1), e)]
                if ls:
                    tot += sum(ls) / len(ls) * (e - i)
            cnt += n
    return math.exp(tot / cnt)


def test_perplexity_modes_match_python(spark):
    train = [[1, 5, 6, 5, 6, 7, 2], [1, 6, 5, 2]]
    evals = [[1, 5, 6, 7, 5, 6, 5, 6, 6, 2], [1, 7, 7, 2], list(range(1, 40)) + [2]]
    V, k = 50, 1.0
    from collections import Counter
    c2 = Counter((a, b) for s in train for a, b in zip(s, s[1:]))
    c1 = Counter(a for s in train for a in s[:-1])

    def nll(a, b):
        return -math.log((c2.get((a, b), 0) + k) / (c1.get(a, 0) + k * V))

    tr = spark.createDataFrame([(s,) for s in train], "input_ids array<int>")
    ev_df = spark.createDataFrame([(i, s) for i, s in enumerate(evals)], "doc_id int, input_ids array<int>")
    scorer = ev.bigram_scorer(ev.ngram_counts(tr), V, k)
    for mx, stride in ((8, 3), (5, 1), (100, 50)):
        for mode in ("reference", "standard"):
            w = ev.score_windows(ev_df, scorer, ["doc_id"], mx, stride, mode)
            got = ev.perplexity(w, ["doc_id"], mode).first().perplexity
            assert abs(got - _py_ppl(evals, nll, mx, stride, mode)) < 1e-5, (mode, mx, stride)
    per = {r.doc_id: r.perplexity for r in ev.per_text_perplexity(ev_df, scorer, ["doc_id"]).collect()}
    for i, s in enumerate(evals):
        want = math.exp(sum(nll(a, b) for a, b in zip(s, s[1:])) / (len(s) - 1))
        assert abs(per[i] - want) < 1e-5

    # the model as tables: same windows, whole and with sequences cut into slices
    model = ev.bigram_model(ev.ngram_counts(tr), V, k)
    for mx, stride, mode, block in ((8, 3, "reference", 7), (5, 1, "reference", 3), (8, 3, "standard", 4),
                                    (100, 50, "reference", 1 << 20), (1 << 62, 1 << 62, "reference", 5)):
        want = sorted(map(tuple, ev.score_windows(ev_df, scorer, ["doc_id"], mx, stride, mode).collect()))
        got = sorted(map(tuple, ev._score_by_shuffle(ev_df, model, ["doc_id"], mx, stride, mode, "input_ids", block).collect()))
        assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
        assert all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want))
    with pytest.raises(ValueError):
        ev.bigram_scorer(ev.ngram_counts(tr), 64_000)


def test_a_users_scorer_and_short_sequences(spark):
    import numpy as np

    seqs = spark.createDataFrame([(0, []), (1, [3]), (2, [3, 4, 5]), (3, None)], "doc_id int, input_ids array<int>")
    rows = ev.score_windows(seqs, lambda ids: np.asarray(ids[1:], float), ["doc_id"], 2, 1).collect()
    assert [(r.doc_id, r.begin, r.end, r.loss, r.trg_len) for r in rows] == [(2, 0, 2, 4.0, 2), (2, 1, 3, 5.0, 2)]
    for build in (ev.bigram_scorer, ev.bigram_model):
        empty = build(ev.ngram_counts(seqs.limit(0)), 50)
        assert abs(ev.per_text_perplexity(seqs, empty, ["doc_id"]).first().perplexity - 50) < 1e-6
        assert ev.score_windows(seqs.limit(0), empty, ["doc_id"]).count() == 0
        # rows of one key, or none, keep their own windows
        twice = seqs.unionAll(seqs).selectExpr("nullif(doc_id, 2) AS doc_id", "input_ids")
        assert [tuple(r)[:4] for r in ev.score_windows(twice, empty, ["doc_id"]).collect()] == [(None, 3, 0, 3)] * 2
