"""EM and best paths against enumeration."""

import itertools
import math

import pytest

from textloom.operators import unigram as ug

TEXTS = ["the theory of the thing", "then there is the other thing", "a tether, a thistle; these things", "nation station ration"]


def paths(sym, scores):
    n = len(sym)
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        ps = ["".join(sym[a:b]) for a, b in zip(at, at[1:])]
        if all(p in scores for p in ps):
            yield ps


def test_forward_backward_and_best_path_by_enumeration():
    scores = {p: math.log(w) for p, w in {"t": .1, "h": .1, "e": .1, "th": .2, "he": .15, "the": .25, "a": .1, "tt": .05}.items()}
    for word in ("the", "thethe", "ttheat", "hhtteathe"):
        sym = list(word)
        all_ = list(paths(sym, scores))
        w = [math.exp(sum(scores[p] for p in ps)) for ps in all_]
        want = {}
        for ps, x in zip(all_, w):
            for p in ps:
                want[p] = want.get(p, 0) + x / sum(w)
        got = ug.expected_counts(sym, scores, 3)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        best = ug.best_path(sym, scores, 3, -20)
        assert abs(sum(scores[p] for p in best) - math.log(max(w))) < 1e-9 and "".join(best) == word
    assert ug.best_path(list("tzh"), scores, 3, -20) == ["t", "z", "h"]


def test_training_and_round_trip(spark):
    from textloom.functions.text import sp_normalize

    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "doc_id int, text string")
    m = ug.train_unigram(d, 320)
    rows = m.vocab.orderBy("id").collect()
    assert len(rows) <= 320 and [r.token for r in rows[:4]] == ug.CONTROL and [r.id for r in rows] == list(range(len(rows)))
    assert abs(sum(math.exp(r.score) for r in rows[4:]) - 1) < 1e-9
    assert any(len(r.token) > 2 and not r.token.startswith("<") for r in rows)
    new = spark.createDataFrame([(0, "the Thing\n漢 é"), (1, ""), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in ug.encode(new, m, ["doc_id"]).collect()}
    norm = {r.doc_id: r.t for r in new.select("doc_id", sp_normalize("text").alias("t")).collect()}
    text = b"".join(bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.encode() for p in got[0].pieces).decode()
    assert text.replace("▁", " ") == norm[0]
    assert got[1].input_ids == [1, 2] == got[2].input_ids and 3 not in got[0].input_ids
    with pytest.raises(ValueError):
        ug.train_unigram(d, 200)
    with pytest.raises(ValueError):
        ug.train_unigram(d, 320, preset="turbo")


def test_expected_counts_of_many_words_together_equal_enumeration():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    pool = [*"abc<0x41>", "<0x41>", "<0x42>"]
    for _ in range(8):
        pieces = {*rng.sample(pool, 8), *("".join(rng.choice(pool) for _ in range(rng.randint(2, 3))) for _ in range(12))}
        scores = {p: math.log(rng.random() + 1e-6) for p in pieces}
        words = [[], ["?", "a"], *([rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(40))]
        counts = np.array([rng.randint(1, 9) for _ in words])
        want: dict = {}
        for sym, c in zip(words, counts):
            all_ = list(paths(sym, scores)) if sym else []
            w = [math.exp(sum(scores[p] for p in ps)) for ps in all_]
            for ps, x in zip(all_, w):
                for p in ps:
                    want[p] = want.get(p, 0) + c * x / sum(w)
        trie = ug._Trie(scores)
        x, has = ug._expected(trie, pa.array(words, pa.list_(pa.string())), counts, 9)
        got = {p: v for p, v, h in zip(trie.pieces, x, has) if h and v}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-8 for p in want)
