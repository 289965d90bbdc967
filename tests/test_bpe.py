"""T01/T02/X06/X15/X16/J06/S16 on a small fixture, against brute force."""

import collections
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import bpe
from textloom.sources.files import read_tokenizer_json
from textloom.sources.sinks import write_tokenizer_json

TEXTS = ["the theory of the thing", "then there is the other thing", "a tether, a thistle; these things",
         "Ünïcödé text 한국어 テスト", "numbers 123 4567 and the end", "  leading spaces and\ttabs\n\nnew lines"]


def _corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id int, text string")


def _brute_force(words, n_merges, min_freq=2):
    """One merge at a time: highest count, then left, then right symbol."""
    words = [(list(s), c) for s, c in words]
    merges = []
    for _ in range(n_merges):
        pc = collections.Counter()
        for s, c in words:
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += c
        if not pc:
            break
        (a, b), cnt = min(pc.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        if cnt < min_freq:
            break
        merges.append((a, b))
        nw = []
        for s, c in words:
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            nw.append((out, c))
        words = nw
    return merges


@pytest.fixture(scope="module")
def model(spark):
    return bpe.train_bpe(_corpus(spark), vocab_size=300, batch=True)


def test_batch_equals_exact_equals_brute_force(spark, model):
    wt = bpe.words_table(_corpus(spark)).collect()
    brute = _brute_force([(r.symbols, r.cnt) for r in wt], 300 - 263)
    batch = [(r.l, r.r) for r in model.merges.orderBy("rank").collect()]
    exact = [(r.l, r.r) for r in bpe.train_bpe(_corpus(spark), vocab_size=300, batch=False).merges.orderBy("rank").collect()]
    assert batch == exact == brute


def test_vocab_layout_and_specials(spark, model):
    v = {r.token: r.id for r in model.vocab.collect()}
    assert [t for t, i in sorted(v.items(), key=lambda x: x[1])][:7] == bpe.SPECIAL_TOKENS
    assert len(v) == len(set(v.values())) and max(v.values()) == len(v) - 1
    rep = {r.token: (r.present, r.id_matches) for r in bpe.special_token_report(model.vocab).collect()}
    assert all(p and m for p, m in rep.values())


def test_encode_decode_roundtrip(spark, model):
    docs = _corpus(spark).withColumnRenamed("doc_id", "k")
    r = bpe.roundtrip_mismatches(docs, model, ["k"]).first()
    assert r.n_docs == len(TEXTS) * 3 and r.n_mismatch == 0
    enc = {x.k: x.input_ids for x in bpe.encode(docs, model, ["k"]).collect()}
    assert all(ids[0] == 1 and ids[-1] == 2 for ids in enc.values())
    # the distinct-word encoder agrees with a direct per-word BPE
    ranks = {(x.l, x.r): x.rank for x in model.merges.collect()}
    w = bpe.encode_words(spark.createDataFrame([(" the",), (" thing",)], "word string"), model).collect()
    for x in w:
        from textloom.functions.text import BYTE_DST
        syms = [BYTE_DST[b] for b in x.word.encode()]
        assert x.tokens == bpe._bpe_word(syms, ranks)


def test_extension_keeps_base(spark, model):
    more = spark.createDataFrame([(t.upper() + " extra words here",) for t in TEXTS] * 4, "text string")
    ext = bpe.extend_vocabulary(model, more, 420)
    base = {r.token: r.id for r in model.vocab.collect()}
    new = {r.token: r.id for r in ext.vocab.collect()}
    assert all(new[t] == i for t, i in base.items())
    assert len(new) <= 420 and sorted(new.values()) == list(range(len(new)))
    bm = [(r.l, r.r) for r in model.merges.orderBy("rank").collect()]
    em = [(r.l, r.r) for r in ext.merges.orderBy("rank").collect()]
    assert em[:len(bm)] == bm and len(set(em)) == len(em)
    assert all(a in new and b in new and a + b in new for a, b in em)
    with pytest.raises(ValueError):
        bpe.extend_vocabulary(model, more, 300)


def test_extension_adds_as_many_tokens_as_asked_for(spark, model):
    more = spark.createDataFrame([(t.upper() + " extra words here, " + t,) for t in TEXTS] * 4, "text string")
    base = {r.token for r in model.vocab.collect()}
    seeds = [(t,) for t in base if not t.startswith("<") and len(t) > 1]
    corpus = more.union(spark.createDataFrame(seeds, "text string"))
    brute = _brute_force([(r.symbols, r.cnt) for r in bpe.words_table(corpus).collect()], 1000)
    want = [t for t in dict.fromkeys(a + b for a, b in brute) if t not in base]
    assert 40 < len(want) < 600 and len({a + b for a, b in brute} & base) > 20
    base_merges = {(r.l, r.r) for r in model.merges.collect()}
    for size, kw in ((340, {}), (301, {}), (340, {"batch": False}), (340, {"proposed": 7}), (2000, {})):
        ext = bpe.extend_vocabulary(model, more, size, **kw)
        new = {r.token: r.id for r in ext.vocab.collect()}
        assert sorted(new.keys() - base, key=new.get) == want[:size - 300] and len(new) == min(size, 300 + len(want))
        vocab = set(new)
        admitted = [m for m in brute if m not in base_merges and {*m, m[0] + m[1]} <= vocab]
        got = [(r.l, r.r) for r in ext.merges.orderBy("rank").collect()][len(base_merges):]
        assert got == admitted[:len(got)] and {a + b for a, b in got} >= set(want[:size - 300])


def test_training_is_as_before_where_enough_is_new(spark, model):
    base = {r.token for r in model.vocab.collect()}
    plain = bpe.train_bpe(_corpus(spark), vocab_size=320)
    both = bpe.train_bpe(_corpus(spark), vocab_size=320, known=base, new=5)
    assert sorted(map(tuple, plain.merges.collect())) == sorted(map(tuple, both.merges.collect()))


def test_tokenizer_json_roundtrip(spark, model):
    path = os.path.join(tempfile.mkdtemp(), "tok.json")
    write_tokenizer_json(model.vocab, model.merges, path)
    v, m, info = read_tokenizer_json(spark, path)
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, model.vocab.collect()))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, model.merges.collect()))
    assert info.first().type == "BPE"


def test_tokenizer_object(spark, model):
    path = os.path.join(tempfile.mkdtemp(), "t", "tok.json")
    bpe.Tokenizer(model).save(path)
    t = bpe.Tokenizer.load(spark, path)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, "", None])], "k int, text string")
    got = {r.k: r.input_ids for r in t.encode(docs, ["k"]).collect()}
    assert got == {r.k: r.input_ids for r in bpe.encode(docs, model, ["k"]).collect()}
    assert got[len(TEXTS)] == got[len(TEXTS) + 1] == [1, 2]
    back = {r.k: r.text for r in t.decode(t.encode(docs, ["k"]), ["k"]).collect()}
    assert back[0] == " " + TEXTS[0] and back[len(TEXTS)] == ""
    short = {r.k: r.input_ids for r in t.encode(docs, ["k"], max_length=5).collect()}
    assert all(short[k] == (v if len(v) <= 5 else [1, *v[1:4], 2]) for k, v in got.items())


def test_accepted_sequences_equal_one_at_a_time():
    """The driver's rule with tasks played in memory: few followed pairs, few trial words, short sequences."""
    import random

    from textloom.operators import speculate as sp

    def count(words):
        c = collections.Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                c[p] += n
        return c

    for seed in range(400):
        rng = random.Random(seed)
        letters = "abcdefgh"[:rng.randint(2, 8)]
        words = [([rng.choice(letters) for _ in range(rng.randint(1, 9))], rng.choice([1, 1, 2, 5, rng.randint(1, 50)]))
                 for _ in range(rng.randint(1, 60))]
        n, followed, most, tried = rng.randint(1, 40), rng.choice([1, 3, 10, 1000]), rng.choice([1, 4, 50]), rng.choice([0, 3, 100])
        want, got, tokens, anew, counts, floor = _brute_force(words, n), [], set(letters), True, {}, 0
        trial = sp.Trial(sorted(words, key=lambda w: -w[1])[:tried])
        rounds = 0
        while len(got) < n:
            rounds += 1
            assert rounds < 500
            fresh = anew
            if anew:
                top = sorted(((p, c) for p, c in count(words).items() if c >= 2), key=lambda x: (-x[1], x[0]))[:followed]
                counts, floor = dict(top), top[-1][1] if len(top) == followed else 0
            if not counts:
                break
            sequence = trial.propose(counts, tokens, min(most, n - len(got)), floor)
            sums, new = collections.Counter(), {a + b for a, b in sequence}
            for s, c in words:
                for step, before, after in sp.in_order(s, {m: i for i, m in enumerate(sequence)}):
                    for symbols, d in ((before, -c), (after, c)):
                        for p in zip(symbols, symbols[1:]):
                            if p in counts or p[0] in new or p[1] in new:
                                sums[step, p] += d
            deltas, best = collections.defaultdict(list), collections.Counter()
            for (step, p), d in sums.items():
                best[p] = max(best[p], d)
            for (step, p), d in sums.items():
                if p in counts or best[p] > max(floor, 1):
                    deltas[step].append((p, d))
            chosen, anew = sp.accept(counts, sequence, deltas, tokens, floor, 2, fresh)
            if not chosen and not anew:
                break
            for l, r, _ in chosen:
                trial.merge((l, r))
                words = [(sp.merge_once(s, (l, r)), c) for s, c in words]
            got += [(l, r) for l, r, _ in chosen]
        assert got == want, seed


def test_training_in_several_rounds(spark):
    docs = _corpus(spark)
    want = [(r.l, r.r) for r in bpe.train_bpe(docs, vocab_size=330, batch=False).merges.orderBy("rank").collect()]
    m = bpe.train_bpe(docs, vocab_size=330, followed=40, proposed=16, tried=5, checkpoint_every=10)
    assert [(r.l, r.r) for r in m.merges.orderBy("rank").collect()] == want
    m = bpe.train_bpe(docs, vocab_size=330, proposed=16)
    assert [(r.l, r.r) for r in m.merges.orderBy("rank").collect()] == want and m.rounds < 10


def test_curriculum_keeps_every_stage(spark, model):
    more = spark.createDataFrame([(t.upper() + " extra words here",) for t in TEXTS] * 4, "text string")
    a, b = bpe.curriculum(model, [more, more], [520, 530])
    v0, v1, v2 = ({r.token: r.id for r in m.vocab.collect()} for m in (model, a, b))
    assert len(v0) < len(v1) <= 520 and len(v1) <= len(v2) <= 530
    assert all(v1[t] == i for t, i in v0.items()) and all(v2[t] == i for t, i in v1.items())


def test_presets_and_long_lines(spark):
    with pytest.raises(ValueError):
        bpe.train_bpe(_corpus(spark), vocab_size=300, preset="ultrafast")
    long = "word " * 5000
    d = spark.createDataFrame([(TEXTS[0] + "\n" + long + "\n\tx",)], "text string")
    r = bpe.sentence_report(d).first()
    assert (r.n_lines, r.n_chars, r.n_long_lines, r.n_long_chars) == (3, len(TEXTS[0]) + len(long) + 2, 1, len(long))
    kept = {x.word: x.cnt for x in bpe.sp_words_table(d)[0].collect()}
    assert kept["▁word"] == 5000 and kept["▁x"] == 1
    assert "▁word" not in {x.word for x in bpe.sp_words_table(d, long_lines="skip")[0].collect()}


def test_driver_gets_no_more_than_it_keeps(spark):
    from pyspark.sql import functions as F

    from textloom.operators import speculate as sp

    rows = [(f"w{i}", [f"s{i}", f"s{i % 7}"], i % 97 + 1) for i in range(4000)]
    words = spark.createDataFrame(rows, "word string, symbols array<string>, cnt long").repartition(40)
    got = sp.frequent(words, 200)
    assert 0 < len(got) <= 200 + 40 and min(c for _, c in got) > 80
    pairs = spark.createDataFrame([(a, b, c) for _, (a, b), c in rows], "l string, r string, cnt long")
    counts, floor = sp.leading(pairs, 300)
    assert len(counts) <= 600 + sp.BUCKETS
    assert {p: c for p, c in counts.items() if c > floor} == {(a, b): c for _, (a, b), c in rows if c > floor}
    assert max(counts.items(), key=lambda x: x[1])[1] == 97
    assert sp.leading(pairs.where(F.lit(False)), 300) == ({}, 0) and sp.leading(pairs, 10_000)[1] == 0


def test_merges_of_a_batch_equal_word_by_word():
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.operators import speculate as sp

    for seed in range(200):
        rng = random.Random(seed)
        words = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], rng.randint(1, 9)) for _ in range(rng.randint(0, 20))]
        names: dict = {}
        w = sp._Words(pa.array([s for s, _ in words], pa.list_(pa.string())), np.array([c for _, c in words], np.int64), names)
        for pair in [("a", "a"), ("a", "b"), ("aa", "aa"), ("ab", "c"), ("c", "c"), ("aa", "a")]:
            before, got = collections.Counter(), collections.Counter()
            for s, c in words:
                for p in zip(s, s[1:]):
                    before[p] -= c
            words = [(sp.merge_once(s, pair), c) for s, c in words]
            for s, c in words:
                for p in zip(s, s[1:]):
                    before[p] += c
            text = list(names)
            for x, y, d in w.merge(pair, True):
                text = list(names)
                for i, j, n in zip(x.tolist(), y.tolist(), d.tolist()):
                    got[text[i], text[j]] += n
            assert {p: n for p, n in got.items() if n} == {p: n for p, n in before.items() if n}
            text = list(names)
            flat = [text[i] if i >= 0 else None for i in w.of.tolist()]
            assert flat == [None] + [x for s, _ in words for x in [*s, None]]


def test_words_keep_their_symbols_through_many_merges():
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.operators import speculate as sp

    for seed in range(100):
        rng = random.Random(seed)
        words = [[rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 20))]
        merges = [("a", "a"), ("a", "b"), ("b", "ab"), ("ab", "ab"), ("aa", "b"), ("bab", "c"), ("abab", "abab"), ("c", "ab"), ("ab", "c")]
        rng.shuffle(merges)
        w = sp.merged(pa.array(words, pa.list_(pa.string())), pa.array([1] * len(words), pa.int64()), {}, merges)
        apart = w.copy()
        assert apart.merge(("c", "c"), False) == [] and len(apart.of) <= len(w.of)
        for m in merges:
            words = [sp.merge_once(s, m) for s in words]
        assert w.symbols().to_pylist() == words


def test_changes_told_by_tasks_order_the_next_round(spark):
    """Trial words that know nothing of the others: what all words told in one round leads the next."""
    import random

    rng = random.Random(7)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    rows = [("".join(rng.choices(syllables, weights=range(1, 71), k=rng.randint(1, 5))),) for _ in range(4000)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    want = _brute_force([(r.symbols, r.cnt) for r in bpe.words_table(docs).collect()], 360 - 263)
    m = bpe.train_bpe(docs, vocab_size=360, tried=30)
    assert [(r.l, r.r) for r in m.merges.orderBy("rank").collect()] == want and m.rounds <= 15, m.rounds


def test_followed_pairs_keep_to_their_bound():
    from textloom.operators import speculate as sp

    counts = {("a", str(i)): i for i in range(1, 101)}
    kept, floor = sp.followed_only(counts, 0, 10)
    assert kept == {p: c for p, c in counts.items() if c > floor} and 0 < len(kept) <= 10
    assert sp.followed_only(dict.fromkeys(counts, 5), 2, 10) == (dict.fromkeys(counts, 5), 2)
    assert sp.followed_only(counts, 3, 100) == (counts, 3)


def test_told_changes_order_proposals():
    from textloom.operators import speculate as sp

    counts = {("a", "b"): 10, ("c", "d"): 9, ("e", "f"): 8}
    trial = sp.Trial([(["a", "b"], 1), (["c", "d"], 1)])
    told = {("a", "b"): [(("a", "b"), -10), (("c", "d"), -5), (("ab", "e"), 6)]}
    assert trial.propose(counts, set("abcdef"), 9, 0, told)[:4] == [("a", "b"), ("e", "f"), ("ab", "e"), ("c", "d")]
    assert trial.propose(counts, set("abcdef"), 9, 0)[:2] == [("a", "b"), ("c", "d")]


def test_sequences_of_ids_equal_lists_and_take_little_more_than_themselves():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    plain = {f"w{i}": [rng.randrange(7, 300) for _ in range(rng.randint(0, 5))] for i in range(50)}
    known = {w: np.array(x, np.int32) for w, x in plain.items()}
    texts = [None, []] + [[rng.choice(list(plain)) for _ in range(rng.randint(0, 30))] for _ in range(40)] + [None]
    held = pa.array(texts, pa.list_(pa.string()))
    for room in (None, 0, 1, 7, 1000):
        for specials in (True, False):
            want = [[i for w in t or () for i in plain[w]][:room] for t in texts]
            want = [[1, *x, 2] if specials else x for x in want]
            assert bpe._sequences(held, known, room, specials).to_pylist() == want
            assert bpe._sequences(held.slice(3, 9), known, room, specials).to_pylist() == want[3:12]
    assert bpe._sequences(held.slice(0, 1), known, None, True).to_pylist() == [[1, 2]]
    assert bpe._sequences(held.slice(0, 0), known, None, True).to_pylist() == []
    many = pa.array([[rng.choice(list(plain)) for _ in range(400)] for _ in range(bpe.TEXTS_HELD)], pa.list_(pa.string()))
    tracemalloc.start()
    out = bpe._sequences(many, known, None, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * out.nbytes and peak < 16 << 20  # for a batch of 10,000 texts it was some hundred MB


def test_words_merged_together_equal_one_at_a_time():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé \0") for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for _ in range(30):
        symbols = [bpe.BYTE_DST[x] for x in "abcdé \0".encode()]
        ranks = {}
        for i in range(25):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair[0] + pair[1] not in symbols:
                ranks[pair] = i
                symbols.append(pair[0] + pair[1])
        assert bpe.in_rank_order(ranks)
        ids = {t: i for i, t in enumerate(symbols[2:], 10)}  # some are unknown
        want = [[ids.get(t, bpe.UNK_ID) for t in bpe._bpe_word([bpe.BYTE_DST[x] for x in w.encode()], ranks)] for w in words]
        assert [x.tolist() for x in bpe._merged_ids(words, sorted(ranks, key=ranks.get), ids)] == want
    assert not bpe.in_rank_order({("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("a", "bc"): 3})  # abc twice
    assert not bpe.in_rank_order({("ab", "c"): 0, ("a", "b"): 1})
    assert bpe.in_rank_order({})


def test_encoding_is_the_same_however_few_words_are_remembered(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"the thing {i % 7} is {'the' * (i % 5)} other thistle {i}") for i in range(60)] + [(99, None), (100, "")],
                              "doc_id int, text string").coalesce(2)
    m = bpe.train_bpe(d, vocab_size=290)
    want = {r.doc_id: r.input_ids for r in bpe.encode(d, m, ["doc_id"]).collect()}
    monkeypatch.setattr(bpe, "WORDS_HELD", 5)
    monkeypatch.setattr(bpe, "TEXTS_MET", 7)
    monkeypatch.setattr(bpe, "TEXTS_HELD", 3)
    assert {r.doc_id: r.input_ids for r in bpe.encode(d, m, ["doc_id"]).collect()} == want
    ranks, ids = bpe._tables(m).value
    for r in bpe.words_table(d).collect():
        assert bpe._merged_ids([r.word], sorted(ranks, key=ranks.get), ids)[0].tolist() == [ids[t] for t in bpe._bpe_word(r.symbols, ranks)]


def test_sp_words_are_read_once_by_stretch_and_stay_those_of_the_lines(spark, monkeypatch):
    from textloom.functions.text import sp_normalize, sp_pretokens
    rng = random.Random(20)
    odd = "ab Z  1\t\u00a0\u3000\u2003\u0085\u00a8\u0301\u0300\u0327e\ufb01\u00b4▁ .!\u1100\u1161\u11a8한かｶﾞЯßς\U0001f600\u200d\r\x0b\n"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", " ", None, "\u0301a \u0301b", " \u00a8 "]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    lines = bpe.sentences(d).select(F.explode(sp_pretokens(sp_normalize(F.col("line")))).alias("word"))
    expected = {r.word: r["count"] for r in lines.groupBy("word").count().collect()}
    assert {r.word: r.cnt for r in bpe.sp_words_table(d)[0].collect()} == expected

    calls = spark.sparkContext.accumulator(0)

    def counted(col):
        @F.udf("string")
        def seen(t):
            calls.add(1)
            return t
        return sp_normalize(seen(col))

    monkeypatch.setattr(bpe, "sp_normalize", counted)
    words, _ = bpe.sp_words_table(spark.createDataFrame([("the cat the mat",)] * 200, "text string"))
    assert {r.word: r.cnt for r in words.collect()} == {"▁the": 400, "▁cat": 200, "▁mat": 200}
    assert calls.value <= 3  # distinct stretches, not 200 lines
