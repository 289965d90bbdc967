import random
import re
from collections import Counter

from tests.conftest import SF001
from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import phrases as P
from textloom.llm.queries import QUERIES
from textloom.sources.tables import table


def brute(rows, min_count=30, top=2000):
    """(lang, text) rows -> the mined rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    dropped = set()
    for (lang, w), c in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                if 100 * c >= 80 * cand[part]:
                    dropped.add(part)
    out = []
    for lang in n:
        rows = []
        for (own, w), a in cand.items():
            if own != lang or (own, w) in dropped:
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = f[own, w[:k]], f[own, w[k:]]
                cuts.append((2000000 * a // (left + right), k, left, right))
            s, _, left, right = min(cuts)
            rows.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(rng, n, vocabulary=40):
    passage = " ".join(f"p{i}" for i in range(30))  # a long unary path
    rows = []
    for i in range(n):
        w = [rng.choice(["A", "b", "É"]) + str(int(rng.paretovariate(0.7)) % vocabulary) for _ in range(rng.randint(0, 60))]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for x in w)
        if i % 5 == 0:
            text += " " + passage + rng.choice(["", ".", " tail", "! again " + passage])
        rows.append((i, text, "s", rng.choice(["en", "en", None, "fr"])))
    return rows


def test_random_corpora_equal_brute_force(spark):
    for seed, least, top in ((1, 3, 2000), (2, 8, 25)):
        rows = corpus(random.Random(seed), 150)
        df = with_clashes(docs(spark, rows)).repartition(5)
        assert got(P.mine(df, min_count=least, top=top)) == brute([(r[3], r[1]) for r in rows], least, top)


def test_paths_are_compacted(spark):
    rows = [(i, " ".join(f"p{j}" for j in range(50)), "s", "en") for i in range(6)]
    texts = P._texts(docs(spark, rows), "lang", "text")
    frequent, salt = P.numbered(P.vocabulary(texts), 3)
    counts = P.flows(P.edges(texts, frequent, salt), 3)
    paths = P.compact(counts.where("h4 <> 0"), counts.where("h3 <> 0 AND h4 = 0").drop("h4")).collect()
    assert [(len(p.words), p.f) for p in paths] == [(50, 6)]


def test_numbers_by_a_join_are_the_same(spark, monkeypatch):
    rows = corpus(random.Random(4), 60)
    want = brute([(r[3], r[1]) for r in rows], 3)
    assert got(P.mine(docs(spark, rows), 3, max_words=0)) == want and len(want) > 20
    monkeypatch.setattr(P, "HELD", 5)
    monkeypatch.setattr(P, "COMBINE", 50)
    assert got(P.mine(docs(spark, rows), 3)) == want


def test_large_counts_stay_exact(spark):
    big = 9_000_000_000_000_000_000 // 3
    counts = spark.createDataFrame([(1, 2, 0, 0, big), (1, 0, 0, 0, big + 1), (2, 0, 0, 0, big + 7)], "h1 long, h2 long, h3 long, h4 long, f long")
    cand = spark.createDataFrame([(1, 2, 0, 0, 2, big)], "h1 long, h2 long, h3 long, h4 long, length int, a long")
    r = P._scored(cand, counts).first()
    assert (r.l, r.r, r.score) == (big + 1, big + 7, 2000000 * big // (2 * big + 8))


def test_awkward_rows_and_empty_table(spark):
    df = with_clashes(docs(spark, AWKWARD))
    want = brute([(r[3] if len(r) > 3 else "en", r[1]) for r in AWKWARD], 30)
    assert got(P.mine(df)) == want and any(r[2] == "lang lang lang lang" for r in want)
    assert P.mine(df.limit(0)).count() == 0
    assert P.mine(docs(spark, [(1, None), (2, " .,;")])).count() == 0


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF001, "documents").select("lang", "text").collect()]
    assert got(QUERIES["op13_phrase_collocations"][0](spark, SF001)) == brute(rows)
