import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit(rng, s, n, alphabet="abcd "):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        r = rng.random()
        s = s[:i] + rng.choice(alphabet) + s[i:] if r < 0.35 else s[:i] + s[i + 1:] if r < 0.65 else s[:i] + rng.choice(alphabet) + s[i + 1:]
    return s


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(1)
    pairs, want = [], []
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        b = edit(rng, a, rng.randint(0, 4), "ab") if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        k = rng.randint(0, 2)
        pairs.append((L._codes(a), L._codes(b), k))
        want.append(distance(a, b) <= k)
    assert L.within_edits(pairs).tolist() == want
    # without trimming, the band alone
    cores = [(min(p[:2], key=len), max(p[:2], key=len), p[2]) for p in pairs
             if 0 < min(len(p[0]), len(p[1])) and abs(len(p[0]) - len(p[1])) <= p[2]]
    text = lambda x: "".join(map(chr, x))
    assert L._banded(cores).tolist() == [distance(text(a), text(b)) <= k for a, b, k in cores]


@pytest.mark.parametrize("make", [L.coarse_signatures, L.fine_signatures])
def test_signatures_lose_no_pair(make):
    rng = random.Random(2)
    lines = []
    for _ in range(120):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(10, 60)))
        lines += [base] + [edit(rng, base, rng.randint(0, 2)) for _ in range(4)]
    lines = sorted({x for x in lines if len(x) >= 10})
    sig, who = make(lines)
    indexed, probes = {}, {}
    for s, w in zip(sig.tolist(), who.tolist()):
        (probes if s & 1 else indexed).setdefault(s >> 1, set()).add(w)
    met = {frozenset((a, b)) for s, xs in indexed.items() for a in xs for b in probes.get(s, set()) | xs if a != b}
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if distance(lines[i], lines[j]) <=
             L.edits_allowed(min(len(lines[i]), len(lines[j])))]
    assert len(pairs) > 300
    assert all(frozenset(p) in met for p in pairs)


def test_large_set_goes_through_fine_signatures_and_loses_nothing():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(90))
    lines = sorted({edit(rng, base, rng.randint(1, 4), "xyz") for _ in range(150)})
    keys = [f"{i:04d}" for i in range(len(lines))]
    i, j = L._set_pairs(lines, False)
    near = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if distance(lines[a], lines[b]) <= 2}
    assert near <= set(zip(i.tolist(), j.tolist()))
    assert len(lines) > L.PLAIN_SET
    links = L._links_in_sets([(keys, lines, False)])
    assert len(links) < len(lines)  # a forest
    assert partition(links, keys) == partition([(keys[a], keys[b]) for a, b in near], keys)


def partition(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def brute(rows):
    """doc -> dropped line numbers, by comparing all lines with a word."""
    occ = sorted((d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r"))
    lines = sorted({x for _, _, x in occ})
    links = [(a, b) for a in lines for b in lines if a < b and distance(a, b) <= L.edits_allowed(min(len(a), len(b)))]
    of = partition(links, lines)
    first, out = {}, {d: [] for d, _ in rows}
    for d, i, x in occ:
        if first.setdefault(of[x], (d, i)) != (d, i):
            out[d].append(i)
    return out


@pytest.mark.parametrize("giant", [False, True])
def test_against_brute_force(spark, monkeypatch, giant):
    if giant:
        monkeypatch.setattr(L, "GIANT", 3)
        monkeypatch.setattr(L, "PLAIN_SET", 2)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(3, 60))).strip() or "z" for _ in range(25)]
    rows = [(d, "\n".join(edit(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 5))))
            for d in range(40)]
    rows = [(d, t) for d, t in rows]
    got = {r.doc_id: list(r.dropped) for r in L.decide(docs(spark, rows)).collect()}
    assert got == brute(rows)
    texts = {r.doc_id: r.text for r in L.dedup_lines(docs(spark, rows)).collect()}
    assert texts == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[d]) for d, t in rows}


def test_large_runs_hang_on_variants_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(L, "PLAIN_SET", 2)
    monkeypatch.setattr(L, "RUN", 3)
    rng = random.Random(9)
    for _ in range(30):
        base = "".join(rng.choice("ab ") for _ in range(rng.choice([12, 16, 19, 20, 22, 30, 45])))
        lines = sorted({x for x in (edit(rng, base, rng.randint(0, 4), "ab") for _ in range(60)) if len(x) >= 10})
        keys = [f"{i:04d}" for i in range(len(lines))]
        near = [(x, y) for i, x in enumerate(keys) for j, y in enumerate(keys[:i])
                if distance(lines[i], lines[j]) <= L.edits_allowed(min(len(lines[i]), len(lines[j])))]
        assert partition(L._links_in_sets([(keys, lines, False)]), keys) == partition(near, keys)


def test_large_runs_across_tasks_against_brute_force(spark, monkeypatch):
    for name, value in (("GIANT", 3), ("PLAIN_SET", 2), ("RUN", 1)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab ") for _ in range(n)).strip() or "z" for n in (12, 19, 21, 30, 50)]
    rows = [(d, "\n".join(edit(rng, rng.choice(pool), rng.randint(0, 4), "ab") for _ in range(4))) for d in range(40)]
    assert {r.doc_id: list(r.dropped) for r in L.decide(docs(spark, rows)).collect()} == brute(rows)


def test_fifty_thousand_lines_that_differ_in_one_number(spark):
    numbers = [f"{k:08d}" for k in random.Random(6).sample(range(10**8), 50_000)]
    line = "Your order number {} has been shipped to the address on file, thank you."
    groups = {}
    for k in numbers:  # two digits replaced, or one taken out and one put in: the same key
        for i in range(8):
            groups.setdefault(k[:i] + k[i + 1:], []).append(k)
            for j in range(i):
                groups.setdefault((j, i, k[:j] + k[j + 1:i] + k[i + 1:]), []).append(k)
    want = partition([(g[0], x) for g in groups.values() for x in g[1:] if x != g[0]], numbers)
    rows = [(d, "\n".join(line.format(k) for k in numbers[d:d + 50])) for d in range(0, 50_000, 50)]
    got = L.similar_lines(docs(spark, rows).repartition(4))
    assert got.count() == got.select("node").distinct().count()
    size = {}
    for r in want.values():
        size[r] = size.get(r, 0) + 1
    assert sorted(r["count"] for r in got.groupBy("root").count().collect()) == sorted(n for n in size.values() if n > 1)


@pytest.mark.parametrize("short", [2, 4, 24])
def test_parts_are_split_again_and_lose_nothing(monkeypatch, short):
    for name, value in (("PLAIN_SET", 2), ("RUN", 3), ("SHORT", short)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(11)
    links = 0
    for _ in range(8):
        base = "".join(rng.choice("ab ") for _ in range(rng.choice([12, 19, 20, 22, 30, 45, 80, 150])))
        c = rng.randrange(len(base))
        lines = sorted({x for x in (edit(rng, base[:c] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + base[c + 2:],
                                         rng.randint(0, 3), "ab") for _ in range(60)) if len(x) >= 10})
        keys = [f"{i:04d}" for i in range(len(lines))]
        pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
        near = L.within_edits([(L._codes(lines[i]), L._codes(lines[j]), int(L.edits_allowed(min(len(lines[i]), len(lines[j])))))
                               for i, j in pairs])  # against the plain distance above
        near = [(keys[i], keys[j]) for (i, j), ok in zip(pairs, near) if ok]
        links += len(near)
        assert partition(L._links_in_sets([(keys, lines, False)]), keys) == partition(near, keys)
    assert links > 500


@pytest.mark.parametrize("short", [2, 24])
def test_finer_rounds_across_tasks_against_brute_force(spark, monkeypatch, short):
    for name, value in (("GIANT", 3), ("PLAIN_SET", 2), ("RUN", 1), ("SHORT", short)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(12)
    pool = ["".join(rng.choice("ab ") for _ in range(n)).strip() or "z" for n in (21, 50, 90)]
    rows = [(d, "\n".join(edit(rng, rng.choice(pool), rng.randint(0, 4), "ab") for _ in range(3))) for d in range(30)]
    assert {r.doc_id: list(r.dropped) for r in L.decide(docs(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("n", [300, 20_000])
def test_long_lines_that_differ_in_one_sixth(spark, n):
    """Documents of one line of 2,400 code points and one template; every hundredth has a copy with a letter less."""
    base = "".join(random.Random(13).choice("abcdefghij ") for _ in range(2_000))
    part = F.substring(F.concat(*[F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{i}"))) for i in range(13)]), 1, 400)
    d = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit(base[:900]), part, F.lit(base[900:])).alias("text"))
    copies = d.where("doc_id % 100 = 0").select((F.col("doc_id") + n).alias("doc_id"), F.expr(
        "concat(substring(text, 1, 1100), substring(text, 1102, 1300))").alias("text"))
    got = {r.doc_id for r in L.decide(d.union(copies)).where("size(dropped) > 0").collect()}
    assert got == {i + n for i in range(0, n, 100)}


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD))
    out = L.dedup_lines(d)
    assert out.columns == d.columns
    rows = out.collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 5)}
    assert by[1] is None and by[2] == "" and by[4] == " \t\n " and by[9] == "x\ny\n" and by[7] == "lang " * 30_000
    # null comes first, so its "one" stays and the repeated row loses it in both copies
    assert sorted((r.text or "") for r in rows if r.doc_id in (None, 5)) == ["", "", "", "one"]
    assert L.dedup_lines(d.limit(0)).count() == 0
