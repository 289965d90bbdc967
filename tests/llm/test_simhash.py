import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import simhash as S


def brute_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < k else [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "É É é", "a b c", "a b c d", "a b c d\x1ce"]
    texts += [" ".join(rng.choice("AbC dé".split()) + str(rng.randrange(50)) for _ in range(rng.randint(3, 400))) for _ in range(30)]
    assert [S.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def roots(fps, links):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def brute_links(fps, radius):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]


def clusters(rng, centres, members, spread):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        bits = rng.sample(range(64), spread)
        for _ in range(members):
            out.add(c ^ sum(1 << b for b in bits if rng.random() < 0.3))
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_have_the_components_of_all_pairs(spark, radius):
    rng = random.Random(radius)
    fps = clusters(rng, 20, 12, 9) + [rng.getrandbits(64) for _ in range(60)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(df, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in got)
    assert roots(fps, got) == roots(fps, brute_links(fps, radius))


@pytest.mark.parametrize("seed", range(6))
def test_long_runs_need_no_pairs(monkeypatch, seed):
    monkeypatch.setattr(S, "SMALL_RUN", 2)
    rng = random.Random(seed)
    lo, hi = S.BLOCKS[seed % 3]
    # many members close together, some only differing by three bits of one block
    base = rng.getrandbits(64)
    fps = clusters(rng, 2, 60, 8) + [base ^ sum(1 << b for b in rng.sample(range(lo, hi), 3)) for _ in range(40)] + [base]
    fps = sorted(set(fps))
    masks = S._masks()
    runs = {}
    for f in fps:
        for j, m in enumerate(masks):
            v = f & ~int(m) & ((1 << 64) - 1)
            for key in [v] + [v ^ (1 << i) for i in range(64) if not int(m) >> i & 1]:
                runs.setdefault((j, key), []).append(f)
    got = [p for (j, key), fs in runs.items() for p in S._links_of_run(np.array(fs, np.uint64), j, np.uint64(key), 3)]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert roots(fps, got) == roots(fps, brute_links(fps, 3))


def test_classes_and_kept_documents(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(6)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(i, t.replace(t.split()[7], "changed", 1)) for i, t in enumerate(base[:3])] + [(50, base[4]), (51, base[4].upper())]
    d = docs(spark, rows)
    fps = {i: brute_fingerprint(t) for i, t in rows}
    of = roots(sorted(set(fps.values())), brute_links(sorted(set(fps.values())), 3))
    low = {}
    for i in sorted(fps):
        low.setdefault(of[fps[i]], i)
    got = {r.doc_id: r.component_id for r in S.classes(d).collect()}
    assert got == {i: low[of[f]] for i, f in fps.items()}
    assert got[50] == got[51] == got[104] == 50
    assert sorted(r.doc_id for r in S.keep_one(d).collect()) == sorted(set(got.values()))


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD))
    rows = S.classes(d).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.fp == 0} == {1}  # null, empty and blank texts link like any other
    kept = S.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert S.classes(d.limit(0)).count() == 0 and S.keep_one(d.limit(0)).count() == 0
