import hashlib
from collections import Counter

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import exact_dedup as X


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check(rows, got):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256(norm(t).encode()).digest(), []).append(i)
    order = lambda i: (i is not None, i or 0)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        g = groups[bytes(r.digest)]
        assert r.keep_id == max(g, key=order) and r.group_size == len(g)
        assert not r.kept or r.doc_id == r.keep_id
        kept[bytes(r.digest)] += r.kept
    assert set(kept) == set(groups) and set(kept.values()) == {1}


def test_heavy_and_light_groups(spark):
    rows = [(i, "Hot text") for i in range(300)] + [(1000 + i, f"Text {i % 200} É") for i in range(500)] + [
        (2000 + i, f"TEXT {i} é") for i in range(50)]
    d = docs(spark, rows)
    heavy = {bytes(r.tl_digest) for r in X.heavy_digests(X.digests(d), 0.05).collect()}
    assert hashlib.sha256(b"hot text").digest() in heavy and len(heavy) <= 20
    check(rows, X.judge(d, support=0.05).collect())
    check(rows, X.judge(d).collect())


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD))
    check(AWKWARD, X.judge(d).collect())
    kept = X.dedup(d)
    assert kept.columns == d.columns
    assert kept.count() == len({norm(r[1]) for r in AWKWARD})
    assert X.judge(d.limit(0)).count() == 0
