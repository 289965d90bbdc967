import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import mixing as M


@pytest.mark.parametrize("rate", [0.0, 0.05, 1.0, 7.5, 900.0])
def test_poisson_steps(spark, rate):
    steps = spark.range(1).select(M.poisson_steps(F.lit(rate)).alias("s")).first().s
    total = 0.0
    for k, s in enumerate(steps):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        assert abs(s - total) < 1e-9
    assert abs(steps[-1] - 1) < 1e-9


@pytest.mark.parametrize("rate", [0.0, 3.0, 250.0, 600.0, 30_000.0, 1_000_000.0])
def test_steps_of_large_rates(spark, rate):
    got = spark.range(1).select(M.first_step(F.lit(rate)).alias("f")).select(
        "f", M.poisson_steps(F.lit(rate), F.col("f")).alias("s")).first()
    assert len(got.s) <= 24 * math.sqrt(rate) + 200 and got.f <= rate
    total = 0.0
    for k, s in enumerate(got.s, got.f):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        assert abs(s - total) < 1e-7
    assert got.s[0] < 1e-25 or got.f == 0
    assert abs(got.s[-1] - 1) < 1e-7


def test_a_tiny_source_among_large_ones(spark):
    d = docs(spark, [(i, "x" * 2000, "big") for i in range(500)] + [(900 + i, "y" * 9, "tiny") for i in range(4)])
    n = {r.doc_id: r.n_copies for r in M.mixing_plan(d, weights={"big": 1, "tiny": 1}).collect() if r.source == "tiny"}
    rate = 1000500 / 2 / 40 + 0.5
    assert len(n) == 4 and all(abs(x - rate) < 5 * math.sqrt(rate) for x in n.values()) and len(set(n.values())) > 1


def test_shares_follow_the_weights(spark):
    rows = [(i, "x" * 99, "big") for i in range(3000)] + [(5000 + i, "x" * 99, "small") for i in range(1000)] + [(9000, "x", "none")]
    d = docs(spark, rows)
    got = M.mixing_plan(d, weights={"big": 1, "small": 3}, epochs=2.0).collect()
    by = Counter(r.source for r in got)
    assert set(by) == {"big", "small"}
    assert abs(by["big"] / 2000 - 1) < 0.1 and abs(by["small"] / 6000 - 1) < 0.1
    assert sorted(r.position for r in got) == list(range(len(got)))
    copies = Counter(r.doc_id for r in got)
    assert all(r.n_copies == copies[r.doc_id] and 1 <= r.copy <= r.n_copies for r in got)
    # counts of one source are Poisson: variance near the mean
    n = [copies.get(5000 + i, 0) for i in range(1000)]
    mean = sum(n) / 1000
    assert 0.8 < sum((x - mean) ** 2 for x in n) / 1000 / mean < 1.25
    # the order is global, not by source or id
    first = sorted(got, key=lambda r: r.position)[:1000]
    assert 150 < sum(r.source == "big" for r in first) < 350
    again = M.mixing_plan(d, weights={"big": 1, "small": 3}, epochs=2.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sorted(map(tuple, M.mixing_plan(d, weights={"big": 1, "small": 3}, epochs=2.0, seed=8).collect())) != sorted(map(tuple, got))


def test_many_sources_take_the_shuffle(spark, monkeypatch):
    rows = [(i, "t", f"s{i % 40}") for i in range(400)]
    want = sorted(map(tuple, M.mixing_plan(docs(spark, rows)).collect()))
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 10)
    assert sorted(map(tuple, M.mixing_plan(docs(spark, rows)).collect())) == want
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 100)
    monkeypatch.setattr(M, "MAX_BROADCAST_STEPS", 10)
    assert sorted(map(tuple, M.mixing_plan(docs(spark, rows)).collect())) == want


def test_mixed_documents_and_awkward_rows(spark):
    d = with_clashes(docs(spark, AWKWARD))
    plan = M.mixing_plan(d, epochs=5.0).collect()
    out = M.mix(d, epochs=5.0)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in plan)
    assert M.mix(d.limit(0)).count() == 0 and M.mixing_plan(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mixing_plan(d, weights={"a": -1.0})
