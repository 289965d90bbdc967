import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import quality_classifier as Q
from textloom.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = Q.classify(d, labels.where("doc_id % 2 = 0")).select("doc_id", "kept", "probability")
    held = out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(held) > 100
    right = sum(r.kept == (r.quality == 1) for r in held) / len(held)
    bad = [r for r in held if r.quality == 0]
    good = [r for r in held if r.quality == 1]
    assert right >= 0.93
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_sites_are_shrunk_towards_the_prior_above(spark):
    good, bad = "the quiet river ran on, as it does. " * 9, "### *** $$$ BUY!! NOW!! %%% " * 9
    rows = [(i, good + str(i), "clean", "en") for i in range(200)] + [(1000 + i, bad + str(i), "spam", "en") for i in range(200)]
    rows += [(5000, bad, "sparse", "en"), (5001, good, "sparse", "en"), (6000, good, "spam", "fr")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 3)] + [(1000 + i, 0) for i in range(0, 200, 3)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(docs(spark, rows), labels).collect()}
    assert got[0].host_rate > 0.9 and got[1000].host_rate < 0.1
    assert 0.2 < got[5000].host_rate < 0.8  # two documents say little about a host
    assert got[6000].path_rate < got[0].path_rate  # its path has no other document: the host speaks
    assert got[0].kept and not got[1000].kept


def test_strength_by_moments(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(400):
        p = rng.beta(6, 4)
        x = rng.random(200) < p
        rows.append((200, float(x.sum()), float(x.sum())))
    k = Q._strength(spark.createDataFrame(rows, "n long, s double, s2 double"), F.lit(0.6))
    assert 7 < k < 13


def test_rates_and_probability_against_brute_force(spark):
    d, labels = table(spark, SF, "documents").where("doc_id < 400"), table(spark, SF, "labels")
    model = Q.train(d, labels)
    rows = d.collect()
    e = [float(model.evidence(Q.features(r.text).astype(np.float64)[None])[0]) for r in rows]
    p = [1 / (1 + np.exp(-(x + model.prior))) for x in e]
    host, path = {}, {}
    for r, x in zip(rows, p):
        host.setdefault(r.source, []).append(x)
        path.setdefault((r.source, r.lang), []).append(x)
    mean = sum(p) / len(p)

    def strength(groups, prior):
        groups = [(np.array(v), prior(k)) for k, v in groups.items() if len(v) > 1]
        n = sum(len(v) for v, _ in groups)
        between = sum(len(v) * (v.mean() - m) ** 2 for v, m in groups)
        noise = sum(len(v) * v.var() / (len(v) - 1) for v, _ in groups)
        return np.clip(sum(len(v) * m * (1 - m) for v, m in groups) / n / max((between - noise) / n, 1e-6) - 1, 1, 1e6)

    k = strength(host, lambda _: mean)
    host_rate = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in host.items()}
    k = strength(path, lambda x: host_rate[x[0]])
    got = {r.doc_id: r for r in Q.classify(d, labels).collect()}
    assert len(got) == len(rows) > 300
    for r, x, own in zip(rows, e, p):
        rest = path[(r.source, r.lang)]
        rate = min(max((sum(rest) - own + k * host_rate[r.source]) / (len(rest) - 1 + k), 1e-6), 1 - 1e-6)
        prob = 1 / (1 + np.exp(-(x + np.log(rate / (1 - rate)))))
        g = got[r.doc_id]
        assert abs(g.evidence - x) < 1e-9 and abs(g.host_rate - host_rate[r.source]) < 1e-6
        assert abs(g.path_rate - rate) < 1e-6 and abs(g.probability - prob) < 1e-6
        assert abs(prob - 0.5) < 1e-6 or g.kept == (prob >= 0.5)


def test_contradictory_labels_and_repeated_ids(spark):
    good, bad = "the quiet river ran on, as it does. " * 9, "### *** $$$ BUY!! NOW!! %%% " * 9
    rows = [(i, good + str(i), "a", "en") for i in range(40)] + [(100 + i, bad + str(i), "b", "en") for i in range(40)]
    plain = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)]
    schema = "doc_id long, quality int"
    want = Q.train(docs(spark, rows), spark.createDataFrame(plain, schema)).weights
    # a majority, a tie, repeated equal rows: the same model, in any order
    labels = plain + [(0, 1), (0, 0), (101, 0), (101, 1), (35, 1), (35, 0)]
    for r, x in ((rows + rows[:5], labels), (rows[::-1] + rows[3:9], labels[::-1])):
        got = Q.train(docs(spark, r).repartition(7), spark.createDataFrame(x, schema).repartition(5)).weights
        assert np.array_equal(got, want)
    # two texts under one id: the order of rows doesn't decide
    twice = rows + [(3, bad, "a", "en")]
    one = Q.train(docs(spark, twice), spark.createDataFrame(plain, schema)).weights
    two = Q.train(docs(spark, twice[::-1]), spark.createDataFrame(plain, schema)).weights
    assert np.array_equal(one, two)


def test_awkward_rows_labels_and_empty_tables(spark):
    d = with_clashes(docs(spark, AWKWARD))
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1), (77, 0), (5, 0), (5, 0), (9, 1)], "doc_id long, quality int")
    rows = Q.classify(d, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.probability <= 1 and r.kept is not None for r in rows)
    assert Q.classify(d, labels.limit(0)).count() == len(AWKWARD)
    assert Q.classify(d.limit(0), labels).count() == 0
    assert not Q.features(None).any() and np.isfinite(Q.features("\x00")).all()
    assert abs(np.linalg.norm(Q.features("a b c " * 500_000)[:Q.BUCKETS]) - 1) < 1e-5
