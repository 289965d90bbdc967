from collections import Counter

import corpus_pipeline as P
from tests.llm.helpers import AWKWARD, docs
from textloom.llm import mixing, quality_rules
from textloom.llm.common import written
from textloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark):
    from tests.llm.test_line_dedup import brute
    from tests.llm.test_packing import check
    from tests.llm.test_simhash import brute_fingerprint, brute_links, roots

    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]
    d = [table(spark, SF, "documents")]
    for name, stage in P.STAGES[:-1]:
        d.append(written(stage(spark, d[-1], SF), f"test-{name}"))
        assert d[-1].columns == d[0].columns
    verdict = {r.doc_id for r in quality_rules.judge(d[0]).collect() if r.kept}
    assert {r.doc_id for r in d[1].collect()} == verdict
    # line dedup: equal lines by brute force; near ones have their own tests
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in d[1:3])
    assert set(before) == set(after)
    seen = set()
    for i in sorted(after):
        for line in after[i].split("\n"):
            if line.strip():
                assert line not in seen
                seen.add(line)
    # SimHash: one document of each component
    fps = {i: brute_fingerprint(t) for i, t in after.items()}
    of = roots(sorted(set(fps.values())), brute_links(sorted(set(fps.values())), 3))
    low = {}
    for i in sorted(fps):
        low.setdefault(of[fps[i]], i)
    assert {r.doc_id for r in d[3].collect()} == set(low.values())
    # mixing: the plan's copies, whole
    plan = Counter(r.doc_id for r in mixing.mixing_plan(d[3]).collect())
    assert Counter(r.doc_id for r in d[4].collect()) == plan
    texts = {r.doc_id: r.text for r in d[3].collect()}
    assert all(r.text == texts[r.doc_id] for r in d[4].collect())
    used, bound = check(d[4], P.STAGES[-1][1](spark, d[4], SF).collect(), False)
    assert used <= bound * 1.02 + 2
    small = sorted(before.items())[:25]
    small = [(i, "\n".join(t.split("\n")[:4])[:400]) for i, t in small]
    from textloom.llm import line_dedup

    got = {r.doc_id: list(r.dropped) for r in line_dedup.decide(docs(spark, small)).collect()}
    assert got == brute(small)


def test_run_and_awkward_rows(spark):
    assert P.run(spark, SF).count() > 0
    d = docs(spark, AWKWARD)
    for _, stage in P.STAGES:
        stage(spark, d, SF).collect()
        stage(spark, d.limit(0), SF).collect()
