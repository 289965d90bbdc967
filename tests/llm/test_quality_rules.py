import random
import re
from collections import Counter

from tests.llm.helpers import AWKWARD, docs, with_clashes, words
from textloom.llm import quality_rules as Q


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + o for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))


def test_base_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b c", "a b c d", "a b c a b c", "a a a a", "a a a", "x y z q x y z", "\n\na\n a\na\n", "#*$%&|<> é#",
             "a\x1cb c \x0bd"]
    texts += [words(rng, rng.randint(1, 120), rng.choice([2, 5, 300])).replace(" w1", "\nw1") for _ in range(60)]
    texts.append(words(rng, 40_000, 60))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in Q.judge(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(2)
    header = "Subscribe to our daily letter for more of this"
    rows = [(i, f"{header}\n{words(rng, 80)}", "h") for i in range(30)]
    rows += [(100 + i, f"{header.upper()}  \n" * 12 + words(rng, 60), "h") for i in range(3)]  # 108 of 168 words go
    rows += [(200 + i, header + "\n" + words(rng, 80), "other") for i in range(5)]  # not frequent on that host
    copy = words(rng, 90)
    rows += [(300 + i, copy, "h") for i in range(50)]  # exact copies are one document
    d = docs(spark, rows)
    got = {r.doc_id: r for r in Q.judge(d).collect()}
    assert all(got[i].kept and got[i].n_frequent_words == 9 for i in range(30))
    assert not any(got[100 + i].kept for i in range(3)) and not got[100].base_failed == got[100].kept
    assert all(got[200 + i].kept and got[200 + i].n_frequent_words == 0 for i in range(5))
    assert all(got[300 + i].kept and got[300 + i].n_frequent_words == 0 for i in range(50))
    out = {r.doc_id: r for r in Q.filter_documents(d).collect()}
    assert set(out) == {i for i, r in got.items() if r.kept}
    assert header not in out[0].text and out[0].n_chars == len(out[0].text) and header in out[200].text


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD + [(60 + i, words(random.Random(i), 70), None) for i in range(3)]))
    rows = Q.judge(d).collect()
    assert len(rows) == len(AWKWARD) + 3
    assert sorted(r.doc_id for r in rows if r.kept) == [60, 61, 62]
    out = Q.filter_documents(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [60, 61, 62]
    assert Q.judge(d.limit(0)).count() == 0 and Q.filter_documents(d.limit(0)).count() == 0
