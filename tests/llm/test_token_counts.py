import math
import random

import pytest

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import token_counts as C
from textloom.llm.queries import tokenizer_path
from textloom.sources.tables import table


def viterbi(pre, scores, byte):
    """Best segmentation of one pre-token by itself: (score, -tokens) per position."""
    longest = max(map(len, scores))
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(pre)
    for i in range(1, len(pre) + 1):
        cand = []
        for j in range(max(0, i - longest), i):
            s = scores.get(pre[j:i])
            if s is not None:
                cand.append((best[j][0] + s, best[j][1] - 1))
        if pre[i - 1] not in scores:
            n = len(pre[i - 1].encode("utf-8", "surrogatepass"))
            cand.append((best[i - 1][0] + n * byte, best[i - 1][1] - n))
        best[i] = max(cand)
    return -best[-1][1]


@pytest.fixture(scope="module")
def model():
    return C.piece_scores(tokenizer_path("piece_bpe_32k.model"))


def test_trie_equals_separate_dynamic_programs(model):
    scores, byte = model
    trie = C.PrefixTrie(scores, byte, room=300)  # starts anew many times
    rng = random.Random(1)
    stems = ["▁the", "▁inter", "▁unbeliev", "▁é", "▁漢", "▁\U0001f600", "▁▁▁", "▁x\n", "▁http://"]
    tails = ["", "able", "ing", "national", "ly.", "字", "\t", "ñandú", "0123456789", "s'", "Ωmega", "\u0000"]
    pres = [rng.choice(stems) + "".join(rng.choices(tails, k=rng.randint(0, 4))) for _ in range(1500)]
    pres += ["▁" + "".join(rng.choices("abcdefgh ▁é", k=rng.randint(1, 30))) for _ in range(500)] + ["▁" + "longword" * 100]
    rng.shuffle(pres)
    for i in range(0, len(pres), 40):
        part = pres[i:i + 40]
        want = [viterbi(p, scores, byte) for p in part]
        assert trie.totals([[p] for p in part]) == want
        assert trie.totals([part, []]) == [sum(want), 0]


def test_shared_prefixes_are_scored_once(model):
    trie = C.PrefixTrie(*model)
    trie.insert(["▁interesting", "▁interest", "▁inter", "▁interested", "▁in"])
    assert trie.nodes == len("▁interesting") + len("ed")
    trie.insert(["▁interest"])
    assert trie.nodes == len("▁interesting") + len("ed")


def test_documents_against_brute_force(spark, model):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in C.count_tokens(d, tokenizer_path("piece_bpe_32k.model")).collect()}
    known = {}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows[:60]:
        p = ["▁" + w for w in r.text.split(" ")] if "  " not in r.text else C.pre_tokens(r.text)
        n = sum(known.setdefault(w, viterbi(w, *model)) if w not in known else known[w] for w in p)
        assert got[r.doc_id] == (len(C.pre_tokens(r.text)), n)


def test_awkward_rows_and_empty_table(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    d = with_clashes(docs(spark, AWKWARD))
    rows = C.count_tokens(d, path).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.n_tokens for r in rows if r.doc_id in (5, None)} >= {1}
    assert C.count_tokens(d.limit(0), path).count() == 0
