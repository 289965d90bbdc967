import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import packing as P
from textloom.llm.queries import tokenizer_path
from textloom.sources.tables import table


def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers():
    w, t = P._Worker(tokenizer_path()), whole_tokenizer()
    texts = ["", " ", "Hello, WORLD! it's 12,345 x y", "l'élève déjà vu's we're I'LL d'd", "<|endoftext|> a<|startoftext|>b <|x|>",
             "é Å ﬁ ΣΑΣ İi ßẞ", "漢字かな　交じり 🙂👍🏽", "a\x1cb\x85c d \x00\x07", "¼²³ªº µ÷× naïve", "ab" * 5000,
             "don't'st 're've''s '", "€100 & #tag $$$ %%%*** |a|b|"]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x300, 0x3000)])) for _ in range(60))
              for _ in range(200)]
    for x in texts:
        assert np.frombuffer(w.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def place(counts, plan, limit):
    """Expand a plan to sequences and check it: every piece once, no overlap, gapless from 0."""
    seqs = {}
    for n, c in counts.items():
        ranks = sorted((lo, hi, s, e, o) for ln, lo, hi, s, e, o in plan if ln == n)
        assert [r[0] for r in ranks] == [0] + [r[1] for r in ranks[:-1]] and ranks[-1][1] == c
        for lo, hi, s, e, o in ranks:
            for r in range(lo, hi):
                seqs.setdefault(s + (r - lo) // e, []).append((o + (r - lo) % e * n, n))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= limit
    return len(seqs)


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    limit = rng.choice([2048, 100, 17])
    kind = seed % 4
    counts = Counter()
    for _ in range(rng.choice([1, 30, 3000])):
        n = {0: rng.randint(1, limit), 1: limit // 2 + 1 + rng.randrange(3), 2: int(limit * rng.random() ** 3) + 1,
             3: rng.choice([limit, limit // 3, limit // 3 + 1, 1])}[kind]
        counts[min(n, limit)] += rng.choice([1, 1, 40])
    used = place(counts, P.best_plan(counts, limit), limit)
    bound = -(-sum(n * c for n, c in counts.items()) // limit)
    # first-fit decreasing as a yardstick
    rooms = []
    for n in sorted(counts.elements(), reverse=True)[:20000]:
        for i, r in enumerate(rooms):
            if r >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(limit - n)
    assert used >= bound
    if sum(counts.values()) <= 20000:
        assert used <= len(rooms) * 1.03 + 3


def test_configurations_beat_first_fit():
    # three sizes where pairing greedily is bad: 1 x 6 + 2 x 3 + ... fill exactly
    counts = {6 * 20: 300, 4 * 20: 300, 3 * 20 + 5: 300, 2 * 20 + 15: 300}
    limit = 320
    used = place(counts, P.plan_sequences(counts, limit, small=10), limit)
    assert used == -(-sum(n * c for n, c in counts.items()) // limit)


def test_plan_size_does_not_grow_with_the_counts():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 50) for n in range(1, 2049)}
    small = P.plan_sequences(counts, 2048)
    large = P.plan_sequences({n: c * 10**6 for n, c in counts.items()}, 2048)
    assert len(large) < 60_000 and len(small) < 60_000
    bound = sum(n * c * 10**6 for n, c in counts.items()) / 2048
    assert P.sequences_of(large) <= bound * 1.06 and P.sequences_of(P.best_plan(counts)) <= bound / 10**6 * 1.02


def check(d, rows, with_ids):
    t = whole_tokenizer()
    seqs, by_doc = {}, Counter()
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= 2048
        by_doc[r.doc_id] += r.length
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    want, pieces = Counter(), Counter()
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] += len(ids)
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            pieces[(r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) + ((tuple(part),) if with_ids else ())] += 1
    assert by_doc == want
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) + ((tuple(r.ids),) if with_ids else ()) for r in rows) == pieces
    return len(seqs), -(-sum(want.values()) // 2048)


def test_documents_round_trip(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    used, bound = check(d, P.best_fit_pack(d, tokenizer_path(), with_ids=True).collect(), True)
    assert used <= bound * 1.02 + 2


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD))
    check(d, P.best_fit_pack(d, tokenizer_path()).collect(), False)
    assert P.best_fit_pack(d.limit(0), tokenizer_path()).count() == 0
