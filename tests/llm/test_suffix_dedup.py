import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SF001
from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import suffix_dedup as S
from textloom.llm.queries import QUERIES
from textloom.sources.tables import table


def brute(rows, length):
    """(doc_id, text) -> sorted rows of the contract."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for k, (_, d) in enumerate(data):
        for s in range(len(d) - length + 1):
            key = hashlib.md5(d[s:s + length]).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for s in range(len(d) - length + 1):
            if seen[hashlib.md5(d[s:s + length]).digest()] > 1:
                gone[s:s + length] = 1
        gone = gone[:len(d)]
        runs = int((np.diff(np.r_[0, gone]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[gone == 0])
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


def texts(rng, n, alphabet="abÉ \n"):
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 200))) for _ in range(6)] + ["ab" * 60, "x" * 90]
    out = []
    for i in range(n):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:  # a change in one place
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(alphabet) + p[k + 1:]
            if rng.random() < 0.4:  # a part only
                p = p[rng.randrange(len(p)):]
            parts += [p, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed,length,gram,room", [(1, 40, 20, 10**6), (2, 25, 8, 10**6), (3, 40, 20, 5), (4, 30, 29, 7)])
def test_random_texts_equal_brute_force(spark, monkeypatch, seed, length, gram, room):
    monkeypatch.setattr(S, "CHUNK", 4)
    rows = texts(random.Random(seed), 120)
    rows += rows[:5] + [(None, rows[6][1])]
    df = with_clashes(docs(spark, rows)).repartition(4)
    assert got(S.dedup(df, length=length, gram=gram, in_memory=room)) == brute(rows, length)


def test_external_and_in_memory_sorting_agree(monkeypatch, tmp_path):
    monkeypatch.setattr(S, "CHUNK", 5)
    rng = random.Random(9)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 40)):
            left = "".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode()
            right = "".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode()
            rows.append((0, rng.choice([1, 1, 2]), left, right, rng.randint(0, len(left)), len(left)))
        shard = S.Shard(rows, 12, 4)
        want = set(zip(*map(np.ndarray.tolist, shard.repeated())))
        found = {(i, x) for items, x in S.external_repeated(shard, str(tmp_path / "q"), 7) for i in items.tolist()}
        assert found == want


def test_stretches_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    whole = S.window_runs(data, S._hash_tables(4000), 40, 20)
    monkeypatch.setattr(S, "STRETCH", 100)
    parts = S.window_runs(data, S._hash_tables(4000), 40, 20)

    def anchors(runs):
        return [a for a, lo, hi in runs.tolist() for _ in range(lo, hi + 1)]

    assert anchors(whole) == anchors(parts) and len(anchors(whole)) == 3000 - 40 + 1


def test_copies_near_copies_and_a_hot_passage(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30))) for i in range(40)]
    rows += [(100 + i, " ".join(word() for _ in range(150))) for i in range(10)]
    rows += [(200, rows[45][1]), (201, rows[45][1].replace("a", "b", 3))]
    result = got(S.dedup(docs(spark, rows)))
    assert result == brute(rows, 400)
    by_id = {r[0]: r for r in result}
    assert all(len(passage) <= by_id[i][2] <= len(passage) + 12 for i in range(40)) and by_id[100][2] == 0 and by_id[200][2] == by_id[200][1]


def test_awkward_rows_and_empty_table(spark):
    rows = AWKWARD + [(20, "é" * 700), (21, "y" * 399), (22, "y" * 399), (23, "z" * 401), (24, "k" * 400)]
    df = with_clashes(docs(spark, rows))
    assert got(S.dedup(df)) == brute([(r[0], r[1]) for r in rows], 400)
    assert S.dedup(df.limit(0)).count() == 0


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF001, "documents").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_suffix_dedup"][0](spark, SF001)) == brute(rows, 400)


def test_columns_take_little_more_than_themselves():
    import tracemalloc

    rng = random.Random(3)
    parts = [rng.randbytes(rng.randint(0, 200)) for _ in range(60_000)] + [b""]
    tracemalloc.start()
    out = S.Shard._columns(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * out.nbytes  # 7 times that before, with places of eight bytes for all at once
    for i in (0, S.ROWS - 1, S.ROWS, 3 * S.ROWS + 7, 60_000):
        assert out[:, i].tolist() == [x + 1 for x in parts[i]] + [0] * (len(out) - len(parts[i]))
