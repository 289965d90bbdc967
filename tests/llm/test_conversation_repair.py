import hashlib
import heapq
import random
import zlib

import pytest
import regex
from pyspark.sql import types as T

from tests.conftest import SF001
from tests.llm.helpers import with_clashes
from textloom.llm import conversation_repair as C
from textloom.llm.queries import QUERIES
from textloom.sources.tables import table

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BLANK = " \t\n\x0b\x0c\r"


def brute_edits(rows):
    """Cheapest, then ASCII-least edits by best-first search over strings; rows as (role, text, fault)."""
    fits = regex.compile(r"(s?(ua)+)?")
    heap = [(0, "", 0, (), 0)]
    while heap:
        cost, audit, i, out, run = heapq.heappop(heap)
        initials = "".join(o[0][:1] for o in out)
        if i == len(rows) and fits.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        nexts = []
        if run < 3:
            nexts += [(5, "I", i, (*out, (r, "")), run + 1) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            nexts.append((2, "D", i + 1, out, 0))
            if fault not in ("b", "d"):
                late = 5 if fault == "t" else 0
                if role:
                    nexts.append((late, "K", i + 1, (*out, (role, text)), 0))
                nexts += [(1 + late, "R", i + 1, (*out, (r, text)), 0) for r in ("user", "assistant")]
        for c, x, j, o, n in nexts:
            if cost + c <= 2 * len(rows) and fits.fullmatch("".join(y[0][:1] for y in o), partial=True):
                heapq.heappush(heap, (cost + c, audit + x, j, o, n))
    raise AssertionError


def brute(rows):
    """Results by conversation from rows (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        g = groups.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        g += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in g:
            body = text.strip(BLANK)
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, text = brute_edits(marked)
        turns = [t for t, _, _ in g if t is not None]
        faults = [f for _, _, f in marked]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(g, g[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 7)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "uncle"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", None, " \n", "é. ", "Yes.\x85"])
            rows.append((c, turn, role, text))
    return rows


def test_weights_match_best_first_search():
    rng = random.Random(3)
    faults = {"d": "b", "t": "t", "": ""}
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), f"{i}", rng.choice(["", "", "", "t", "d"]))
                for i in range(rng.randint(0, 7))]
        codes = "".join("d" if f == "d" else (r[0].upper() if f == "t" else r[0]) for r, _, f in rows)
        cost, audit = C.best_edits(codes)
        want = brute_edits([(r, t, faults[f]) for r, t, f in rows])
        assert (cost, audit) == want[:2]
        assert "\n".join(C.repaired(audit, [(r, t) for r, t, _ in rows])) == want[2]


def test_random_conversations_whole_and_by_blocks(spark, monkeypatch):
    rows = conversations(random.Random(5), 150)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    want = brute(rows)
    assert got(C.repair(df)) == want
    monkeypatch.setattr(C, "BLOCK_BITS", 1)
    assert got(C.repair(df, whole_rows=0)) == want
    assert got(C.repair(df, whole_rows=4)) == want


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c?", f"{t}.", f"{t}"]))
            for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = got(C.repair(df, whole_rows=10_000))
    assert got(C.repair(df, whole_rows=100)) == whole
    assert set(whole) == {1, 2} and len(whole[1][6]) > 2000


AWKWARD = [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (7, None, None, None), (8, None, "user", "a."),
           (9, 1, "user", "x" * 300_000), (10, 3, "user", "Same."), (10, 3, "user", "Same."), (10, 3, "user", "Other."),
           (11, -5, "assistant", "é\U0001f600!"), (11, 5, "assistant", "")]


@pytest.mark.parametrize("whole_rows", [C.WHOLE_ROWS, 0])
def test_awkward_rows_and_empty_table(spark, whole_rows):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    assert got(C.repair(with_clashes(df), whole_rows)) == brute(AWKWARD)
    assert C.repair(df.limit(0), whole_rows).count() == 0


def test_all_rows_dropped(spark):
    key = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(key, 0, "user", "Hi.")], SCHEMA)
    for n in (5, 0):
        assert got(C.repair(df, n)) == {key: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_repair"][0](spark, SF001)) == brute(rows)
