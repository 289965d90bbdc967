"""BPE training by speculated merge sequences.

The driver follows the exact counts of the leading pairs (``FOLLOWED`` at most,
and pairs made since that are above the rest).  In a round it tries, on the
most frequent words, which merges may come next and proposes that sequence.
Each task replays it over its words and sends the changes of pair counts by
step; summed over the tasks they are exact.  The driver then walks the sequence
and accepts merges while each is the one that one-at-a-time BPE takes (greatest
count, then left, then right symbol) by the exact counts at that step.  What the
trial words say only decides how long the accepted part is, never what it is.

All that reaches the driver is bounded by its own parameters and the size of
the vocabulary, not by the words.
"""

from __future__ import annotations

import copy
import heapq
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs whose counts the driver follows; merges proposed in a round; words it tries them on.
FOLLOWED, PROPOSED, TRIED = 50_000, 1024, 100_000
#: Symbols of the words that a task merges at a time.
SYMBOLS_HELD = 500_000
#: Buckets that give their leading pairs each.
BUCKETS = 32

Pair = tuple[str, str]


def merge_once(symbols: list[str], pair: Pair) -> list[str]:
    """All occurrences of a pair merged, left to right."""
    out, i, n = [], 0, len(symbols)
    a, b = pair
    while i < n:
        if i + 1 < n and symbols[i] == a and symbols[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def in_order(symbols: list[str], steps: dict[Pair, int]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(step, before, after) of each merge that changes a word, the merges taken in order of step."""
    last = -1
    while True:
        best = None
        for p in zip(symbols, symbols[1:]):
            s = steps.get(p)
            if s is not None and s > last and (best is None or s < best[0]):
                best = (s, p)
        if best is None:
            return
        last = best[0]
        after = merge_once(symbols, best[1])
        yield last, symbols, after
        symbols = after


class _Words:
    """Words as one array of symbol numbers, with a separator after each word.

    A merged symbol stands where its left part was; the place of its right part is left out of the
    chain of places (``after``, ``before``).  Pairs of the first symbols are found by their sorted
    codes, others by the places where one of their symbols was made, so a merge costs its occurrences.
    """

    def __init__(self, symbols: pa.ListArray, counts: np.ndarray, names: dict[str, int]):
        lengths = symbols.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        codes = symbols.flatten().dictionary_encode()
        known = np.array([names.setdefault(x, len(names)) for x in codes.dictionary.to_pylist()], np.int64)
        self.ends = np.cumsum(lengths + 1)
        n = int(self.ends[-1]) + 1 if len(self.ends) else 1
        self.at = np.full(n, -1, np.int64)  # begins with a separator; -2: merged into the symbol before
        inside = np.ones(n, bool)
        inside[0] = False
        inside[self.ends] = False
        if len(known):
            self.at[inside] = known[codes.indices.to_numpy()]
        self.counts = np.concatenate([np.zeros(1, np.int64), np.repeat(counts, lengths + 1)])
        self.names, self.known = names, set(known.tolist())
        self.before, self.after = np.arange(-1, n - 1), np.minimum(np.arange(1, n + 1), n - 1)
        first = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
        code = self.at[first] << 32 | self.at[first + 1]
        order = np.argsort(code, kind="stable")
        self.first, self.first_codes = first[order], code[order]
        self.made: dict[int, list[np.ndarray]] = defaultdict(list)

    @property
    def of(self) -> np.ndarray:
        """The symbol numbers as they are now, with -1 for separators."""
        return self.at[self.at > -2]

    def copy(self) -> _Words:
        """The same words, to be merged apart from these."""
        w = copy.copy(self)
        w.at, w.before, w.after = self.at.copy(), self.before.copy(), self.after.copy()
        w.made = defaultdict(list, {t: list(x) for t, x in self.made.items()})
        return w

    def symbols(self) -> pa.ListArray:
        """The symbols of each word."""
        upto = np.cumsum(self.at >= 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, upto[self.ends]), pa.int32()), _strings(self.names, self.at[self.at >= 0]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, c = self.of, self.counts[self.at > -2]
        x, y = of[:-1], of[1:]
        both = (x >= 0) & (y >= 0)
        return x[both], y[both], c[1:][both]

    def _places(self, a: int, b: int) -> np.ndarray:
        """The places of a where b follows, in order."""
        found = []
        if a not in self.known:
            found.append((self.made.get(a, []), None))
        if b not in self.known:
            found.append((self.made.get(b, []), self.before))
        if found:  # a symbol that no word began with stands only where it was made
            places, move = min(found, key=lambda x: sum(map(len, x[0])))
            places = [x if move is None else move[x] for x in places]
        else:
            low, high = np.searchsorted(self.first_codes, (a << 32 | b, (a << 32 | b) + 1))
            places = [self.first[low:high], *self.made.get(a, ()), *(self.before[x] for x in self.made.get(b, ()))]
        places = [x[self.at[x] == a] for x in places]
        places = [x[self.at[self.after[x]] == b] for x in places if len(x)]
        if len(places) == 1:
            return places[0]
        return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)

    def merge(self, pair: Pair, told: bool) -> list[tuple]:
        """All occurrences of a pair merged, left to right; if ``told``, (left, right, change) of the pair counts."""
        a, b = (self.names.setdefault(x, len(self.names)) for x in pair)
        t = self.names.setdefault(pair[0] + pair[1], len(self.names))
        of, at = self.at, self._places(a, b)
        if not len(at):
            return []
        if a == b:  # of a run, every other one
            i = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.append(True, self.after[at[:-1]] != at[1:]), i, 0))
            at = at[(i - first) % 2 == 0]
        second = self.after[at]
        then = self.after[second]
        out = []
        if told:
            c, gap = self.counts[at], then[:-1] == at[1:]
            after_one, before_one = np.append(False, gap), np.append(gap, False)  # next to another occurrence
            left, right = of[self.before[at]], of[then]
            l, r = left >= 0, (right >= 0) & ~before_one
            made = np.where(after_one, t, left)
            out = [(np.full(len(at), a), np.full(len(at), b), -c), (left[l], np.full(l.sum(), a), -c[l]),
                   (made[l], np.full(l.sum(), t), c[l]), (np.full(r.sum(), b), right[r], -c[r]),
                   (np.full(r.sum(), t), right[r], c[r])]
        of[at], of[second] = t, -2
        self.after[at], self.before[then] = then, at
        self.made[t].append(at)
        return out


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values by key."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(values) else values


def joined(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``SYMBOLS_HELD`` symbols (the values in the lists of ``column``), as a merge has a cost for each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b.column(column).flatten())
        if n >= SYMBOLS_HELD:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def merged(symbols: pa.ListArray, counts: pa.Array, names: dict[str, int], merges: list[Pair]) -> _Words:
    w = _Words(symbols, counts.to_numpy().astype(np.int64), names)
    for m in merges:
        w.merge(m, False)
    return w


def _strings(names: dict[str, int], numbers: np.ndarray) -> pa.Array:
    return pa.array(list(names), pa.string()).take(pa.array(numbers))


def pair_counts(words: DataFrame, merges: list[Pair]) -> DataFrame:
    """(l, r, cnt) of all adjacent pairs after ``merges``; tasks sum a batch of words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        for b in joined(batches, 0):
            x, y, c = merged(b.column(0), b.column(1), names, merges).pairs()
            code, c = _summed(x << 32 | y, c)
            yield pa.RecordBatch.from_arrays([_strings(names, code >> 32), _strings(names, code & 0xFFFFFFFF), pa.array(c)],
                                             names=["l", "r", "cnt"])

    return words.select("symbols", "cnt").mapInArrow(run, "l string, r string, cnt long").groupBy("l", "r").agg(
        F.sum("cnt").alias("cnt"))


def changes(words: DataFrame, merges: list[Pair], proposed: list[Pair], followed: set[Pair], floor: int) -> tuple[DataFrame, list[str]]:
    """What each proposed merge does to the counts that matter: a pair's number and an array of (step, delta); and the numbered symbols.

    Those are the followed pairs, and pairs with a symbol that a proposal makes
    if they come above ``floor``: a pair's count never grows after the step that
    made its younger symbol.  It is no more then than the count of the pair that
    it comes from, so a pair from one that isn't followed stays in its task, and
    so do all pairs of symbols without a followed pair.
    """
    new = list(dict.fromkeys(a + b for a, b in proposed))
    made = len(new)  # lower numbers are symbols that proposals make
    symbols = new + sorted({x for p in [*followed, *proposed] for x in p} - set(new))
    number = {x: i for i, x in enumerate(symbols)}
    old = np.unique(np.array([number[l] << 32 | number[r] for l, r in followed], np.int64))
    first, second, third = (np.array([number[x] for x in c], np.int64) for c in zip(*((a, b, a + b) for a, b in proposed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = dict(number)
        for b in joined(batches, 0):
            w = merged(b.column(0), b.column(1), names, merges)
            found = []
            for i, m in enumerate(proposed):
                if change := w.merge(m, True):
                    x, y, d = (np.concatenate(c) for c in zip(*change))
                    code, d = _summed(x << 32 | y, d)
                    found.append((np.full(len(d), i, np.int32), code, d))
            if not found:
                continue
            step, code, d = (np.concatenate(c) for c in zip(*found))
            x, y = code >> 32, code & 0xFFFFFFFF
            left, right = x == third[step], y == third[step]
            from_x, from_y = np.where(left, second[step], x), np.where(right, first[step], y)
            may = (~left & ~right) | (from_x < made) | (from_y < made) | np.isin(from_x << 32 | from_y, old)
            follows = np.isin(code, old)
            some = (d != 0) & (x < len(symbols)) & (y < len(symbols)) & (follows | may & ((x < made) | (y < made)))
            yield pa.RecordBatch.from_arrays([pa.array(code[some]), pa.array(step[some]), pa.array(follows[some]), pa.array(d[some])],
                                             names=["pair", "step", "old", "delta"])

    by_step = words.select("symbols", "cnt").mapInArrow(run, "pair long, step int, old boolean, delta long").groupBy(
        "pair", "old", "step").agg(F.sum("delta").alias("delta"))
    return by_step.groupBy("pair", "old").agg(F.collect_list(F.struct("step", "delta")).alias("deltas")).where(
        F.col("old") | (F.array_max("deltas.delta") > floor)).select("pair", "deltas"), symbols


def by_step(found: pa.Table, symbols: list[str]) -> dict[int, list[tuple[Pair, int]]]:
    """The rows of ``changes`` as (pair, delta) by step."""
    out: dict[int, list] = defaultdict(list)
    for b in found.to_batches():
        pairs = [(symbols[c >> 32], symbols[c & 0xFFFFFFFF]) for c in b.column(0).to_pylist()]
        steps = b.column(1).flatten()
        of = np.repeat(np.arange(len(pairs)), b.column(1).value_lengths().to_numpy())
        for i, step, d in zip(of.tolist(), steps.field("step").to_pylist(), steps.field("delta").to_pylist()):
            if d:
                out[step].append((pairs[i], d))
    return out


def leading(pairs: DataFrame, most: int) -> tuple[dict[Pair, int], int]:
    """The counts of about ``most`` leading pairs (twice that at most), and a floor: all pairs above it are among them.

    Each of ``BUCKETS`` hash buckets gives its own first pairs, so the driver gets no more than
    it keeps however many tasks there are.  The leader (count, then symbols) is always among them.
    """
    quota = max(1, -(-2 * most // BUCKETS))
    first = Window.partitionBy("bucket").orderBy(F.col("cnt").desc(), "l", "r")
    top = (pairs.withColumn("bucket", F.pmod(F.xxhash64("l", "r"), F.lit(BUCKETS))).withColumn("nth", F.row_number().over(first))
           .where(F.col("nth") <= quota).select("l", "r", "cnt", "nth").toArrow())
    rows = list(zip(*(top.column(c).to_pylist() for c in ("l", "r", "cnt", "nth"))))
    return {(l, r): c for l, r, c, _ in rows}, max((c for _, _, c, n in rows if n == quota), default=0)


def frequent(words: DataFrame, most: int) -> list[tuple[list[str], int]]:
    """About ``most`` frequent words: the first ones of each task, in equal parts, so the driver gets no more than it keeps."""
    quota = -(-most // max(words.rdd.getNumPartitions(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            held = held.take(pc.sort_indices(held, [("cnt", "descending"), ("word", "ascending")])[:quota])
        if held is not None:
            yield from held.select(["symbols", "cnt"]).to_batches()

    top = words.select("word", "symbols", "cnt").mapInArrow(run, "symbols array<string>, cnt long").toArrow()
    return [([sys.intern(x) for x in s], c) for b in top.to_batches()
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


def typical(words: DataFrame, most: int) -> list[tuple[list[str], int]]:
    """About ``most`` words that stand for all: half of them the frequent ones, half drawn from the others by their
    hash, with counts raised to those of all others.  They only decide what is proposed."""
    quota = -(-most // (2 * max(words.rdd.getNumPartitions(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, drawn, others = None, None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            order = pc.sort_indices(held, [("cnt", "descending"), ("word", "ascending")])
            rest, held = held.take(order[quota:]), held.take(order[:quota])
            others += pc.sum(rest["cnt"]).as_py() or 0
            drawn = rest if drawn is None else pa.concat_tables([drawn, rest])
            drawn = drawn.take(pc.sort_indices(drawn, [("h", "ascending")])[:quota])
        for t, scale in ((held, 1), (drawn, others)):
            if t is not None and t.num_rows:
                cnt = np.array(t["cnt"].to_pylist(), np.int64)
                if scale != 1:
                    cnt = np.rint(cnt * (scale / max(cnt.sum(), 1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([t["symbols"].combine_chunks(), pa.array(cnt)], names=["symbols", "cnt"])

    top = words.select("word", "symbols", "cnt", F.xxhash64("word").alias("h")).mapInArrow(run, "symbols array<string>, cnt long").toArrow()
    return [([sys.intern(x) for x in s], c) for b in top.to_batches()
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


class Trial:
    """The words that the driver tries merges on."""

    def __init__(self, words: list[tuple[list[str], int]]):
        self.names: dict[str, int] = {}
        self.words = _Words(pa.array([list(w) for w, _ in words], pa.list_(pa.string())),
                            np.array([c for _, c in words], np.int64), self.names)
        self.symbols = list(self.names)

    def merge(self, pair: Pair) -> dict[Pair, int]:
        """The changes of pair counts."""
        found = self.words.merge(pair, True)
        if not found:
            return {}
        x, y, d = (np.concatenate(c) for c in zip(*found))
        code, d = _summed(x << 32 | y, d)
        for name in list(self.names)[len(self.symbols):]:
            self.symbols.append(name)
        return {(self.symbols[c >> 32], self.symbols[c & 0xFFFFFFFF]): n for c, n in zip(code.tolist(), d.tolist()) if n}

    def propose(self, counts: dict[Pair, int], tokens: set[str], most: int, floor: int,
                told: dict[Pair, list[tuple[Pair, int]]] | None = None) -> list[Pair]:
        """The merges that would come next if the trial words' changes were all; the words are left as they were.

        Of merges proposed in the last round but not taken, ``told`` has the changes that all words gave.
        """
        guess = dict(counts)
        heap = [(-c, p) for p, c in guess.items()]
        heapq.heapify(heap)
        out: list[Pair] = []
        made: set[str] = set()
        held, self.words = self.words, self.words.copy()
        while heap and len(out) < most:
            c, p = heapq.heappop(heap)
            if guess.get(p) != -c:
                continue
            if out and -c <= floor:
                break
            delta = self.merge(p)
            out.append(p)
            t = p[0] + p[1]
            if t in tokens or t in made:
                break  # pairs of that symbol may grow: counted anew afterwards
            made.add(t)
            if told and p in told:
                changes = told[p]
            else:
                seen = -delta.get(p, 0)  # what the trial words have of the pair stands for all of it
                changes = [(q, round(d * -c / seen) if seen > 0 else d) for q, d in delta.items()]
            for q, d in changes:
                n = guess.get(q, 0) + d
                if d and n > 0:
                    guess[q] = n
                    heapq.heappush(heap, (-n, q))
                elif d:
                    guess.pop(q, None)
            guess.pop(p, None)
        self.words = held
        return out


def followed_only(counts: dict[Pair, int], floor: int, most: int) -> tuple[dict[Pair, int], int]:
    """At most about the ``most`` leading pairs, and a floor: all pairs above it are among them."""
    if len(counts) <= most:
        return counts, floor
    least = max(floor, heapq.nlargest(most, counts.values())[-1])
    kept = {p: c for p, c in counts.items() if c > least}
    return (kept, least) if kept else (counts, floor)


def accept(counts: dict[Pair, int], proposed: list[Pair], deltas: dict[int, list[tuple[Pair, int]]], tokens: set[str],
           floor: int, least: int, fresh: bool) -> tuple[list[tuple[str, str, int]], bool]:
    """The part of the proposals that one-at-a-time BPE takes; ``counts`` and ``tokens`` follow it.

    ``counts`` are exact for all pairs above ``floor``; ``fresh`` says that they
    were just counted, so that the first of them leads even among equals.
    Returns the merges with their counts, and whether pairs have to be counted anew.
    """
    heap = [(-c, p) for p, c in counts.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    for step, pair in enumerate(proposed):
        while heap and counts.get(heap[0][1]) != -heap[0][0]:
            heapq.heappop(heap)
        if not heap:
            return out, floor > 0
        c, top = -heap[0][0], heap[0][1]
        if c <= floor and not (fresh and not out):
            return out, True
        if top != pair or c < least:
            return out, False
        out.append((*pair, c))
        for q, d in deltas.get(step, ()):
            n = counts.get(q, 0) + d
            if n > 0:
                counts[q] = n
                heapq.heappush(heap, (-n, q))
            else:
                counts.pop(q, None)
        t = pair[0] + pair[1]
        if t in tokens:
            return out, True
        tokens.add(t)
    return out, floor > 0 and not counts
