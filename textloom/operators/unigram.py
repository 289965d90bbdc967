"""Unigram vocabularies by distributed EM (T04) and best-path encoding.

The distinct-word table (one corpus shuffle) is what the rounds read.  An
expectation step is one pass: Arrow batches run forward-backward over each
word's lattice of pieces and sum expected counts per task, one shuffle of
piece sums follows.  The driver holds the pieces and their scores (bounded by
the seed's size), prunes the least used and normalises.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sp_normalize, sp_pretokens
from ..functions.tokens import BOS_ID, EOS_ID, UNK_ID
from .bpe import PRESETS, dealt_out, sp_words_table

# The four control entries, in id order.
CONTROL = ["<pad>", "<s>", "</s>", "<unk>"]

#: Words whose best path a task remembers; texts that are Python lists at a time.
WORDS_HELD, TEXTS_HELD = 100_000, 64
#: Words in a task of a round.
WORDS_PER_TASK = 40_000


@dataclass
class UnigramModel:
    vocab: DataFrame  # token STRING, id INT, score DOUBLE
    rounds: int = 0


def _lattice(sym: list[str], scores: dict, longest: int):
    """(start, end, piece) of every vocabulary piece in a word, by end."""
    for end in range(1, len(sym) + 1):
        piece = ""
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            piece = sym[start] + piece
            if piece in scores:
                yield start, end, piece


class _Trie:
    """The pieces by their characters: edges sorted by (node, symbol), and the piece that ends at a node.

    A byte symbol is one edge for its six characters, as pieces are told apart by their spelling alone.
    """

    def __init__(self, scores: dict[str, float]):
        self.pieces = list(scores)
        self.scores = np.array([scores[p] for p in self.pieces])
        nodes, edges = {"": 0}, {}
        self.symbols: dict[str, int] = {}

        def edge(a: str, symbol: str) -> None:
            n = self.symbols.setdefault(symbol, len(self.symbols))
            edges[nodes[a] << 32 | n] = nodes.setdefault(a + symbol, len(nodes))

        for p in self.pieces:
            for i, ch in enumerate(p):
                edge(p[:i], ch)
            for i in range(len(p) - 5):
                if p[i:i + 3] == "<0x":
                    edge(p[:i], p[i:i + 6])
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.full(len(nodes), -1, np.int64)
        for i, p in enumerate(self.pieces):
            if p:
                self.ends[nodes[p]] = i

    def arcs(self, symbols: pa.ListArray, longest: int) -> tuple[np.ndarray, ...]:
        """(start, end, piece) of every piece in the words, and the places where words begin and end.

        A word of n symbols has n + 1 places; they are numbered through all words.
        """
        sizes = symbols.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        codes = symbols.flatten().dictionary_encode()
        known = np.array([self.symbols.get(x, -1) for x in codes.dictionary.to_pylist()], np.int64)
        last = np.cumsum(sizes + 1) - 1
        at = np.full(int(last[-1]) + 1 if len(last) else 0, -1, np.int64)
        inside = np.ones(len(at), bool)
        inside[last] = False
        if len(known):
            at[inside] = known[codes.indices.to_numpy()]
        start, found = np.flatnonzero(at >= 0), []
        node = np.zeros(len(start), np.int64)
        for k in range(min(longest, int(sizes.max()) if len(sizes) else 0)):
            key = node << 32 | at[start + k]  # at a word's end or an unknown symbol -1, which no edge has
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = (self.keys[place] == key) if len(self.keys) else np.zeros(len(key), bool)
            start, node = start[go], self.to[place[go]]
            if not len(start):
                break
            piece = self.ends[node]
            is_piece = piece >= 0
            found.append((start[is_piece], start[is_piece] + k + 1, piece[is_piece]))
        arcs = tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return *arcs, last - sizes, last


def _sums_by_place(places: np.ndarray, step: np.ndarray, others: np.ndarray, weights: np.ndarray, logs: np.ndarray) -> None:
    """``logs`` at ``places`` = log of the sums of exp(logs at ``others`` + weight), the arcs taken by ``step``, in place."""
    order = np.argsort(step * len(logs) + places)
    places, others, weights, step = places[order], others[order], weights[order], step[order]
    cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]).tolist() + [len(step)] if len(step) else [0]
    group = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (step[1:] != step[:-1])]) if len(step) else places
    bounds = np.searchsorted(group, cuts)
    for (a, b), (g, h) in zip(zip(cuts, cuts[1:]), zip(bounds, bounds[1:])):
        x = logs[others[a:b]] + weights[a:b]
        first = group[g:h] - a
        most = np.maximum.reduceat(x, first)
        most[np.isneginf(most)] = 0.0
        sums = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.r_[first, b - a]))), first)
        logs[places[a + first]] = most + np.log(sums)


def _expected(trie: _Trie, symbols: pa.ListArray, counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """By piece: posterior counts over all words (forward-backward, in step over the words), and whether a word has it."""
    start, end, piece, begin, last = trie.arcs(symbols, longest)
    n, size = len(trie.pieces), int(last[-1]) + 1 if len(last) else 0
    fwd, bwd = np.full(size, -np.inf), np.full(size, -np.inf)
    fwd[begin], bwd[last] = 0.0, 0.0
    word = np.repeat(np.arange(len(last)), last - begin + 1)
    of, weights = word[start], trie.scores[piece]
    with np.errstate(divide="ignore"):
        _sums_by_place(end, end - begin[of], start, weights, fwd)
        _sums_by_place(start, last[of] - start, end, weights, bwd)
    whole = fwd[last]
    can = np.isfinite(whole)[of]
    start, end, piece, of, weights = start[can], end[can], piece[can], of[can], weights[can]
    x = counts[of] * np.exp(fwd[start] + weights + bwd[end] - whole[of])
    return np.bincount(piece, x, n), np.bincount(piece, minlength=n) > 0


def expected_counts(sym: list[str], scores: dict, longest: int) -> dict[str, float]:
    """Posterior counts of the pieces of one word (forward-backward)."""
    trie = _Trie(scores)
    x, has = _expected(trie, pa.array([sym], pa.list_(pa.string())), np.ones(1), longest)
    return {p: float(v) for p, v, h in zip(trie.pieces, x, has) if h}


def best_path(sym: list[str], scores: dict, longest: int, unknown: float) -> list[str]:
    """The most probable segmentation; ties go to fewer pieces.  A symbol that no piece covers stands alone."""
    best: list = [(0.0, 0, 0)] + [None] * len(sym)
    arcs: dict[int, list] = defaultdict(list)
    for s, e, p in _lattice(sym, scores, longest):
        arcs[e].append((s, scores[p]))
    for e in range(1, len(sym) + 1):
        cand = [(best[s][0] + w, best[s][1] - 1, s) for s, w in arcs[e]]
        if sym[e - 1] not in scores:
            cand.append((best[e - 1][0] + unknown, best[e - 1][1] - 1, e - 1))
        best[e] = max(cand)
    out, e = [], len(sym)
    while e:
        s = best[e][2]
        out.append("".join(sym[s:e]))
        e = s
    return out[::-1]


def _seed(words: DataFrame, size: int, longest: int) -> dict[str, float]:
    """The ``size`` most useful pieces (count times length) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(int)

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()),
                                              pa.array(list(sums.values()), pa.int64())], names=["piece", "n", "cnt"])
            sums.clear()
            return out

        for b in batches:
            for sym, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i in range(len(sym)):
                    piece = sym[i]
                    for k in range(2, min(longest, len(sym) - i) + 1):
                        piece += sym[i + k - 1]
                        sums[(piece, k)] += c
            if len(sums) > 1_000_000:
                yield rows()
        if sums:
            yield rows()

    counts = (words.select("symbols", "cnt").mapInArrow(run, "piece string, n int, cnt long")
              .groupBy("piece", "n").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") > 1))
    top = counts.orderBy((F.col("cnt") * F.col("n")).desc(), "piece").limit(size).collect()
    return {r["piece"]: float(r["cnt"]) for r in top}


def _expect(words: DataFrame, scores: dict, longest: int) -> dict[str, float]:
    trie = _Trie(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, has = np.zeros(len(trie.pieces)), np.zeros(len(trie.pieces), bool)
        for b in batches:
            x, some = _expected(trie, b.column(0), b.column(1).to_numpy(), longest)
            sums, has = sums + x, has | some
        found = np.flatnonzero(has)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([trie.pieces[i] for i in found]), pa.array(sums[found])], names=["piece", "x"])

    rows = (words.select("symbols", "cnt").mapInArrow(run, "piece string, x double")
            .groupBy("piece").agg(F.sum("x").alias("x")).collect())
    return {r["piece"]: r["x"] for r in rows}


def _normalised(counts: dict[str, float], required: list[str]) -> dict[str, float]:
    floor = 1e-3
    full = {**{p: floor for p in required}, **{p: max(c, floor) for p, c in counts.items()}}
    total = math.log(sum(full.values()))
    return {p: math.log(c) - total for p, c in full.items()}


def train_unigram(corpus: DataFrame, vocab_size: int, text: str = "text", coverage: float = 0.9995,
                  longest: int = 8, seed_factor: int = 8, shrink: float = 0.6, em_steps: int = 2,
                  preset: str | None = None) -> UnigramModel:
    """EM over a seed of frequent pieces, pruned to ``vocab_size`` entries.

    Every symbol of the alphabet (characters within ``coverage``, and the 256
    byte symbols) stays, so any text can be encoded.  The preset table's
    ``unigram`` rows (T06) bound the alphabet and the seed's counts.
    """
    if preset is not None and PRESETS[preset]["model"] != "unigram":
        raise ValueError(f"preset {preset!r} trains a {PRESETS[preset]['model']} model")
    words, alphabet = sp_words_table(corpus, text, coverage)
    words = dealt_out(words.select("word", "cnt", "symbols"), WORDS_PER_TASK)
    if len(CONTROL) + len(alphabet) >= vocab_size:
        raise ValueError(f"the alphabet alone has {len(alphabet)} entries; ask for a larger vocabulary than {vocab_size}")
    room = vocab_size - len(CONTROL) - len(alphabet)
    counts = _seed(words, room * seed_factor, longest)
    scores, rounds, fixed = _normalised(counts, alphabet), 0, set(alphabet)
    while True:
        for _ in range(em_steps):
            counts = _expect(words, scores, longest)
            scores = _normalised({p: c for p, c in counts.items() if p in scores}, alphabet)
            rounds += 1
        multi = sorted((p for p in scores if p not in fixed), key=lambda p: (-counts.get(p, 0.0), p))
        if len(multi) <= room:
            break
        kept = set(multi[:max(room, int(len(multi) * shrink))])
        scores = _normalised({p: c for p, c in counts.items() if p in kept or p in fixed}, alphabet)
    order = sorted(scores, key=lambda p: (-scores[p], p))
    rows = [(t, i, 0.0) for i, t in enumerate(CONTROL)] + [(p, i + len(CONTROL), scores[p]) for i, p in enumerate(order)]
    return UnigramModel(corpus.sparkSession.createDataFrame(rows, "token string, id int, score double"), rounds)


def encode(docs: DataFrame, model: UnigramModel, key: list[str], text: str = "text", specials: bool = True) -> DataFrame:
    """``(key…, input_ids, pieces)`` by the best path of each piece of X05, without a shuffle.

    Characters outside the vocabulary become their byte symbols.
    """
    rows = model.vocab.collect()  # bounded by the vocabulary's size
    ids = {r["token"]: r["id"] for r in rows}
    scores = {r["token"]: r["score"] for r in rows if r["token"] not in CONTROL}
    longest = max((len(t) for t in scores if not t.startswith("<0x")), default=1)
    unknown = min(scores.values(), default=0.0) - 10.0
    types = {c: docs.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", input_ids array<int>, pieces array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            def __missing__(self, word):
                if len(self) >= WORDS_HELD:
                    self.clear()
                sym = [s for ch in word for s in ([ch] if ch in scores else [f"<0x{x:02X}>" for x in ch.encode()])]
                v = self[word] = [sys.intern(p) for p in best_path(sym, scores, longest, unknown)]
                return v

        known = Known()
        for b in (x.slice(i, TEXTS_HELD) for x in batches for i in range(0, x.num_rows, TEXTS_HELD)):
            pieces = [[p for w in words or () for p in known[w]] for words in b.column(len(key)).to_pylist()]
            out = [[ids.get(p, UNK_ID) for p in ps] for ps in pieces]
            if specials:
                out = [[BOS_ID, *x, EOS_ID] for x in out]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(key)], pa.array(out, pa.list_(pa.int32())),
                                              pa.array(pieces, pa.list_(pa.string()))], names=[*key, "input_ids", "pieces"])

    return docs.select(*key, sp_pretokens(sp_normalize(F.col(text))).alias("_w")).mapInArrow(run, schema)
