"""Token counts by trie-shared dynamic programming over a unigram model.

A document's tokens are counted under the most probable segmentation of its
pre-tokens.  Distinct pre-tokens go into a trie; a node's forward score (the
best score of any segmentation of its prefix) is worked out once, from the
nodes above it, however many pre-tokens share the prefix.  Where a pre-token
ends, the count of tokens on its best path is stored; documents then add up
stored counts.

The vocabulary is a public one.  It has no unigram probabilities, so a piece's
log-probability follows from its rank by Zipf's law, ``-ln(rank + 2)``; a
character outside the vocabulary costs one byte token for each of its UTF-8
bytes, as that vocabulary's byte fallback does.  Ties go to fewer tokens.

A pre-token is a run of U+2581 (for spaces) and what follows up to the next
one; a text starts with one U+2581.  Null and empty texts have no tokens.
Repeated rows are counted each, an empty table gives no rows, and only the id
and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def piece_scores(model_path: str) -> tuple[dict[str, float], float]:
    """Log-probability of each ordinary piece, and of a byte token."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores, rank, byte = {}, 0, None
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        scores[sp.id_to_piece(i)] = -math.log(rank + 2)
        rank += 1
    byte = -math.log(rank + 2)
    return scores, byte


class PrefixTrie:
    """Forward scores along the trie of distinct pre-tokens; ``counts`` keeps tokens at their ends.

    New pre-tokens are inserted in sorted order, which visits their trie depth
    first: the branch down to the current node is all that has to be held, and a
    node's score is worked out once for all pre-tokens below it, however many
    there are.  A node is (score, tokens, open): ``open`` are the pieces being
    matched when it is reached, as (score and tokens at the piece's start,
    place in the piece trie).  ``room`` bounds the bytes of the stored counts; a
    full table starts anew.  ``nodes`` counts the nodes worked out.
    """

    #: Bytes that a stored count takes beside its pre-token's own.
    ENTRY = 200

    def __init__(self, scores: dict[str, float], byte: float, room: int = 32 << 20):
        self.byte, self.room = byte, room
        self.pieces: dict = {}
        for piece, s in scores.items():
            at = self.pieces
            for ch in piece:
                at = at.setdefault(ch, {})
            at[""] = s  # no character is empty, so this key marks an end
        self.forget()
        self.nodes = 0

    def forget(self) -> None:
        """Drop the stored counts; the pieces stay."""
        self.counts: dict[str, int] = {}
        self.held = 0

    def _below(self, node: tuple, ch: str) -> tuple:
        """The node under ``node``: its open pieces go on, new ones start at ``node``."""
        best, tokens, open_ = -math.inf, 0, []
        score, count, state = node[0], node[1], self.pieces.get(ch)
        whole = state is not None and "" in state
        if state is not None:
            open_.append((score, count, state))
            if whole:
                best, tokens = score + state[""], count + 1
        if not whole:  # not a piece by itself: bytes
            n = len(ch.encode("utf-8", "surrogatepass"))
            best, tokens = score + n * self.byte, count + n
        for score, count, state in node[2]:
            state = state.get(ch)
            if state is not None:
                open_.append((score, count, state))
                s = state.get("")
                if s is not None:
                    s += score
                    if s > best or s == best and count + 1 < tokens:
                        best, tokens = s, count + 1
        return best, tokens, open_

    def insert(self, pre_tokens: Iterable[str]) -> None:
        """Work out and store the counts of all pre-tokens that have none."""
        counts, below = self.counts, self._below
        branch: list[tuple] = [(0.0, 0, [])]  # node of each prefix of the last pre-token
        last = ""
        for word in sorted(w for w in pre_tokens if w not in counts):
            shared = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                shared += 1
            del branch[shared + 1:]
            node = branch[-1]
            for ch in word[shared:]:
                node = below(node, ch)
                branch.append(node)
            self.nodes += len(word) - shared
            counts[word] = node[1]
            last = word

    def totals(self, documents: list[list[str]]) -> list[int]:
        """Tokens of each document's pre-tokens."""
        new = {w for pres in documents for w in pres if w not in self.counts}
        size = sum(map(len, new)) + self.ENTRY * len(new)
        if self.held + size > self.room and self.counts:
            self.forget()
            new = {w for pres in documents for w in pres}
            size = sum(map(len, new)) + self.ENTRY * len(new)
        self.held += size
        self.insert(new)
        get = self.counts.__getitem__
        return [sum(map(get, pres)) for pres in documents]


PRE_TOKENS = re.compile(f"{MARK}+[^{MARK}]*").findall


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKENS(MARK + text.replace(" ", MARK)) if text else []


def _worker(path: str) -> PrefixTrie:
    """One trie of pieces for a Python worker's life (its size is the vocabulary's); counts last for a partition."""
    import sys
    import types

    kept = sys.modules.setdefault("textloom_worker_state", types.ModuleType("textloom_worker_state"))
    key = f"trie:{path}"
    if key not in kept.__dict__:
        kept.__dict__[key] = PrefixTrie(*piece_scores(path))
    return kept.__dict__[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _worker(model_path)
        for b in batches:
            pres, tokens = [], []
            part: list[list[str]] = []
            held = 0

            def flush():
                nonlocal held
                pres.extend(map(len, part))
                tokens.extend(trie.totals(part))
                part.clear()
                held = 0

            for text in b.column(1):
                text = text.as_py()
                part.append(pre_tokens(text))
                held += len(text or "")
                if held >= 1 << 20:  # code points, so long pre-tokens count as what they hold
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pres, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_pre_tokens", "n_tokens"])
        trie.forget()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_pre_tokens long, n_tokens long")
