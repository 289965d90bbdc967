"""Evaluation: stride windows, an n-gram scorer and perplexity.

The reference scores windows with a neural model; here the per-token
negative log-likelihood comes from an add-k bigram model counted in Spark
(or any scorer a user supplies).  A window's sum is a difference of running
sums.  A model of a small vocabulary is a table inside the function that
scores; one of any vocabulary stays a Spark table (``bigram_model``) and meets
the sequences by a shuffle, one block of sequences and its pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import safe_exp
from ..session import cut_lineage

#: Most pairs of a vocabulary whose model may be one table on the driver and in tasks (16 bytes each).
MAX_TABLE_PAIRS = 1 << 22
#: Tokens of a block of sequences; a block and its distinct pairs (24 bytes a token at most) are one task's group.
BLOCK_TOKENS = 1 << 20
#: Tokens that a task counts at a time, and distinct pairs that it holds at most.
COUNTED_TOKENS = 1 << 20
#: Sequences whose windows a task holds at a time.
SCORED_ROWS = 256


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stride_windows(n, max_length: int = 2048, stride: int = 512) -> Column:
    """``array<struct<begin, end>>`` of the reference's windows: begins
    0, s, 2s, … ; end = min(begin + max, n); stop at the first reaching n."""
    nn = _c(n)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(nn - 1, F.lit(0)), F.lit(stride)),
                      lambda b: (b == 0) | (b - stride + max_length < nn))
    return F.transform(starts, lambda b: F.struct(b.alias("begin"), F.least(b + max_length, nn).alias("end")))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a task's sequences, counted ``COUNTED_TOKENS`` tokens at a time whatever the batches hold."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)),
                                           pa.array(counts)], names=["prev", "tok", "cnt"])

    for b in batches:
        tokens, ends = _flat(b.column(0))
        begins = np.zeros(len(tokens) + 1, bool)
        begins[ends] = True
        for at in range(0, len(tokens) - 1, COUNTED_TOKENS):
            part = tokens[at:at + COUNTED_TOKENS + 1]
            new, n = np.unique(_codes(part)[~begins[at + 1:at + len(part)]], return_counts=True)
            both, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            sums[where[:len(codes)]] = counts
            sums[where[len(codes):]] += n
            codes, counts = both, sums
            if len(codes) > COUNTED_TOKENS:
                yield rows()
                codes, counts = codes[:0], counts[:0]
    if len(codes):
        yield rows()


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all sequences as one array, and where each ends; a null is empty."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)


def ngram_counts(seqs: DataFrame, ids: str = "input_ids", vectorized: bool = True) -> DataFrame:
    """Bigram counts ``(prev, tok, cnt)``.

    ``vectorized``: a task's sequences are reduced to their distinct pairs with
    numpy (no row per token), then Spark sums the partial counts (one shuffle
    bounded by the number of distinct pairs).
    Otherwise pairs are exploded and counted with a plain aggregate."""
    if vectorized:
        part = seqs.select(ids).mapInArrow(_count_pairs, "prev int, tok int, cnt long")
        return part.groupBy("prev", "tok").agg(F.sum("cnt").alias("cnt"))
    s = F.col(ids)
    n1 = F.greatest(F.size(s) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(s, 1, n1).alias("prev"), F.slice(s, 2, n1).alias("tok"))
    return (seqs.select(F.explode(pairs).alias("p"))
            .groupBy(F.col("p.prev").alias("prev"), F.col("p.tok").alias("tok"))
            .agg(F.count(F.lit(1)).alias("cnt")))


class BigramScorer:
    """Add-k bigram model as arrays, ``-log((c(prev,tok)+k) / (c(prev)+k·V))``.

    Its size is at most V² pairs, and ``bigram_scorer`` takes only vocabularies
    with V² up to ``MAX_TABLE_PAIRS``, so it is collected once and ships with the
    function that scores (Spark broadcasts functions of more than a megabyte).
    Calling it with a sequence gives the nll of positions 1..n-1.
    """

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, vocab_size: int, k: float = 1.0):
        order = np.argsort(pairs, kind="stable")
        self.pairs, counts = pairs[order], counts[order].astype(np.float64)
        self.contexts, first = np.unique(self.pairs >> 32, return_index=True)
        total = np.add.reduceat(counts, first) if len(counts) else np.zeros(0)
        self.unseen = -np.log(k / (total + k * vocab_size))
        self.nll = -np.log((counts + k) / (np.repeat(total, np.diff(np.append(first, len(counts)))) + k * vocab_size))
        self.no_context = float(np.log(vocab_size))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        prev, tok = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        out = np.full(len(prev), self.no_context)
        if not len(self.pairs) or not len(prev):
            return out
        c = np.minimum(np.searchsorted(self.contexts, prev), len(self.contexts) - 1)
        known = self.contexts[c] == prev
        out[known] = self.unseen[c[known]]
        code = (prev << 32) | tok
        i = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        seen = self.pairs[i] == code
        out[seen] = self.nll[i[seen]]
        return out


def bigram_scorer(counts: DataFrame, vocab_size: int, k: float = 1.0) -> BigramScorer:
    """The model of a small vocabulary as one table; larger ones take ``bigram_model``."""
    if vocab_size * vocab_size > MAX_TABLE_PAIRS:
        raise ValueError(f"{vocab_size}² pairs may pass {MAX_TABLE_PAIRS}: use bigram_model")
    rows = counts.select("prev", "tok", "cnt").toPandas()
    code = (rows["prev"].to_numpy(np.int64) << 32) | rows["tok"].to_numpy(np.int64)
    return BigramScorer(code, rows["cnt"].to_numpy(), vocab_size, k)


@dataclass
class BigramModel:
    """E03 over any vocabulary: ``pairs(prev, tok, nll)``, ``contexts(prev, unseen)``, both Spark tables,
    and the nll after a context that the model never saw."""

    pairs: DataFrame
    contexts: DataFrame
    no_context: float


def bigram_model(counts: DataFrame, vocab_size: int, k: float = 1.0) -> BigramModel:
    """Add-k bigram model as tables; nothing of it reaches the driver."""
    counts = cut_lineage(counts.select("prev", "tok", "cnt"))
    room = F.lit(float(k * vocab_size))
    contexts = cut_lineage(counts.groupBy("prev").agg(F.sum("cnt").alias("total")))
    nll = -F.log((F.col("cnt") + F.lit(float(k))) / (F.col("total") + room))
    return BigramModel(counts.join(contexts, "prev").select("prev", "tok", nll.alias("nll")),
                       contexts.select("prev", (-F.log(F.lit(float(k)) / (F.col("total") + room))).alias("unseen")),
                       float(np.log(vocab_size)))


def _windows(nll: np.ndarray, n: int, max_length: int, stride: int, mode: str, at: int = 1) -> tuple[np.ndarray, ...]:
    """``begin, end, sum of nll, scored tokens`` of the windows that score some of the given
    positions (``at`` and on, of a sequence of n); a window counts only what is given.

    reference: windows of E01; a token j is scored in every window with
    begin < j < end (overlaps counted again).
    standard: window i covers targets [i, min(i+s, n)); every token once.
    """
    run = np.concatenate([[0.0], np.cumsum(nll)])  # run[j] = nll of the first j given positions
    stop = at + len(nll)
    if mode == "reference":
        low = max(0, -((max_length - 1 - at) // stride))
        high = min((stop - 2) // stride, max(0, -((max_length - n) // stride)))
        begin = np.arange(low, high + 1, dtype=np.int64) * stride
        end = np.minimum(begin + max_length, n)
        first = begin + 1
    else:
        begin = np.arange(at // stride, (stop - 1) // stride + 1, dtype=np.int64) * stride
        end = np.minimum(begin + stride, n)
        first = np.maximum(begin, 1)
    first, past = np.maximum(first, at), np.minimum(end, stop)
    some = past > first
    begin, end, first, past = begin[some], end[some], first[some], past[some]
    return begin, end, run[past - at] - run[first - at], past - first


def score_windows(seqs: DataFrame, scorer, key: list[str], max_length: int = 2048, stride: int = 512,
                  mode: str = "reference", ids: str = "input_ids") -> DataFrame:
    """E01 + E03 in one pass: ``(key…, n, begin, end, loss, trg_len)``, a row a window.

    ``scorer(ids)`` gives the nll of positions 1..n-1 of a sequence (a bigram
    table, or any user's model); window sums come from a running sum inside
    the Arrow batch, so there are no token rows and no shuffle.  A
    ``BigramModel`` meets the sequences by a shuffle instead.
    """
    if mode not in ("reference", "standard"):
        raise ValueError(f"mode is reference or standard, not {mode!r}")
    if isinstance(scorer, BigramModel):
        return _score_by_shuffle(seqs, scorer, key, max_length, stride, mode, ids)
    types = {c: seqs.schema[c].dataType.simpleString() for c in key}
    extra = [("n", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("loss", pa.float64()), ("trg_len", pa.int64())]
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", n long, begin long, end long, loss double, trg_len long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, SCORED_ROWS) for x in batches for i in range(0, x.num_rows, SCORED_ROWS)):
            rows, cols = [], [[] for _ in extra]
            tokens, ends = _flat(b.column(len(key)))
            for r, seq in enumerate(np.split(tokens, ends[:-1])):
                n = len(seq)
                if n < 2:
                    continue
                begin, end, total, count = _windows(scorer(seq), n, max_length, stride, mode)
                rows += [r] * len(begin)
                for c, v in zip(cols, (np.full(len(begin), n), begin, end, total / count, end - begin)):
                    c.extend(v.tolist())
            keys = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:len(key)]]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, (_, t) in zip(cols, extra)],
                                             names=[*key, *[x for x, _ in extra]])

    return seqs.select(*key, ids).mapInArrow(run, schema)


def _blocks(seqs: DataFrame, key: list[str], ids: str, block_tokens: int) -> DataFrame:
    """``(key…, tl_block, tl_seq, tl_n, tl_at, tl_ids)``: sequences dealt out to blocks of at most
    ``block_tokens`` tokens, long ones in slices.  A slice holds the token before
    its first scored position ``tl_at`` too.  Sequences of fewer than two tokens score nothing and go.
    """
    types = {c: seqs.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", tl_block long, tl_seq long, tl_n long, tl_at long, tl_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        block, seq, held = base, base, 0
        for b in batches:
            rows, cols, slices = [], [[], [], [], []], []
            lists = b.column(len(key))
            for r in range(b.num_rows):
                one = lists[r].values
                n = 0 if one is None else len(one)
                if n < 2:
                    continue
                seq += 1
                at = 1
                while at < n:
                    if held >= block_tokens:
                        block, held = block + 1, 0
                    size = min(n - at, block_tokens - held)
                    rows.append(r)
                    for c, v in zip(cols, (block, seq, n, at)):
                        c.append(v)
                    slices.append(one.slice(at - 1, size + 1).to_numpy(zero_copy_only=False).astype(np.int32))
                    held, at = held + size, at + size
            if rows:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in slices])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(slices)))
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(rows, pa.int64())) for c in b.columns[:len(key)]]
                    + [pa.array(c, pa.int64()) for c in cols] + [tokens],
                    names=[*key, "tl_block", "tl_seq", "tl_n", "tl_at", "tl_ids"])

    return seqs.select(*key, ids).mapInArrow(run, schema)


def _codes(ids: np.ndarray) -> np.ndarray:
    return (ids[:-1].astype(np.int64) << 32) | ids[1:].astype(np.int64)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``(tl_block, prev, tok)`` of a batch of slices (again in the next batch, which does no harm)."""
    for b in batches:
        block = b.column(0).to_numpy()
        for x in np.unique(block).tolist():
            part = b.column(1).filter(pa.array(block == x))
            codes = np.unique(np.concatenate([_codes(s.values.to_numpy()) for s in part]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), x)), pa.array((codes >> 32).astype(np.int32)),
                 pa.array((codes & 0xFFFFFFFF).astype(np.int32))], names=["tl_block", "prev", "tok"])


def _score_by_shuffle(seqs: DataFrame, model: BigramModel, key: list[str], max_length: int, stride: int, mode: str,
                      ids: str, block_tokens: int | None = None) -> DataFrame:
    """Windows scored by a model that is a table.

    Sequences are dealt out to blocks.  The distinct pairs of each block are
    joined with the model (a pair meets it once a block, however often it
    occurs; adaptive execution splits a hot pair's rows), then come back to
    their block, where running sums give each window's part.  Slices of one
    sequence add up by window.
    """
    blocks = cut_lineage(_blocks(seqs, key, ids, block_tokens or BLOCK_TOKENS))  # block numbers must not change
    pairs = blocks.select("tl_block", "tl_ids").mapInArrow(_block_pairs, "tl_block long, prev int, tok int")
    scored = (pairs.join(model.pairs, ["prev", "tok"], "left").join(model.contexts, "prev", "left")
              .select("tl_block", "prev", "tok", F.coalesce("nll", "unseen", F.lit(model.no_context)).alias("nll")))
    part = "tl_seq long, n long, begin long, end long, total double, cnt long"
    names = [f.split()[0] for f in part.split(", ")]

    def run(own, known):
        import pandas as pd

        code = (known["prev"].to_numpy(np.int64) << 32) | known["tok"].to_numpy(np.int64)
        order = np.argsort(code)
        code, nll = code[order], known["nll"].to_numpy()[order]
        cols: list[list] = [[] for _ in names]
        for seq, n, at, tokens in zip(own["tl_seq"], own["tl_n"], own["tl_at"], own["tl_ids"]):
            found = nll[np.searchsorted(code, _codes(np.asarray(tokens)))]
            begin, end, total, cnt = _windows(found, n, max_length, stride, mode, at)
            for c, v in zip(cols, (np.full(len(begin), seq), np.full(len(begin), n), begin, end, total, cnt)):
                c.append(v)
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(names, cols)})

    narrow = blocks.select("tl_block", "tl_seq", "tl_n", "tl_at", "tl_ids")
    parts = narrow.groupBy("tl_block").cogroup(scored.groupBy("tl_block")).applyInPandas(run, part)
    sums = parts.groupBy("tl_seq", "n", "begin", "end").agg(F.sum("total").alias("total"), F.sum("cnt").alias("cnt"))
    keys = blocks.where("tl_at = 1").select("tl_seq", *key)
    return sums.join(keys, "tl_seq").select(*key, "n", "begin", "end", (F.col("total") / F.col("cnt")).alias("loss"),
                                            (F.col("end") - F.col("begin")).alias("trg_len"))


def perplexity(windows: DataFrame, key: list[str], mode: str = "reference") -> DataFrame:
    """``exp(Σ loss·trg_len / Σ trg_len)`` (reference) or
    ``exp(Σ loss·trg_len / Σ n)`` with n summed once per sequence (standard)."""
    nll = F.sum(F.col("loss") * F.col("trg_len"))
    first = F.col("begin") < 2  # a sequence's first window begins at 0, or at 1 for a stride of 1
    total = F.sum("trg_len") if mode == "reference" else F.sum(F.when(first, F.col("n")))
    return windows.agg(F.round(safe_exp(nll / total), 6).alias("perplexity"), F.count(F.lit(1)).alias("n_windows"))


def per_text_perplexity(seqs: DataFrame, scorer, key: list[str], ids: str = "input_ids") -> DataFrame:
    """``exp(mean nll)`` of each text: one window as long as the text."""
    w = score_windows(seqs, scorer, key, 1 << 62, 1 << 62, "reference", ids)
    return w.select(*key, F.round(safe_exp("loss"), 6).alias("perplexity"))


def batch_mean_perplexity(per_row_loss: DataFrame, batch: str = "batch_id", loss: str = "loss") -> DataFrame:
    """Mean of per-batch mean losses, then ``exp`` (not token-weighted)."""
    b = per_row_loss.groupBy(batch).agg(F.avg(loss).alias("batch_loss"))
    return b.agg(F.round(F.avg("batch_loss"), 6).alias("eval_loss"),
                 F.round(safe_exp(F.avg("batch_loss")), 6).alias("perplexity"))
