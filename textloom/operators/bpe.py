"""Byte-level BPE as Spark jobs.

Training works on the distinct-word table ``(word, cnt, symbols)`` built by
one corpus shuffle (A03).  A round is one job: Arrow batches apply the newest
merges and count adjacent pairs (A04), and for the pairs likely to lead also
the symbols before and after them.  From those counts the driver settles as
many merges as one-merge-at-a-time BPE (count desc, left, right) would provably
pick next (``_choose_batch``).  The driver holds merges, the leading pairs and
their surroundings, all bounded by the vocabulary, never words.  Words are cut
from their lineage with reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (BYTE_ALPHABET, BYTE_DST, byte_fallback, byte_level, byte_level_decode, chars,
                              nfkc, pretokens, sp_normalize, sp_pretokens)
from ..functions.tokens import BOS_ID, EOS_ID, SPECIAL_TOKENS, UNK_ID
from ..session import cut_lineage
from . import speculate

# Speed presets (min_frequency floor, alphabet limit, model).
PRESETS = {
    "default": {"min_frequency": 2, "limit_alphabet": None, "model": "bpe"},
    "fast": {"min_frequency": 5, "limit_alphabet": 10000, "model": "bpe"},
    "turbo": {"min_frequency": 10, "limit_alphabet": 5000, "model": "bpe"},
    "ultrafast": {"min_frequency": 3, "limit_alphabet": 10000, "model": "unigram"},
}


@dataclass
class BpeModel:
    vocab: DataFrame    # token STRING, id INT
    merges: DataFrame   # rank INT, l STRING, r STRING
    name: str = "bpe"
    rounds: int = 0

    def vocab_size(self) -> int:
        return self.vocab.count()


@dataclass
class Tokenizer:
    """A loaded artefact (S16) with encode and decode bound to it."""

    model: BpeModel

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Tokenizer":
        from ..sources.files import read_tokenizer_json
        vocab, merges, info = read_tokenizer_json(spark, path)
        kind = info.first()["type"]
        if kind != "BPE":
            raise ValueError(f"{path} holds a {kind} model, not BPE")
        return cls(BpeModel(cut_lineage(vocab), cut_lineage(merges), path))

    def save(self, path: str) -> None:
        from ..sources.sinks import write_tokenizer_json
        write_tokenizer_json(self.model.vocab, self.model.merges, path)

    def encode(self, docs: DataFrame, key: list[str], text: str = "text", **kw) -> DataFrame:
        return encode(docs, self.model, key, text, **kw)

    def decode(self, seqs: DataFrame, key: list[str], ids: str = "input_ids", **kw) -> DataFrame:
        return decode(seqs, self.model.vocab, key, ids, **kw)


def words_table(corpus: DataFrame, text: str = "text", normalize: bool = True) -> DataFrame:
    """NFKC -> pre-tokens -> distinct words with counts, byte-level string
    ``bl`` and its symbols (initially one per byte)."""
    t = nfkc(F.col(text)) if normalize else F.col(text)
    w = (corpus.select(F.explode(pretokens(t)).alias("word"))
         .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
    return w.withColumn("bl", byte_level("word")).withColumn("symbols", chars(F.col("bl")))


def sentences(corpus: DataFrame, text: str = "text", max_sentence_length: int = 16384) -> DataFrame:
    """T05 input: one row per input line, with ``too_long`` where it exceeds
    ``max_sentence_length`` UTF-8 bytes (the trainer's limit is per line)."""
    lines = corpus.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    return lines.withColumn("too_long", F.octet_length("line") > max_sentence_length)


def sentence_report(corpus: DataFrame, text: str = "text", max_sentence_length: int = 16384) -> DataFrame:
    """How many lines and characters T05 reads, and how many lie in lines over the limit."""
    s = sentences(corpus, text, max_sentence_length)
    n, long = F.length("line"), F.col("too_long")
    return s.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(n), F.lit(0)).alias("n_chars"),
                 F.coalesce(F.sum(long.cast("long")), F.lit(0)).alias("n_long_lines"),
                 F.coalesce(F.sum(F.when(long, n)), F.lit(0)).alias("n_long_chars"))


def sp_words_table(corpus: DataFrame, text: str = "text", coverage: float = 0.9995,
                   max_sentence_length: int = 16384, long_lines: str = "keep") -> tuple[DataFrame, list[str]]:
    """T05 input: lines, ``nmt_nfkc_cf`` normalisation (X02), SentencePiece-style
    pieces (X05), character symbols; characters outside the ``coverage``
    share (A06) fall back to ``<0xNN>`` byte symbols.  Lines longer than
    ``max_sentence_length`` bytes are read like any other; ``long_lines="skip"``
    leaves them out, and ``sentence_report`` counts them either way.  Returns
    the word table and the alphabet (kept characters + 256 byte symbols)."""
    from .stats import character_coverage
    if long_lines not in ("keep", "skip"):
        raise ValueError("long_lines is keep or skip")
    s = sentences(corpus, text, max_sentence_length)
    if long_lines == "skip":
        s = s.filter(~F.col("too_long"))
    # normalisation and pieces never reach over a space, so each distinct stretch between spaces is read once
    stretches = s.select(F.explode(F.split("line", " ")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    words = cut_lineage(stretches.select(F.explode(sp_pretokens(sp_normalize(F.col("x")))).alias("word"), "n")
                        .groupBy("word").agg(F.sum("n").alias("cnt")))
    by_char = (words.select(F.explode(chars("word")).alias("ch"), "cnt")
               .groupBy("ch").agg(F.sum("cnt").alias("cnt")))
    cc = character_coverage(by_char, coverage)
    kept = sorted(r["ch"] for r in cc.collect())      # bounded by the size of Unicode
    w = words
    syms = F.flatten(F.transform(chars("word"), lambda c: F.when(c.isin(kept), F.array(c)).otherwise(byte_fallback(c))))
    w = w.withColumn("symbols", syms).withColumn("bl", F.array_join("symbols", ""))
    alphabet = kept + [f"<0x{b:02X}>" for b in range(256)]
    return w, alphabet


# ---------------------------------------------------------------------------
# Training: speculated sequences of merges (speculate.py)
# ---------------------------------------------------------------------------

WORDS_PER_TASK = 40_000


def train_bpe(corpus: DataFrame, vocab_size: int = 512, min_frequency: int = 2, text: str = "text",
              special_tokens: list[str] = SPECIAL_TOKENS, limit_alphabet: int | None = None,
              normalize: bool = True, batch: bool = True, followed: int = speculate.FOLLOWED,
              proposed: int = speculate.PROPOSED, tried: int = speculate.TRIED, checkpoint_every: int = 2048,
              words: DataFrame | None = None, name: str = "bpe",
              alphabet: list[str] | None = None, preset: str | None = None,
              known: set[str] = frozenset(), new: int = 0) -> BpeModel:
    """Train a byte-level BPE vocabulary of at most ``vocab_size`` entries; with ``new``, of as many
    more as it takes until ``new`` entries are not among ``known``.

    A round is one pass over the distinct words.  ``batch=False`` counts anew for every merge (the
    reference for tests); ``batch=True`` gives the same merges by sequences that tasks replay.
    """
    spark = corpus.sparkSession
    if preset is not None:                         # T06
        min_frequency = max(min_frequency, PRESETS[preset]["min_frequency"])
        limit_alphabet = PRESETS[preset]["limit_alphabet"]
        if PRESETS[preset]["model"] != "bpe":
            raise ValueError(f"preset {preset!r} trains a {PRESETS[preset]['model']} model, not merges")
    wt = words if words is not None else words_table(corpus, text, normalize)
    wt = dealt_out(wt.select("word", "cnt", "bl", "symbols"))
    # the byte alphabet is complete (256 symbols) and always kept, so an
    # alphabet cap (limit_alphabet) never removes anything in byte-level mode
    alphabet = list(alphabet) if alphabet is not None else list(BYTE_ALPHABET)
    n_vocab = len(special_tokens) + len(alphabet)
    merges: list[tuple[str, str, int]] = []
    fresh: list[tuple[str, str]] = []  # merges that the checkpointed words don't have yet
    tokens = set(special_tokens) | set(alphabet)
    added = tokens - known
    counts: dict[tuple[str, str], int] = {}
    told: dict[tuple[str, str], list] = {}  # the changes that merges proposed in vain would have made
    trial, floor, rounds, anew = None, 0, 0, True
    while n_vocab < vocab_size or len(added) < new:
        rounds += 1
        just_counted = anew
        to_come = vocab_size - n_vocab
        if len(added) < new:  # at most, all known entries that haven't come yet are among them
            to_come = max(to_come, new - len(added) + len(known - tokens))
        most = min(followed, 1000 + 16 * to_come)  # few merges to come need few pairs
        if anew:
            pairs = speculate.pair_counts(wt, fresh).where(F.col("cnt") >= min_frequency)
            if batch:
                counts, floor = speculate.leading(pairs, most)
            else:
                counts = {(r["l"], r["r"]): r["cnt"] for r in pairs.orderBy(F.col("cnt").desc(), "l", "r").limit(1).collect()}
        if not counts:
            break
        if not batch:
            (pair, c), = counts.items()
            chosen = [(*pair, c)]
        else:
            if trial is None:
                trial = speculate.Trial(speculate.typical(wt, tried))
            sequence = trial.propose(counts, tokens, min(proposed, to_come), floor, told)
            found, symbols = speculate.changes(wt, fresh, sequence, set(counts), max(floor, min_frequency - 1))
            deltas = speculate.by_step(found.toArrow(), symbols)
            chosen, anew = speculate.accept(counts, sequence, deltas, tokens, floor, min_frequency, just_counted)
            if not chosen and not anew:
                break  # the leading pair is under min_frequency, and so are all others
            counts, floor = speculate.followed_only(counts, floor, min(followed, 1000 + 4 * to_come))
            told = {m: d for m, d in told.items() if m in counts} | {m: deltas.get(i, []) for i, m in enumerate(sequence)}
            for l, r, _ in chosen:
                trial.merge((l, r))
                told.pop((l, r))
        for l, r, c in chosen:
            if n_vocab >= vocab_size and len(added) >= new:
                break
            merges.append((l, r, c))
            fresh.append((l, r))
            n_vocab += 1
            if l + r not in known:
                added.add(l + r)
        if len(fresh) >= checkpoint_every:
            wt, fresh = cut_lineage(_merged(wt, fresh)), []
    model = _model(spark, special_tokens, alphabet, merges, name)
    model.rounds = rounds
    return model


def dealt_out(words: DataFrame, per_task: int = WORDS_PER_TASK) -> DataFrame:
    """The words in a checkpoint, in partitions by their number: training rounds
    revisit them, and the shuffle that counted them may have left a few large ones."""
    w = cut_lineage(words)
    parts = w.count() // per_task + 1
    return cut_lineage(w.repartition(parts)) if parts > w.rdd.getNumPartitions() else w


def _merged(words: DataFrame, merges: list) -> DataFrame:
    """The words with ``merges`` applied, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in speculate.joined(batches, 3):
            sym = speculate.merged(b.column(3), b.column(1), {}, merges).symbols()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sym], names=b.schema.names)

    return words.select("word", "cnt", "bl", "symbols").mapInArrow(
        run, "word string, cnt long, bl string, symbols array<string>")


def _model(spark: SparkSession, special_tokens, alphabet, merges, name) -> BpeModel:
    tokens = list(special_tokens) + list(alphabet)
    seen = set(tokens)
    for l, r, _ in merges:
        if l + r not in seen:
            tokens.append(l + r)
            seen.add(l + r)
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")
    mg = spark.createDataFrame([(i, l, r) for i, (l, r, _) in enumerate(merges)], "rank int, l string, r string")
    return BpeModel(vocab, mg, name)


# ---------------------------------------------------------------------------
# Encoding: distinct words once (Arrow UDF), then joins
# ---------------------------------------------------------------------------

def _bpe_word(symbols: list[str], ranks: dict) -> list[str]:
    syms = list(symbols)
    while len(syms) > 1:
        best, best_rank = None, None
        for a, b in zip(syms, syms[1:]):
            rk = ranks.get((a, b))
            if rk is not None and (best_rank is None or rk < best_rank):
                best, best_rank = (a, b), rk
        if best is None:
            break
        out, i = [], 0
        while i < len(syms):
            if i + 1 < len(syms) and syms[i] == best[0] and syms[i + 1] == best[1]:
                out.append(best[0] + best[1])
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def encode_words(words: DataFrame, model: BpeModel, word: str = "word") -> DataFrame:
    """X06 on distinct words: ``(word, tokens ARRAY<STRING>, ids ARRAY<INT>)``.

    The merge ranks (bounded by the vocabulary size) are shipped once per
    task through the UDF closure; token -> id is a join (J01) with the
    vocabulary, unknown tokens -> ``<unk>``.
    """
    ranks = {(r["l"], r["r"]): r["rank"] for r in model.merges.collect()}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def bpe(sym: pd.Series) -> pd.Series:
        return sym.map(lambda s: _bpe_word(list(s), ranks))

    enc = words.select(word, bpe(chars(byte_level(word))).alias("tokens"))
    return lookup_ids(enc, model.vocab, key=[word])


def lookup_ids(df: DataFrame, vocab: DataFrame, key: list[str], tokens: str = "tokens",
               unk_id: int = UNK_ID) -> DataFrame:
    """Token -> id with ``<unk>`` for misses; the vocabulary (bounded by
    the requested size) is broadcast; order is restored by position."""
    ex = df.select(*key, F.posexplode(tokens).alias("pos", "token"))
    j = ex.join(F.broadcast(vocab.select("token", "id")), "token", "left")
    g = j.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "id"))).alias("_t"))
    return g.select(*key, F.transform("_t", lambda x: x["token"]).alias(tokens),
                    F.transform("_t", lambda x: F.coalesce(x["id"], F.lit(unk_id))).alias("ids"))


#: Words whose ids a task remembers; texts whose new words it merges together; texts that it encodes or decodes at a time.
WORDS_HELD, TEXTS_MET, TEXTS_HELD = 100_000, 2048, 256


def _tables(model: BpeModel):
    """Merge ranks and token ids (bounded by the vocabulary's size), for the tasks."""
    ranks = {(r["l"], r["r"]): r["rank"] for r in model.merges.collect()}
    ids = {r["token"]: r["id"] for r in model.vocab.collect()}
    return model.vocab.sparkSession.sparkContext.broadcast((ranks, ids))


def encode(docs: DataFrame, model: BpeModel, key: list[str], text: str = "text",
           specials: bool = True, max_length: int | None = None) -> DataFrame:
    """X06 + J01 + X08 (+ X09) over documents: ``(key…, input_ids)``, without a shuffle.

    Pre-tokens come from the JVM; each Arrow batch maps them through a table
    of words that the task has met (bounded; it starts anew when full), so a
    word is merged once and a frequent word costs a look-up.  ``max_length``
    truncates, template tokens included.
    """
    tables = _tables(model)
    pre = docs.select(*key, pretokens(nfkc(F.col(text))).alias("_words"))
    types = {c: docs.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", input_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids = tables.value

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= WORDS_HELD:
                    self.clear()
                symbols = [BYTE_DST[x] for x in word.encode("utf-8", "surrogatepass")]
                v = self[word] = np.array([ids.get(t, UNK_ID) for t in _bpe_word(symbols, ranks)], np.int32)
                return v

        known, room = Known(), None if max_length is None else max(max_length - 2 * specials, 0)
        merges = sorted(ranks, key=ranks.get) if in_rank_order(ranks) else None

        def met():
            for x in (x.slice(i, TEXTS_MET) for x in batches for i in range(0, x.num_rows, TEXTS_MET)):
                if merges is not None:
                    words = pc.unique(x.column(len(key)).flatten()).to_pylist()
                    new = [w for w in words if w not in known]
                    if len(known) + len(new) > WORDS_HELD:
                        known.clear()
                        new = words[:WORDS_HELD]
                    known.update(zip(new, _merged_ids(new, merges, ids)))
                yield from (x.slice(i, TEXTS_HELD) for i in range(0, x.num_rows, TEXTS_HELD))

        for b in met():
            yield pa.RecordBatch.from_arrays([*b.columns[:len(key)], _sequences(b.column(len(key)), known, room, specials)],
                                             names=[*key, "input_ids"])

    return pre.mapInArrow(run, schema)


def in_rank_order(ranks: dict[tuple[str, str], int]) -> bool:
    """Whether a merge never makes a pair of lower rank, so that merges taken in order give what the least rank first
    gives: a token comes from one merge, after those of its parts, and none is a byte's symbol."""
    made = {}
    for (l, r), rank in sorted(ranks.items(), key=lambda x: x[1]):
        if l + r in made or len(l + r) < 2:
            return False
        made[l + r] = rank
    return all(made.get(x, -1) < rank for pair, rank in ranks.items() for x in pair)


def _merged_ids(words: list[str], merges: list[tuple[str, str]], ids: dict[str, int]) -> list[np.ndarray]:
    """The ids of words merged together, each merge over all of them."""
    if not words:
        return []
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    symbols = pa.array(BYTE_DST, pa.string()).take(pa.array(np.frombuffer(b"".join(data), np.uint8)))
    offsets = pa.array(np.append(0, np.cumsum([len(x) for x in data])), pa.int32())
    names: dict[str, int] = {}
    w = speculate.merged(pa.ListArray.from_arrays(offsets, symbols), pa.array(np.zeros(len(words), np.int64)), names, merges)
    numbers = np.array([ids.get(x, UNK_ID) for x in names], np.int32)
    flat, upto = numbers[w.at[w.at >= 0]], np.append(0, np.cumsum(w.at >= 0)[w.ends]).tolist()
    return [flat[a:b] for a, b in zip(upto, upto[1:])]


def _sequences(texts: pa.ListArray, known: dict[str, np.ndarray], room: int | None, specials: bool) -> pa.ListArray:
    """The ids of texts that are lists of words, at most ``room`` of them and the template's around them."""
    words = texts.flatten().dictionary_encode()
    of = [known[w] for w in words.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in of], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = words.indices.to_numpy()
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    flat = np.concatenate(of)[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))] if of else np.zeros(0, np.int32)
    upto = np.append(0, ends)[np.append(0, np.cumsum(texts.value_lengths().fill_null(0).to_numpy()))]  # of the ids, by text
    lengths = np.diff(upto)
    if room is not None:
        flat = flat[np.arange(len(flat)) - np.repeat(upto[:-1], lengths) < room]
        lengths = np.minimum(lengths, room)
    offsets = np.append(0, np.cumsum(lengths + 2 * specials))
    if specials:
        out = np.empty(int(offsets[-1]), np.int32)
        inside = np.ones(len(out), bool)
        out[offsets[:-1]], out[offsets[1:] - 1] = BOS_ID, EOS_ID
        inside[offsets[:-1]] = inside[offsets[1:] - 1] = False
        out[inside] = flat
        flat = out
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def decode(seqs: DataFrame, vocab: DataFrame, key: list[str], ids: str = "input_ids",
           skip_special: bool = True, n_special: int = len(SPECIAL_TOKENS)) -> DataFrame:
    """X15 + J02: ids -> tokens (unknown ids and, by default, specials are
    skipped) -> byte-level string -> UTF-8 text, in position order; no shuffle."""
    names = vocab.sparkSession.sparkContext.broadcast({r["id"]: r["token"] for r in vocab.collect()})
    types = {c: seqs.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", _bl string"
    floor = n_special if skip_special else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {i: t for i, t in names.value.items() if i >= floor}
        numbers, tokens = pa.array(list(known), pa.int64()), pa.array([*known.values(), ""], pa.string())
        for b in (x.slice(i, TEXTS_HELD) for x in batches for i in range(0, x.num_rows, TEXTS_HELD)):
            seq = b.column(len(key))
            at = pc.index_in(seq.flatten().cast(pa.int64()), numbers).fill_null(len(known))
            offsets = pa.array(np.append(0, np.cumsum(seq.value_lengths().fill_null(0).to_numpy())), pa.int32())
            out = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.take(at)), "")
            yield pa.RecordBatch.from_arrays([*b.columns[:len(key)], out], names=[*key, "_bl"])

    d = seqs.select(*key, ids).mapInArrow(run, schema)
    return d.select(*key, byte_level_decode("_bl").alias("text"))


def roundtrip_mismatches(docs: DataFrame, model: BpeModel, key: list[str], text: str = "text") -> DataFrame:
    """Documents whose ``decode(encode(t))`` differs from the NFKC text
    with the byte-level prefix space."""
    enc = encode(docs, model, key, text)
    dec = decode(enc, model.vocab, key)
    ref = docs.select(*key, nfkc(F.col(text)).alias("_n")).select(
        *key, F.when((F.col("_n") == "") | F.col("_n").startswith(" "), F.col("_n"))
        .otherwise(F.concat(F.lit(" "), F.col("_n"))).alias("expected"))
    cmp = ref.join(dec, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return cmp.agg(F.count(F.lit(1)).alias("n_docs"),
                   F.sum((F.col("text") != F.col("expected")).cast("int")).cast("bigint").alias("n_mismatch"))


# ---------------------------------------------------------------------------
# Vocabulary extension (T02): joins only
# ---------------------------------------------------------------------------

def extend_vocabulary(base: BpeModel, new_corpus: DataFrame, new_vocab_size: int, text: str = "text",
                      min_frequency: int = 2, preset: str = "default", **train_kw) -> BpeModel:
    """Keep every base id and merge, add ``new_vocab_size - |base|``
    tokens learned from (base tokens as seed text ∪ new corpus).

    The size trained is the reference's, one and a half times the tokens to
    add, and goes on while the alphabet and tokens that the base has already
    leave fewer new ones than asked for; fewer are added only if the text has no
    more pairs of ``min_frequency``.

    Stage 1 (J03 + W04) adds trained tokens missing from the base, in
    trained-id order, with ids ``max+1…``.  Stage 2 (J04 + J05) admits a
    new merge when it is not already present and both parts and the merged
    token are in the final vocabulary: after stage 1 either every trained
    token is in, or the budget is spent, so stage 2 never adds a token and
    needs no sequential loop.
    """
    spark = new_corpus.sparkSession
    cur = base.vocab.count()
    if new_vocab_size <= cur:
        raise ValueError(f"the base vocabulary has {cur} entries already; ask for more than that, not {new_vocab_size}")
    p = PRESETS[preset]
    min_frequency = max(min_frequency, p["min_frequency"])
    delta = new_vocab_size - cur
    train_size = int(delta * 1.5) + len(SPECIAL_TOKENS)
    known = {r["token"] for r in base.vocab.select("token").collect()}  # bounded by the vocabulary
    # F07 + U03: base tokens (their byte-level spelling, as stored) are seed text
    seeds = base.vocab.filter(~F.col("token").startswith("<") & (F.length("token") > 1)) \
        .select(F.col("token").alias(text))
    corpus = seeds.unionByName(new_corpus.select(text))
    trained = train_bpe(corpus, vocab_size=train_size, min_frequency=min_frequency, text=text,
                        known=known, new=delta, **train_kw)
    base_max = base.vocab.agg(F.max("id")).first()[0]
    # J03 + W04: new tokens in trained order, budget-capped
    from .windows import assign_new_ids
    new_tok = trained.vocab.join(base.vocab.select("token"), "token", "left_anti")
    added = assign_new_ids(new_tok, base_max, "id", budget=delta)
    final_vocab = base.vocab.select("token", "id").unionByName(added)
    # Merges not already present; J05: parts and result in the final vocabulary
    v = F.broadcast(final_vocab.select("token"))
    cand = trained.merges.join(base.merges.select("l", "r"), ["l", "r"], "left_anti")
    ok = (cand.join(v.withColumnRenamed("token", "l"), "l", "left_semi")
          .join(v.withColumnRenamed("token", "r"), "r", "left_semi")
          .withColumn("token", F.concat("l", "r")).join(v, "token", "left_semi"))
    n_base = base.merges.count()
    from pyspark.sql import Window
    new_merges = ok.withColumn("rank", (F.lit(n_base) - 1 + F.row_number().over(Window.orderBy("rank"))).cast("int"))
    final_merges = base.merges.select("rank", "l", "r").unionByName(new_merges.select("rank", "l", "r"))
    return BpeModel(cut_lineage(final_vocab), cut_lineage(final_merges), base.name + "_extended")


def curriculum(base: BpeModel, corpora: list[DataFrame], sizes: list[int], text: str = "text",
               **kw) -> list[BpeModel]:
    """A chain of extensions (e.g. 64K -> 80K -> 96K -> 128K), each
    extending the previous vocabulary with its own corpus."""
    out, cur = [], base
    for corpus, size in zip(corpora, sizes):
        cur = extend_vocabulary(cur, corpus, size, text=text, **kw)
        out.append(cur)
    return out


def train_sp_bpe(corpus: DataFrame, vocab_size: int, text: str = "text", coverage: float = 0.9995,
                 **kw) -> BpeModel:
    """SentencePiece-style BPE (X02 + X05 + A06 + byte fallback) on the
    same batched trainer; special ids pad0/bos1/eos2/unk3 come first."""
    words, alphabet = sp_words_table(corpus, text, coverage)
    return train_bpe(corpus, vocab_size=vocab_size, words=words, alphabet=alphabet, name="sp_bpe", **kw)


def special_token_report(vocab: DataFrame, special_tokens: list[str] = SPECIAL_TOKENS) -> DataFrame:
    """Each special token with its id, or flagged missing."""
    spark = vocab.sparkSession
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(special_tokens)], "token string, expected_id int")
    return (sp.join(vocab.select("token", "id"), "token", "left")
            .withColumn("present", F.col("id").isNotNull())
            .withColumn("id_matches", F.coalesce(F.col("id") == F.col("expected_id"), F.lit(False))))
