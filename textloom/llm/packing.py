"""Best-fit packing by a linear grouping scheme.

Documents become token pieces of at most ``limit`` tokens.  The planner sees
only the histogram of piece lengths (at most ``limit`` numbers, whatever the
corpus holds):

1. large lengths are cut into groups of equal cardinality and rounded up to
   the longest of their group, which leaves few sizes;
2. configurations of these sizes (which sizes share a sequence) are optimised
   by column generation over the fractional problem and rounded down;
3. actual lengths take the places of their group's size, but for the smallest
   place of a configuration of several;
4. what is left over and all small lengths go best-fit, longest first, into
   the tightest sequence that has room (rounding left the smallest places
   roomier than their size, so a longer length often fits).

Of a few numbers of groups the plan with the fewest sequences is taken.

Sequences with the same lengths are planned as one run, so the plan has a few
thousand rows at any scale.  Pieces then find their places by their rank among
the pieces of equal length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import ranked

# ---------------------------------------------------------------- token pieces


class _Worker:
    """Token ids (little-endian unsigned 32-bit) of white-space-free chunks, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its chunks' ids in a row.  Chunks of plain Latin-1 characters are cut
    into pre-tokens here and only unseen pre-tokens meet the merge model; all
    others go through the whole tokenizer.  Each table has two generations bounded
    by their bytes: a full one becomes the old one, and what is found there comes
    back, so frequent entries stay.  ``rest`` drops the old ones when a partition
    ends; a worker keeps ``2 * ROOM`` bytes at most for its next one.
    """

    ROOM = 40 << 20
    #: Bytes that an entry takes beside its key's and value's own, and those of an entry too long to keep.
    ENTRY, LONG = 180, 4096

    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The lower-cased pre-token pattern of the vocabulary file for Latin-1 text
        self.pre = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_map = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}
        worker = self

        class Bounded(dict):
            def __init__(self):
                self.size, self.old = 0, {}

            def __missing__(self, key):
                value = self.old.get(key)
                if value is None:
                    value = self.made(key)
                own = len(key) + len(value) + worker.ENTRY
                if own <= worker.LONG:
                    if self.size + own > worker.ROOM:
                        self.old = dict(self)
                        self.clear()
                        self.size = 0
                    self.size += own
                    self[key] = value
                return value

        class Pre(Bounded):
            def made(self, p):
                q = p.encode().decode("latin-1").translate(worker.byte_map)
                return np.array([t.id for t in worker.model.tokenize(q)], "<u4").tobytes()

        class Chunks(Bounded):
            def made(self, c):
                return worker.chunk(c.decode("utf-8", "surrogatepass"))

        self.pres, self.chunks = Pre(), Chunks()

    def rest(self) -> None:
        self.pres.old, self.chunks.old = {}, {}

    def chunk(self, s: str) -> bytes:
        if self.plain(s) and "<|" not in s:
            return b"".join(map(self.pres.__getitem__, self.pre(s.lower())))
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def _worker(path: str) -> _Worker:
    """One tokenizer for a Python worker's life (its size is the vocabulary's); its tables are bounded by their bytes."""
    import sys
    import types

    kept = sys.modules.setdefault("textloom_worker_state", types.ModuleType("textloom_worker_state"))
    if path not in kept.__dict__:
        kept.__dict__[path] = _Worker(path)
    return kept.__dict__[path]


#: Bytes of token ids that an output batch holds.
BATCH_BYTES = 8 << 20

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` tokens: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its token ids and then ``end_id``; null and blank texts are
    just ``end_id``.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        w = _worker(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

        def table(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        try:
            for b in batches:
                cols: list[list] = [[] for _ in names]
                held = 0
                for doc, text in zip(b.column(0), b.column(1)):  # one text at a time, not a batch's list
                    doc, ids = doc.as_py(), w.ids(text.as_py() or "") + end
                    for p, s in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[s:s + 4 * limit]
                        row = (doc, p, s // 4, len(part) // 4, zlib.crc32(part))
                        for c, v in zip(cols, row):
                            c.append(v)
                        if with_ids:
                            cols[5].append(np.frombuffer(part, "<i4"))
                            held += len(part)
                    if held >= BATCH_BYTES:
                        yield table(cols)
                        cols, held = [[] for _ in names], 0
                yield table(cols)
        finally:
            w.rest()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# --------------------------------------------------------------------- planning


def _best_configuration(sizes: np.ndarray, value: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of greatest value within ``limit``, by its number of lengths."""
    room = np.arange(limit + 1)[None, :] - sizes[:, None]
    fits, room = room >= 0, np.maximum(room, 0)
    best, picks = np.zeros(limit + 1), []
    for _ in range(limit // int(sizes.min())):
        more = np.where(fits, best[room] + value[:, None], -1.0)
        pick = more.argmax(axis=0)
        top = more[pick, np.arange(limit + 1)]
        better = top > best + 1e-12
        if not better[limit]:
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    out, c = np.zeros(len(sizes), int), limit
    for pick in reversed(picks):
        if pick[c] >= 0:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[limit]), out


def optimise_configurations(sizes: np.ndarray, demand: np.ndarray, limit: int,
                            rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for the few-size problem; (configuration, whole count) with counts rounded down."""
    k = len(sizes)
    basis = np.diag(limit // sizes).astype(float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, col = _best_configuration(sizes, price, limit)
        if worth <= 1 + 1e-6:
            break
        d = np.linalg.solve(basis, col.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        i = int(ratio.argmin())
        if not np.isfinite(ratio[i]):
            break
        basis[:, i] = col
    x = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.copy(), []
    for i in np.argsort(-x):
        conf = basis[:, i].astype(int)
        n = int(max(0, np.floor(x[i] + 1e-7)))
        n = min([n, *(int(left[j] // conf[j]) for j in np.flatnonzero(conf))])
        if n:
            out.append((conf, n))
            left = left - n * conf
    return out


Plan = list[tuple[int, int, int, int, int, int]]


def sequences_of(plan: Plan) -> int:
    return max((s + (hi - lo - 1) // each + 1 for _, lo, hi, s, each, _ in plan), default=0)


def best_plan(counts: dict[int, int], limit: int = 2048, groups: tuple[int, ...] = (24, 48, 96)) -> Plan:
    """The plan with the fewest sequences over some numbers of groups."""
    return min((plan_sequences(counts, limit, g) for g in groups), key=sequences_of)


def plan_sequences(counts: dict[int, int], limit: int = 2048, groups: int = 48, small: int | None = None) -> Plan:
    """Places for all pieces, from the histogram of lengths alone; lengths up to ``small`` are small.

    Returns rows (length, rank_from, rank_to, sequence, each, offset): of the
    pieces of that length, rank r with rank_from <= r < rank_to goes to
    sequence ``sequence + (r - rank_from) // each`` at
    ``offset + (r - rank_from) % each * length``.
    """
    small = small if small is not None else limit // 6
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if any(not 0 < n <= limit for n in counts):
        raise ValueError("piece lengths must lie between 1 and the limit")
    used = dict.fromkeys(counts, 0)  # ranks of each length that are dealt out
    runs: dict[int, list] = {}  # room -> runs [(sequences, [(length, rank_from, each)])]
    done: list[tuple[int, list]] = []

    def shelve(n: int, parts: list) -> None:
        room = limit - sum(length * each for length, _, each in parts)
        if n:
            (runs.setdefault(room, []) if room else done).append((n, parts))

    def grouped() -> tuple[list[int], list[int]]:
        """Group sizes (rounded up) and the lengths and counts in them, longest first."""
        large = sorted((n for n in counts if n > small), reverse=True)
        total = sum(counts[n] for n in large)
        each = max(1, -(-total // groups))
        out: list[list] = []
        room = 0
        for n in large:
            c = counts[n]
            while c:
                if room == 0:
                    out.append([n, []])
                    room = each
                t = min(c, room)
                out[-1][1].append([n, t])
                c, room = c - t, room - t
        merged: list[list] = []
        for size, items in out:  # groups of one size are one size
            if merged and merged[-1][0] == size:
                merged[-1][1].extend(items)
            else:
                merged.append([size, items])
        return merged

    groups_of = grouped()
    if groups_of:
        sizes = np.array([g[0] for g in groups_of])
        demand = np.array([sum(t for _, t in g[1]) for g in groups_of])
        queues = [list(map(list, g[1])) for g in groups_of]
        for conf, n in optimise_configurations(sizes, demand, limit):
            steps = []  # of each place in the configuration: (sequences, length, rank_from)
            places = [g for g in np.flatnonzero(conf) for _ in range(int(conf[g]))]  # longest first
            for g in places[:-1] or places:  # the last place is left to the best fit
                need, place = n, []
                while need:
                    length, c = queues[g][0]
                    t = min(c, need)
                    place.append((t, length, used[length]))
                    used[length] += t
                    need -= t
                    if t == c:
                        queues[g].pop(0)
                    else:
                        queues[g][0][1] -= t
                steps.append(place)
            cuts = sorted({0, n, *(int(c) for place in steps for c in np.cumsum([t for t, _, _ in place]))})
            for lo, hi in zip(cuts, cuts[1:]):
                parts = []
                for place in steps:
                    at = 0
                    for t, length, rank in place:
                        if at <= lo < at + t:
                            parts.append((length, rank + lo - at, 1))
                            break
                        at += t
                shelve(hi - lo, parts)
    rooms = sorted(runs)
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        rank = used[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                n, parts = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            else:  # a new sequence
                n, parts, room = -(-left // (limit // length)), [], limit
            each = room // length
            full = min(n, left // each)
            tail = left - full * each if full < n else 0
            tail = min(tail, each - 1)

            def back(count: int, skip: int, extra: list) -> None:
                if not count:
                    return
                moved = [(ln, r + skip * e, e) for ln, r, e in parts] + extra
                if not moved:
                    return
                r2 = limit - sum(ln * e for ln, _, e in moved)
                shelve(count, moved)
                if r2 and r2 not in rooms:
                    bisect.insort(rooms, r2)

            back(full, 0, [(length, rank, each)])
            rank, left = rank + full * each, left - full * each
            if tail:
                back(1, full, [(length, rank, tail)])
                rank, left = rank + tail, left - tail
            back(n - full - bool(tail), full + bool(tail), [])
    rows, base = [], 0
    for n, parts in done + [r for room in sorted(runs) for r in runs[room]]:
        offset = 0
        for length, rank, each in parts:
            rows.append((length, rank, rank + n * each, base, each, offset))
            offset += length * each
        base += n
    return rows


def pack(pieces: DataFrame, limit: int = 2048, groups: tuple[int, ...] = (24, 48, 96), rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (column ``length``).

    The plan is broadcast: it comes from at most ``limit`` distinct lengths and
    ``groups`` sizes, so its rows have a bound that the corpus doesn't move.
    Hot lengths are dealt out over buckets by a digest (see ``ranked``).
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = best_plan(counts, limit, groups)
    plan = spark.createDataFrame(rows, "tl_length long, tl_lo long, tl_hi long, tl_seq long, tl_each long, tl_off long")
    keyed = pieces.withColumn("tl_key", F.md5(F.concat_ws(
        ",", F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.col("ids_crc32").cast("string"))))
    r = ranked(keyed, ["length"], "tl_key", ["doc_id", "piece", "ids_crc32"], "tl_rank", rows_per_bucket)
    at = F.col("tl_rank") - F.col("tl_lo")
    return (r.join(F.broadcast(plan), (F.col("length") == F.col("tl_length")) & (F.col("tl_rank") >= F.col("tl_lo"))
                   & (F.col("tl_rank") < F.col("tl_hi")))
            .withColumn("sequence_id", F.col("tl_seq") + F.floor(at / F.col("tl_each")).cast("long"))
            .withColumn("offset", F.col("tl_off") + (at % F.col("tl_each")) * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  limit: int = 2048, end_id: int = 0, groups: tuple[int, ...] = (24, 48, 96), with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: one row for each piece.

    Null and empty texts are one piece of one token; repeated rows are packed
    as often as they stand; an empty table gives no rows.
    """
    return pack(cut_lineage(token_pieces(docs, tokenizer_path, id_col, text_col, limit, end_id, with_ids)),
                limit, groups)
