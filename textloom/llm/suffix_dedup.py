"""Removal of repeated byte strings by external induced sorting of suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else goes.  The suffixes that have to be sorted are found and shared out first:

* a window of ``length`` bytes has an anchor, the ``GRAM`` bytes with the least
  hash in it (the leftmost of equals), so equal windows have equal anchors at
  equal places.  Windows in a row with one anchor make a fragment;
* anchors that occur once in the corpus can't belong to a repeated window;
  fragments of the others go to shards by anchor, equal fragments once, with
  their number.

A shard then sorts the suffixes of its fragments by induction from right to
left.  The queue holds, in order, a tuple for each fragment: its suffix from the
current distance on, and the common prefix with the tuple before it.  A step
pops all tuples in order and pushes each into the queue of the byte before its
suffix; order within a byte is order of arrival, and the common prefix of two
neighbours is one more than the least of those popped between them.  The
anchor itself is one symbol of ``GRAM`` bytes.  The sorted tuples of one step
are the input of the next, up to the leftmost window start.  A window is
repeated if its tuple shares ``length`` bytes with a neighbour, or its fragment
stands more than once.

Anchors are independent of each other, so many are sorted together in memory.
One with more fragments than ``IN_MEMORY`` is sorted through queues on disk (in
the shared folder): a step streams them, holding one byte a fragment (the column
of bytes before the suffixes).

Defined cases: a null text is empty; texts shorter than ``length`` stay whole;
repeated rows and copies are repeats of each other; an empty table gives no
rows; very long texts are read in stretches; only doc_id and text are read, so
other columns can't clash.  Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written

LENGTH, GRAM = 400, 200
STRETCH = 1 << 22  # bytes of a text looked at together
IN_MEMORY = 300_000  # fragments of one anchor sorted in memory
TOGETHER = 16_384  # fragments from which on no other anchor joins those sorted together (some 30 MB)
ROWS = 4096  # fragments made, or texts cut, at a time
REMEMBERED = 100_000  # digests of texts that a task has sent
CHUNK = 1 << 16  # tuples of a queue handled together on disk

# ------------------------------------------------------------- anchors of windows


def _hash_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the bytes, powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
    return np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64), up, down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def window_runs(data: bytes, tables, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (anchor, first window, last window): the windows of ``data`` in runs with one anchor."""
    text, out = np.frombuffer(data, np.uint8), []
    rnd, up, down = tables
    for start in range(0, len(text) - length + 1, STRETCH):
        b = text[start:start + STRETCH + length - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(rnd[b] * up[:len(b)], out=sums[1:])
            h = (sums[gram:] - sums[:-gram]) * down[:len(b) - gram + 1]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        # hash above, place below: the least is the leftmost of the least hashes
        key = (h ^ (h >> np.uint64(32))) & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(key, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out.append(np.stack([at[first], first, np.r_[first[1:], len(at)] - 1]) + start)
    return np.concatenate(out, axis=1).T if out else np.zeros((0, 3), np.int64)


ANCHORS = "dg binary, anchor binary, frag binary, at int, lo int, hi int"


def anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each run of windows: digests of text, anchor and fragment; places of the anchor and the windows."""
    names = [f.split()[0] for f in ANCHORS.split(", ")]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        tables = None
        for b in batches:
            out: list[list] = [[] for _ in names]

            def table():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

            for value in b.column(0):
                data = value.as_py()
                if len(data) < length:
                    continue
                if tables is None or len(tables[1]) < min(len(data), STRETCH + length):
                    tables = _hash_tables(min(2 * len(data), STRETCH + length))
                digest = hashlib.md5(data).digest()
                for at, lo, hi in window_runs(data, tables, length, gram).tolist():
                    row = (digest, hashlib.md5(data[at:at + gram]).digest(),
                           hashlib.md5(data[lo:hi + length] + (at - lo).to_bytes(4, "big")).digest(), at, lo, hi)
                    for c, v in zip(out, row):
                        c.append(v)
                if len(out[0]) >= 10 * ROWS:
                    yield table()
                    out = [[] for _ in names]
            if out[0]:
                yield table()

    return texts.select("data").mapInArrow(run, ANCHORS)


# --------------------------------------------------------------- induced sorting


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi + 1]) of each pair."""
    span = hi - lo + 1
    level = np.frexp(span.astype(float))[1] - 1
    out, table, size = np.empty(len(lo), values.dtype), values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = level == k
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - size + 1])
        table, size = np.minimum(table[:-size], table[size:]), 2 * size
    return out


def _step(key: np.ndarray, byte: np.ndarray, common: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """One induction in memory: the new order (places in the old) and common prefixes.

    ``key`` is the anchor's number by tuple, ascending; ``byte`` the byte before
    each suffix plus 1, or 0 where there is none (then nothing is shared).
    """
    full = key * 257 + byte
    order = np.argsort(full, kind="stable")
    full = full[order]
    new = np.zeros(len(order), np.int32)
    same = np.flatnonzero((full[1:] == full[:-1]) & (full[1:] % 257 != 0)) + 1
    new[same] = weight + _range_min(common, order[same - 1] + 1, order[same])
    return order, new


class Shard:
    """Fragments of some anchors as columns of bytes around the anchor."""

    def __init__(self, rows: list[tuple], length: int, gram: int):
        """Rows (anchor's number, count, left bytes, right bytes, least distance, greatest distance), by anchor."""
        self.length, self.gram = length, gram
        self.key = np.array([r[0] for r in rows], np.int64)
        self.count = np.array([r[1] for r in rows], np.int64)
        self.near, self.far = (np.array([r[i] for r in rows], np.int64) for i in (4, 5))
        self.left = self._columns([r[2][::-1] for r in rows])
        self.right = self._columns([r[3] for r in rows])
        self.right_size = np.array([len(r[3]) for r in rows], np.int64)

    @staticmethod
    def _columns(parts: list[bytes]) -> np.ndarray:
        """Byte plus 1 by (distance, fragment), 0 behind a part's end."""
        sizes = np.array([len(p) for p in parts], np.int64)
        out = np.zeros((int(sizes.max()) if len(sizes) else 0, len(parts)), np.uint16)
        for s in range(0, len(parts), ROWS):  # places are eight bytes for each byte, so for some parts at a time
            n = sizes[s:s + ROWS]
            item = np.repeat(np.arange(s, s + len(n)), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[place, item] = np.frombuffer(b"".join(parts[s:s + ROWS]), np.uint8).astype(np.uint16) + 1
        return out

    def _found(self, x: int, item: np.ndarray, common: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which tuples are repeated windows ``x`` bytes left of the anchor; ``after`` are the next tuples' prefixes."""
        whole = x + self.gram + self.right_size[item] >= self.length
        shared = np.maximum(common, after) >= self.length
        return (shared | (self.count[item] > 1) & whole) & (self.near[item] <= x) & (x <= self.far[item])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fragment, distance) of the repeated windows, sorted in memory."""
        n = len(self.key)
        item, common = np.arange(n), np.zeros(n, np.int32)
        items, xs = [], []
        for column in self.right[::-1]:
            order, common = _step(self.key[item], column[item], common, 1)
            item = item[order]
        new = np.r_[True, self.key[item][1:] != self.key[item][:-1]]
        common = np.where(new, 0, common + self.gram).astype(np.int32)
        for x in range(len(self.left) + 1):
            if x:
                alive = self.far[item] >= x
                if not alive.all():  # done with; the next one's prefix is the least of those left out before it
                    kept = np.flatnonzero(alive)
                    if not len(kept):
                        break
                    low = np.minimum.reduceat(common[:kept[-1] + 1], np.r_[0, kept[:-1] + 1])
                    item, common = item[kept], low.astype(np.int32)
                order, common = _step(self.key[item], self.left[x - 1][item], common, 1)
                item = item[order]
            hit = self._found(x, item, common, np.r_[common[1:], 0])
            items.append(item[hit])
            xs.append(np.full(int(hit.sum()), x))
        return np.concatenate(items), np.concatenate(xs)


class Queue:
    """Tuples (fragment, common prefix) by byte, first in first out, on disk beyond ``room`` tuples."""

    def __init__(self, folder: str, room: int):
        self.folder, self.room, self.size = folder, room, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list[str]] = {}

    @staticmethod
    def _at(path: str):
        from pyarrow import fs

        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)

    def push(self, byte: int, tuples: np.ndarray) -> None:
        self.held.setdefault(byte, []).append(tuples)
        self.size += tuples.shape[1]
        if self.size > self.room:
            store, path = self._at(self.folder)
            store.create_dir(path, recursive=True)
            for key, parts in self.held.items():
                name = f"{path}/{uuid.uuid4().hex}"
                with store.open_output_stream(name) as f:
                    f.write(np.ascontiguousarray(np.concatenate(parts, axis=1).T).tobytes())
                self.files.setdefault(key, []).append(name)
            self.held, self.size = {}, 0

    def pop(self):
        """(byte, tuples) in order, in bounded parts; the queue is empty afterwards."""
        for byte in sorted(set(self.held) | set(self.files)):
            for name in self.files.get(byte, []):
                store, _ = self._at(self.folder)
                with store.open_input_stream(name) as f:
                    while data := f.read(8 * CHUNK):
                        while len(data) % 8:
                            data += f.read(8 - len(data) % 8)
                        yield byte, np.frombuffer(data, np.int32).reshape(-1, 2).T
                store.delete_file(name)
            for part in self.held.get(byte, []):
                for s in range(0, part.shape[1], CHUNK):
                    yield byte, part[:, s:s + CHUNK]

    def close(self) -> None:
        store, path = self._at(self.folder)
        if store.get_file_info(path).type.name == "Directory":
            store.delete_dir(path)


def external_repeated(shard: Shard, folder: str, room: int):
    """As ``Shard.repeated`` for the fragments of one anchor, through queues on disk; yields (fragments, distance)."""
    n = len(shard.key)
    queue = Queue(f"{folder}/0", room)
    for s in range(0, n, CHUNK):
        queue.push(0, np.stack([np.arange(s, min(n, s + CHUNK)), np.zeros(min(n, s + CHUNK) - s)]).astype(np.int32))
    rounds = [(None, c) for c in shard.right[::-1]] + [(0, None)] + [(x, c) for x, c in enumerate(shard.left, 1)]
    for step, (x, column) in enumerate(rounds, 1):
        later = Queue(f"{folder}/{step}", room)
        least = np.full(257, 1 << 30, np.int64)  # least prefix popped since a byte's last tuple
        pushed = np.zeros(257, bool)  # bytes that have a tuple already
        held = None  # the last tuple of the order, whose next one isn't known yet
        last_byte = -1

        def report(item, common, after):
            hit = shard._found(x, item, common, after)
            return item[hit], x

        for byte, (item, common) in queue.pop():
            common = common.astype(np.int64)
            if x is None or x:
                if x:
                    keep = shard.far[item] >= x
                    lost = np.where(keep, 1 << 30, common)
                    # a tuple left out hands its prefix on to the next one that stays
                    places = np.flatnonzero(keep)
                    if not len(places):
                        least = np.minimum(least, lost.min()) if len(lost) else least
                        continue
                    low = np.minimum.reduceat(common[:places[-1] + 1], np.r_[0, places[:-1] + 1])
                    tail = common[places[-1] + 1:]
                    item, common = item[places], low
                else:
                    tail = common[:0]
                before = column[item].astype(np.int64)
                order = np.argsort(before, kind="stable")
                sorted_byte = before[order]
                first = np.flatnonzero(np.r_[True, sorted_byte[1:] != sorted_byte[:-1]])
                prefix = np.minimum.accumulate(common)
                fresh = np.empty(len(order), np.int64)
                same = np.ones(len(order), bool)
                same[first] = False
                s = np.flatnonzero(same)
                fresh[s] = _range_min(common, order[s - 1] + 1, order[s])
                fresh[first] = np.minimum(least[sorted_byte[first]], prefix[order[first]])
                behind = np.r_[np.minimum.accumulate(np.r_[common, tail][::-1])[::-1], 1 << 30]
                least = np.minimum(least, min(common.min(), tail.min() if len(tail) else 1 << 30))
                ends = np.r_[first[1:], len(order)] - 1
                least[sorted_byte[ends]] = behind[order[ends] + 1]
                fresh += 1
                fresh[first[~pushed[sorted_byte[first]]]] = 0
                fresh[sorted_byte == 0] = 0
                pushed[sorted_byte[first]] = True
                for lo, hi in zip(first, ends + 1):
                    later.push(int(sorted_byte[lo]), np.stack([item[order[lo:hi]], fresh[lo:hi]]).astype(np.int32))
            else:  # the anchor: one symbol, the order stays
                first_of_all = last_byte < 0
                common = common + shard.gram
                if first_of_all:
                    common[0] = 0
                last_byte = 0
                later.push(0, np.stack([item, common]).astype(np.int32))
        queue.close()
        queue = later
        if x is not None:  # read the new order once for its windows, and keep it for the next step
            again = Queue(f"{folder}/{step}-again", room)
            for byte, part in queue.pop():
                item, common = part.astype(np.int64)
                if held is not None:
                    yield report(held[0], held[1], common[:1])
                if len(item) > 1:
                    yield report(item[:-1], common[:-1], common[1:])
                held = item[-1:], common[-1:]
                again.push(byte, part)
            if held is not None:
                yield report(held[0], held[1], np.zeros(1, np.int64))
            queue.close()
            queue = again
    queue.close()


def _spans(item: np.ndarray, x: np.ndarray, n: int) -> list[list[int]]:
    """For each fragment the runs of its distances, flat (from, to, from, to, ...)."""
    order = np.lexsort((x, item))
    item, x = item[order], x[order]
    out: list[list[int]] = [[] for _ in range(n)]
    new = np.r_[True, (item[1:] != item[:-1]) | (x[1:] != x[:-1] + 1)] if len(item) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    for i, a, b in zip(item[first].tolist(), x[first].tolist(), x[np.r_[first[1:], len(item)] - 1].tolist() if len(first) else []):
        out[i] += [a, b]
    return out


def sort_shards(fragments: DataFrame, folder: str, length: int = LENGTH, gram: int = GRAM, in_memory: int = IN_MEMORY) -> DataFrame:
    """frag and ``spans`` (runs of distances from the anchor) of the fragments that hold repeated windows."""

    def run(batches):
        rows: list[tuple] = []
        ids: list[bytes] = []
        last, number = None, 0

        def result(spans):
            keep = [(i, s) for i, s in zip(ids, spans) if s]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in keep], pa.binary()),
                                               pa.array([s for _, s in keep], pa.list_(pa.int32()))], names=["frag", "spans"])

        def flush(upto):
            nonlocal rows, ids
            rest, rest_ids = rows[upto:], ids[upto:]
            rows, ids = rows[:upto], ids[:upto]
            if rows:
                shard = Shard(rows, length, gram)
                if len(rows) > in_memory:  # one anchor alone
                    found = list(external_repeated(shard, f"{folder}/{uuid.uuid4().hex}", in_memory))
                    item = np.concatenate([i for i, _ in found] or [np.zeros(0, np.int64)])
                    x = np.concatenate([np.full(len(i), d) for i, d in found] or [np.zeros(0, np.int64)])
                else:
                    item, x = shard.repeated()
                yield result(_spans(item, x, len(rows)))
            rows, ids = rest, rest_ids

        start = 0  # of the current anchor's rows
        for b in batches:
            for anchor, frag, n, near, left, right in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if anchor != last:
                    if len(rows) >= min(in_memory // 2, TOGETHER):
                        yield from flush(len(rows))
                    last, number, start = anchor, number + 1, len(rows)
                elif start and len(rows) >= in_memory:  # the current anchor is large: alone from now on
                    yield from flush(start)
                    start = 0
                rows.append((number, n, left, right, near, len(left)))
                ids.append(frag)
        yield from flush(len(rows))

    return (fragments.select("anchor", "frag", "n", "near", "left", "right").repartition("anchor")
            .sortWithinPartitions("anchor").mapInArrow(run, "frag binary, spans array<int>"))


# ---------------------------------------------------------------------- the job


def _fragment_bytes(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor, frag, n, near, left, right: the bytes of the fragments, each from one text that has it."""
    lists = wanted.groupBy("dg").agg(F.collect_list(F.struct("anchor", "frag", "n", "at", "lo", "hi")).alias("list"))
    need = lists.select("dg")
    seen_texts = texts.select(F.unhex(F.md5("data")).alias("dg"), "data").join(need, "dg", "left_semi")

    def once(batches):  # copies of a text leave a task once (as long as they are remembered)
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for d in b.column(0).to_pylist():
                keep.append(d not in seen)
                seen.add(d)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield b.filter(pa.array(keep))

    kind = lists.schema["list"].dataType.simpleString()
    both = lists.select("dg", F.lit(None).cast("binary").alias("data"), "list").unionByName(
        seen_texts.mapInArrow(once, "dg binary, data binary").select("dg", "data", F.lit(None).cast(kind).alias("list")))

    def run(batches):
        last, wanted_here = None, None
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                                              names=["anchor", "frag", "n", "near", "left", "right"])

        for b in batches:
            out = []
            for dg, data, rows in zip(*(b.column(i) for i in range(3))):
                dg = dg.as_py()
                if rows.is_valid:
                    last, wanted_here = dg, rows.as_py()
                elif wanted_here and dg == last:
                    text = data.as_py()
                    for r in wanted_here:
                        at, lo, hi = r["at"], r["lo"], r["hi"]
                        out.append((r["anchor"], r["frag"], r["n"], at - hi, text[lo:at], text[at + gram:hi + length]))
                        if len(out) >= ROWS:  # a batch of texts may hold many times as many fragments
                            yield table(out)
                            out = []
                    wanted_here = None
            yield table(out)

    return both.repartition("dg").sortWithinPartitions("dg", F.col("data").isNotNull()).select("dg", "data", "list").mapInArrow(
        run, "anchor binary, frag binary, n long, near int, left binary, right binary")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept_bytes(data: bytes, flat: list[int] | None) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs; ``flat`` holds starts and ends in any order."""
    if not flat:
        return data, 0
    cut = sorted(zip(flat[::2], flat[1::2]))
    kept, at, spans, end = [], 0, 0, -1
    for a, b in cut:
        if a > end:
            spans += 1
            kept.append(data[at:a])
        end = max(end, b)
        at = end
    kept.append(data[at:])
    return b"".join(kept), spans


def repeated_intervals(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                       in_memory: int = IN_MEMORY) -> tuple[DataFrame, DataFrame]:
    """The texts as bytes (``data`` beside the input's columns), and by digest ``dg`` the byte intervals to remove."""
    spark = docs.sparkSession
    texts = docs.withColumn("data", F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    found = written(anchors(texts.where(F.octet_length("data") >= length), length, gram), "suffix-anchors")
    often = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "suffix-often")
    kept = written(found.join(often, "anchor"), "suffix-kept")
    wanted = kept.groupBy("anchor", "frag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dg", "at", "lo", "hi")).alias("r")).select(
        "anchor", "frag", "n", "r.*")
    spans = written(sort_shards(_fragment_bytes(texts, written(wanted, "suffix-wanted"), length, gram),
                                scratch_path(spark, f"suffix-queues-{uuid.uuid4().hex}"), length, gram, in_memory), "suffix-spans")
    cuts = kept.select("dg", "frag", "at").join(spans, "frag").select("dg", F.explode(F.transform(
        F.sequence(F.lit(0), F.expr("CAST(size(spans) DIV 2 - 1 AS INT)")), lambda i: F.struct(
            (F.col("at") - F.element_at("spans", (2 * i + 2).cast("int"))).alias("a"),
            (F.col("at") - F.element_at("spans", (2 * i + 1).cast("int")) + length).alias("b")))).alias("cut"))
    flat = cuts.groupBy("dg").agg(F.flatten(F.transform(F.collect_set("cut"), lambda c: F.array(c["a"], c["b"]))).alias("cuts"))
    return texts, written(flat, "suffix-cuts")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          in_memory: int = IN_MEMORY) -> DataFrame:
    """For each row: doc_id, ``kept`` (the bytes that stay), n_bytes, n_removed, n_spans, kept_sha256."""
    texts, cuts = repeated_intervals(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                                     "text", length, gram, in_memory)
    keyed = texts.select("doc_id", "data", F.unhex(F.md5("data")).alias("dg"))

    def run(batches):
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            out = []
            for data, flat in zip(b.column(1), b.column(2)):
                data = data.as_py()
                left, spans = _kept_bytes(data, flat.as_py())
                out.append((left, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)]],
                                             names=["doc_id", "kept", *[f.split()[0] for f in RESULT.split(", ")]])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    some = keyed.join(cuts, "dg").select("doc_id", "data", "cuts")
    none = keyed.join(cuts.select("dg"), "dg", "left_anti").select("doc_id", "data", F.lit(None).cast("array<int>").alias("cuts"))
    return some.unionByName(none).mapInArrow(run, f"doc_id {kind}, kept binary, {RESULT}")
