"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint emits every variant within half the radius; two
fingerprints whose distance is within the radius share a variant, so a shuffle
on variants brings them together.  An odd radius leaves one bit over: the bits
fall into three blocks, and for each block the variants are taken with that
block masked out.  For radius 3 that is 3 * (1 + 43) = about 131 variants:

* of up to three differing bits, some block holds exactly one, or none of a
  distance of two or less, or all three;
* with that block masked, the rest differs in at most two bits, so the two
  balls of radius one meet.

Within a variant's group the links are found without writing out pairs: see
:func:`_links_of_run`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components

BLOCKS = ((0, 21), (21, 42), (42, 64))
SMALL_RUN = 48
#: Fingerprints that a task turns into variants (about 131 rows each).
FINGERPRINTS_A_TASK = 20_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned 64-bit number (no word: 0)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0).astype(np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) and ``digest`` (of the text) of each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))

    def run(batches):
        for b in batches:
            # one text at a time: a batch's list of texts has no bound in bytes
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)],
                                             names=["doc_id", "fp", "digest"])

    return narrow.mapInArrow(run, "doc_id long, fp long, digest long")


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _masks() -> list[np.uint64]:
    return [np.uint64(sum(1 << i for i in range(lo, hi))) for lo, hi in BLOCKS]


def variants(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (block, key, fp): all variants of each fingerprint within half the radius.

    An even radius masks nothing (block 0 only).  Keys are signed longs.
    """
    half, odd = divmod(radius, 2)

    def run(batches):
        masks = _masks() if odd else [np.uint64(0)]
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for j, mask in enumerate(masks):
                free = [i for i in range(64) if not (int(mask) >> i) & 1]
                flips = np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(free, k)],
                                 np.uint64)
                step = max(1, 200_000 // len(flips))
                for s in range(0, len(fp), step):
                    part = fp[s:s + step]
                    key = ((part & ~mask)[:, None] ^ flips[None, :]).ravel()
                    n = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, j, np.int32)), pa.array(key.view(np.int64)),
                         pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["block", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "block int, key long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, so a run writes fewer rows than it has members."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        x0, y0 = find(x), find(y)
        if x0 != y0:
            parent[max(x0, y0)] = min(x0, y0)
            out.append((x, y))
    return out


def _links_of_run(fps: np.ndarray, block: int, key: np.uint64, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever the pairs within ``radius`` in one variant's group join.

    Short runs compare all members in place.  Long ones (radius 3, all members
    within one bit of the key outside the masked block) need no pairs: equal
    block contents are within two bits and hang on their smallest member;
    contents one bit apart are within three bits, found by flipping each bit
    of the block; and those at distance three within the block that equal the
    key outside it, by flipping any three bits.  The other pairs within three
    bits meet in another block's group.
    """
    fps = np.unique(fps)
    n = len(fps)
    if n < 2:
        return []
    if n <= SMALL_RUN or radius != 3:
        step, a, b = max(1, 2_000_000 // n), [], []
        for s in range(0, n, step):
            d = _bit_count(fps[s:s + step, None] ^ fps[None, :])
            i, j = np.nonzero(d <= radius)
            keep = i + s < j
            a.append(fps[i[keep] + s])
            b.append(fps[j[keep]])
        return _forest(np.concatenate(a), np.concatenate(b))
    mask = _masks()[block]
    w = fps & mask
    order = np.lexsort((fps, w))
    fps, w = fps[order], w[order]
    content, first = np.unique(w, return_index=True)
    rep = fps[first]
    a, b = [fps], [np.repeat(rep, np.diff(np.append(first, n)))]
    lo, hi = BLOCKS[block]
    bits = [np.uint64(1 << i) for i in range(lo, hi)]

    def look(values: np.ndarray, members: np.ndarray, flips: list[np.uint64]) -> None:
        for f in flips:
            other = values ^ f
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            ok = (values[at] == other) & (values < other)
            a.append(members[ok])
            b.append(members[at[ok]])

    look(content, rep, bits)
    exact = fps[(fps & ~mask) == key]
    if len(exact) > 1:
        own = np.sort(exact & mask)
        look(own, own | key, [x | y | z for x, y, z in combinations(bits, 3)])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    return _forest(a[keep], b[keep])


def links(distinct_fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) of fingerprints that connect all pairs within ``radius`` bits."""
    # adaptive execution sees fingerprints of 8 bytes and would leave them in few tasks, each to make 131 rows of one
    ways = max(1, -(-distinct_fps.count() // FINGERPRINTS_A_TASK))
    dealt = distinct_fps.select("fp").repartition(ways, "fp")
    parts = variants(dealt, radius).repartition(F.col("block"), F.col("key")).sortWithinPartitions("block", "key")

    def run(batches):
        hold_k = hold_b = hold_f = None  # the last run goes on in the next batch
        for batch in batches:
            k = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            b = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if hold_k is not None:
                k, b, f = np.concatenate([hold_k, k]), np.concatenate([hold_b, b]), np.concatenate([hold_f, f])
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])])
            last = new[-1]
            hold_k, hold_b, hold_f = k[last:], b[last:], f[last:]
            yield from found(k[:last], b[:last], f[:last], new[:-1])
        if hold_k is not None:
            yield from found(hold_k, hold_b, hold_f, np.array([0]))

    def found(k, b, f, starts):
        if not len(starts):
            return
        size = np.diff(np.append(starts, len(k)))
        two = starts[size == 2]
        x, y = f[two], f[two + 1]
        near = (_bit_count(x ^ y) <= radius) & (x != y)
        a_out, b_out = [x[near]], [y[near]]
        for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
            pairs = _links_of_run(f[s:s + n], int(b[s]), k[s], radius)
            if pairs:
                p = np.array(pairs, np.uint64)
                a_out.append(p[:, 0])
                b_out.append(p[:, 1])
        a, c = np.concatenate(a_out), np.concatenate(b_out)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    return parts.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
            radius: int = 3) -> DataFrame:
    """One row for each input row: doc_id, fp, digest, component_id.

    ``component_id`` is the smallest doc_id that links of ``radius`` bits or
    fewer reach.  Null and blank texts have fingerprint zero and link like any
    other; equal texts and repeated rows share a fingerprint; a null doc_id
    gets its component's smallest id, or null if that has none.  An empty table
    gives no rows.  Texts of any length are read whole; only the id and text
    columns are read, so other columns can't clash.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    by_fp = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(by_fp, radius))
    by_fp = by_fp.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    low = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    of = by_fp.join(low, "root").select(F.col("fp").alias("tl_fp"), "component_id")
    return own.join(of, F.col("fp") == F.col("tl_fp")).drop("tl_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 3) -> DataFrame:
    """The documents with one of each component, the one with the smallest doc_id; columns as they were.

    Where that doc_id stands in several rows the smallest text digest stays, once.
    """
    c = classes(docs, id_col, text_col, shingle, radius)
    best = (c.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id")
            .agg(F.min("digest").alias("tl_digest")).withColumnRenamed("component_id", "tl_id"))
    d = docs.withColumn("tl_d", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(
        "tl_i", F.col(id_col).cast("long"))
    return (d.join(best, F.col("tl_i").eqNullSafe(F.col("tl_id")) & (F.col("tl_d") == F.col("tl_digest")))
            .dropDuplicates(["tl_id", "tl_digest"]).select(*docs.columns))
