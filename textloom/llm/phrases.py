"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, edges are runs of four (the longest phrase) and
join the nodes they overlap; an edge weighs its occurrences.  Only edges are
counted.  A piece is padded behind its last word, so that what runs out at its
end is an edge into the pad; all shorter counts then follow from the flow:

* a node's count is the weight of the edges that leave it, pads (the piece-end
  correction) included;
* a pair's count is the flow of the nodes that begin with it, a word's count
  that of the pairs.

Unary paths (nodes whose whole flow comes by one edge and leaves by one edge)
are compacted: one row holds the path's words and its weight.  A node inside
such a path has its neighbours' count, so it lies in a longer candidate of the
same count and needs no scores.

Words below ``min_count`` can't stand in a candidate and break a piece like its
end does; all others have a number by frequency, so that an edge is four small
numbers.  Tasks find numbers in a broadcast array of word hashes (12 bytes a
word, at most ``MAX_WORDS`` words; a collision of any two words of the corpus is
looked for and answered by another salt).  Beyond that many words the numbers
are joined to the words by a shuffle.

Defined cases: null texts are empty; a null language is ``und``; repeated rows
count again; a text without words gives nothing; an empty table gives no rows;
only the language and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import written

H = ["h1", "h2", "h3", "h4"]
COMBINE = 500_000  # windows that a task combines at a time (20 MB, and as much again for each step of it)
BUCKET = 500_000  # windows of a bucket of nodes, on average; equal windows of one task are one
MAX_WORDS = 2_000_000  # frequent words that are broadcast (24 MB)
HELD = 200_000  # words that a task remembers

#: Bytes after splitting: lower-case letters, every separator a full stop, tabs as spaces.
SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, ``.`` between pieces and at the end."""
    return (text or "").encode("utf-8", "surrogatepass").translate(SPLIT).replace(b".", b" . ").split() + [b"."]


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """All words (``lang``, ``word``, ``f``) as a written table."""

    def run(batches):
        from collections import Counter

        by_lang: dict[str, Counter] = {}
        held = 0

        def rows():
            flat = [(lang, w.decode("utf-8", "surrogatepass"), n) for lang, c in by_lang.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.string(), pa.int64()))],
                                              names=["lang", "word", "f"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                c = by_lang.setdefault(lang.as_py(), Counter())
                before = len(c)
                c.update(words_of(text.as_py()))
                del c[b"."]
                held += len(c) - min(before, len(c))
                if held >= HELD:
                    yield rows()
                    by_lang, held = {}, 0
        if any(by_lang.values()):
            yield rows()

    counted = texts.mapInArrow(run, "lang string, word string, f long")
    return written(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")


def word_hash(lang: str, word: bytes, salt: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\0" + word, salt) - (1 << 63)


def hashed(words: DataFrame, salt: int) -> DataFrame:
    """``words`` and the 64-bit hash ``h`` of language and word."""

    def run(batches):
        for b in batches:
            h = [word_hash(lang.as_py(), word.as_py().encode("utf-8", "surrogatepass"), salt) for lang, word in
                 zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64())], names=["lang", "word", "f", "h"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word string, f long, h long")


def numbered(words: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """The frequent words with ``h`` and their number ``code`` (from 1, frequent first), and the salt of the hashes.

    No two words of the corpus, rare ones included, share a hash under the salt.
    """
    for salt in range(16):
        if hashed(words, salt).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no salt keeps the words' hashes apart")
    frequent = hashed(words.where(F.col("f") >= min_count), salt)
    # places by a sort of the frequent words over ranges, and prefix sums over the ranges
    placed = cut_lineage(frequent.repartitionByRange(F.col("f").desc(), "h").sortWithinPartitions(F.col("f").desc(), "h")
                         .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    first = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    first = first.select("part", "low", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return cut_lineage(placed.join(F.broadcast(first), "part").select(
        "lang", "word", "f", "h", (F.col("base") + F.col("at") - F.col("low") + 1).cast("int").alias("code"))), salt


def _mixed(p: np.ndarray, c: np.ndarray | int = 0) -> np.ndarray:
    """A hash of two numbers, spread over 64 bits."""
    x = (p.astype(np.uint64) ^ (np.asarray(c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; larger hashes have no smaller bucket."""
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Columns with equal keys (all rows but the last) as one, in the keys' order, the last row summed."""
    w = np.concatenate(parts, axis=1)
    w = w[:, np.lexsort(w[-2::-1])]
    first = _cuts(*w[:-1])
    return np.concatenate([w[:-1, first], np.add.reduceat(w[-1:], first, axis=1)])


def _dealt(w: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Columns in the buckets' order as one array of bytes for each bucket."""
    first = _cuts(bucket)
    past = np.append(first[1:], len(bucket)).tolist()
    return bucket[first].tolist(), [w[:, x:y].tobytes() for x, y in zip(first.tolist(), past)]


def _by_bucket(rows, height: int, finish):
    """From rows (bucket, buckets, bytes) in the buckets' order, ``finish`` of each bucket's summed columns.

    What is held are the distinct keys of one bucket, at most twice over.
    """
    now = of = None
    held, size, limit = [], 0, 2 * COMBINE
    for bucket, buckets, raw in rows:
        if bucket != now:
            if held:
                yield from finish(_summed(held), of)
            now, of, held, size, limit = bucket, buckets, [], 0, 2 * COMBINE
        held.append(np.frombuffer(raw, np.int64).reshape(height, -1))
        size += held[-1].shape[1]
        if size >= limit:
            held = [_summed(held)]
            size = held[0].shape[1]
            limit = max(limit, 2 * size)
    if held:
        yield from finish(_summed(held), of)


def edges(texts: DataFrame, frequent: DataFrame, salt: int, max_words: int | None = None) -> DataFrame:
    """Weighted edges by bucket of their node: ``bucket``, ``buckets`` (how many there are) and ``raw``, three rows of
    longs (first word's number << 32 | second's; third's << 32 | fourth's; weight), zeros behind a piece's end or a
    rare word.

    Tasks combine equal windows before the one large shuffle, which moves a
    task's windows of a bucket as one row; no node's edges lie in two buckets.
    """
    total = frequent.agg(F.sum("f").alias("f")).first()["f"] or 0
    buckets = max(1, -(-total // BUCKET))
    schema = "bucket int, buckets int, raw binary"

    def combined(rows):
        """Equal windows of a stretch of the task's rows as one, dealt out to buckets."""
        w = np.concatenate(rows, axis=1)
        node = _mixed(w[0], w[1] >> 32)
        # equal windows come together; a node's hash decides the bucket, its fourth word's the order within
        low = np.uint64((1 << 20) - 1)
        order = np.argsort((node & ~low) | (_mixed(w[1] & 0xFFFFFFFF) & low))
        w = w[:, order]
        first = _cuts(w[0], w[1])
        bucket, raw = _dealt(np.stack([w[0, first], w[1, first], np.diff(np.append(first, w.shape[1]))]),
                             _bucket(node[order[first]], buckets))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([buckets] * len(bucket), pa.int32()),
                                           pa.array(raw, pa.binary())], names=["bucket", "buckets", "raw"])

    def windows(coded):
        """From arrays of numbers, each with a 0 behind its last word."""
        held, size = [], 0
        for c in coded:
            c = np.concatenate([c, np.zeros(3, np.int64)])
            c1, c2, c3, c4 = c[:-3], c[1:-2], c[2:-1], c[3:]
            two = c2 != 0
            three = two & (c3 != 0)
            w = np.stack([c1 << 32 | c2, np.where(two, c3, 0) << 32 | np.where(three, c4, 0)])[:, c1 != 0]
            held.append(w)
            size += w.shape[1]
            if size >= COMBINE:
                yield combined(held)
                held, size = [], 0
        if size:
            yield combined(held)

    if frequent.count() <= (MAX_WORDS if max_words is None else max_words):
        rows = frequent.select("h", "code").toPandas()
        order = np.argsort(rows["h"].to_numpy())
        sent = texts.sparkSession.sparkContext.broadcast((rows["h"].to_numpy()[order], rows["code"].to_numpy(np.int32)[order]))

        def run(batches):
            h, code = sent.value

            class Codes(dict):
                def __init__(self, lang):
                    self.lang = lang
                    self[b"."] = 0

                def __missing__(self, word):
                    if len(self) >= HELD:
                        self.clear()
                        self[b"."] = 0
                    v = word_hash(self.lang, word, salt)
                    at = np.searchsorted(h, v)
                    c = self[word] = int(code[at]) if at < len(h) and h[at] == v else 0
                    return c

            known = {}

            def coded():
                for b in batches:
                    for lang, text in zip(b.column(0), b.column(1)):
                        lang = lang.as_py()
                        if lang not in known:
                            if len(known) >= 64:
                                known.clear()
                            known[lang] = Codes(lang)
                        yield np.array(list(map(known[lang].__getitem__, words_of(text.as_py()))), np.int64)

            yield from windows(coded())

        out = texts.mapInArrow(run, schema)
    else:
        out = _joined_codes(texts, frequent, salt).mapInArrow(
            lambda batches: windows(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for b in batches for x in b.column(0)),
            schema)
    return out


def _joined_codes(texts: DataFrame, frequent: DataFrame, salt: int) -> DataFrame:
    """``codes`` of each text, its words' numbers found by a join."""
    named = written(texts.withColumn("uid", F.monotonically_increasing_id()), "phrase-texts")

    def run(batches):
        for b in batches:
            for uid, lang, text in zip(b.column(0), b.column(1), b.column(2)):
                lang, words = lang.as_py(), words_of(text.as_py())
                n = len(words)
                h = [None if w == b"." else word_hash(lang, w, salt) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()),
                                                  pa.array(h, pa.int64())], names=["uid", "i", "h"])

    tokens = named.select("uid", "lang", "text").mapInArrow(run, "uid long, i int, h long")
    found = tokens.join(frequent.select("h", "code"), "h", "left").select("uid", F.struct("i", F.coalesce("code", F.lit(0)).alias("code")).alias("t"))
    return found.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["code"].cast("long")).alias("codes")).select("codes")


def flows(edge_rows: DataFrame, min_count: int) -> DataFrame:
    """Counts of all runs of one to four words with ``min_count`` or more: h1 to h4 (0 behind the last), f.

    Each length is the flow out of the next longer one: a bucket of nodes sums
    its edges and its nodes and sends on what it has of the pairs, a bucket of
    pairs sums these and sends on what it has of the words.  Only one bucket is
    held at a time.
    """
    names = [*H, "f", "length"]
    found = "h1 long, h2 long, h3 long, h4 long, f long, length int"

    def counted(length: int, p: np.ndarray, q: np.ndarray, f: np.ndarray) -> list[pa.Array]:
        low = 0xFFFFFFFF
        cols = [p >> 32, p & low, q >> 32, q & low]
        zero = np.zeros(len(f), np.int64)
        return [pa.array(c if i < length else zero) for i, c in enumerate(cols)] + [
            pa.array(f), pa.array(np.full(len(f), length, np.int32))]

    def nodes(batches):
        def finish(w, of):
            p, q, n = w
            heavy = (n >= min_count) & (q & 0xFFFFFFFF != 0)
            rows = [counted(4, p[heavy], q[heavy], n[heavy])]
            first = _cuts(p, q >> 32)
            f = np.add.reduceat(n, first)
            p, q = p[first], q[first]
            heavy = (f >= min_count) & (q >> 32 != 0)
            rows.append(counted(3, p[heavy], q[heavy], f[heavy]))
            first = _cuts(p)
            pairs = np.stack([p[first], np.add.reduceat(f, first)])
            node = _mixed(pairs[0])
            order = np.argsort(node)
            bucket, raw = _dealt(pairs[:, order], _bucket(node[order], of))
            for cols in rows:  # a heavy run goes with any bucket
                n = len(cols[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32) % of), pa.array([of] * n, pa.int32()),
                                                  pa.nulls(n, pa.binary()), *cols], names=["bucket", "buckets", "raw", *names])
            n = len(bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([of] * n, pa.int32()), pa.array(raw, pa.binary()),
                 *[pa.nulls(n, pa.int64())] * 5, pa.nulls(n, pa.int32())], names=["bucket", "buckets", "raw", *names])

        yield from _by_bucket(((x.as_py(), of.as_py(), raw.as_buffer()) for b in batches for x, of, raw in zip(*b.columns[:3])),
                              3, finish)

    def pairs(batches):
        heavy = []  # rows that are counts already, of the batch at hand

        def rows():
            for b in batches:
                done = b.column(2).is_null()
                heavy.append(pa.RecordBatch.from_arrays(b.columns[3:], names=names).filter(done))
                part = b.filter(b.column(2).is_valid())
                for x, of, raw in zip(*part.columns[:3]):
                    yield x.as_py(), of.as_py(), raw.as_buffer()

        def finish(w, of):
            while heavy:
                yield heavy.pop()
            p, f = w
            some = (f >= min_count) & (p & 0xFFFFFFFF != 0)
            yield pa.RecordBatch.from_arrays(counted(2, p[some], p[some] * 0, f[some]), names=names)
            first = _cuts(p >> 32)
            one = p[first] >> 32 << 32
            yield pa.RecordBatch.from_arrays(counted(1, one, one * 0, np.add.reduceat(f, first)), names=names)

        yield from _by_bucket(rows(), 2, finish)
        yield from heavy

    by_node = edge_rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        nodes, f"bucket int, buckets int, raw binary, {found}")
    by_pair = by_node.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, found)
    # words come from several buckets
    counts = by_pair.groupBy(*H, "length").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return written(counts.select(*H, "f"), "phrase-flows")


def compact(heavy: DataFrame, nodes: DataFrame) -> DataFrame:
    """Maximal unary paths of the heavy edges: ``words`` (hashes) and ``f``, the weight of each of their edges.

    ``heavy`` has h1 to h4 and f, ``nodes`` h1 to h3 and f.  A node is unary if
    one edge brings its whole flow and one takes it away.  Every edge points to
    the one before it on its path, pointers double until they reach the path's
    first edge, so the rounds are the logarithm of the longest path.  A path lies
    within one piece of a text, so its row is no longer than that piece.
    """
    into = heavy.groupBy("h2", "h3", "h4").agg(F.max(F.struct("f", "h1")).alias("best")).select(
        F.col("h2").alias("a"), F.col("h3").alias("b"), F.col("h4").alias("c"), F.col("best.f").alias("f_in"),
        F.col("best.h1").alias("before"))
    out = heavy.groupBy("h1", "h2", "h3").agg(F.max("f").alias("f_out"))
    unary = (nodes.join(out, H[:3]).join(into, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")) & (F.col("h3") == F.col("c")))
             .where("f = f_in AND f = f_out").select("h1", "h2", "h3", "before"))
    e = heavy.join(unary, H[:3], "left")
    first = F.col("before").isNull()
    state = cut_lineage(e.select(
        *H, "f", *[F.when(first, F.col(own)).otherwise(F.col(prev)).alias(f"p{i}") for i, (own, prev) in enumerate(
            zip(H, ["before", "h1", "h2", "h3"]), 1)], F.when(first, 0).otherwise(1).cast("long").alias("dist")))
    total = -1
    while (now := state.agg(F.sum("dist")).first()[0] or 0) != total:
        total = now
        target = state.select(*[F.col(h).alias(f"q{i}") for i, h in enumerate(H, 1)],
                              *[F.col(f"p{i}").alias(f"r{i}") for i in range(1, 5)], F.col("dist").alias("more"))
        state = cut_lineage(state.join(target, [F.col(f"p{i}") == F.col(f"q{i}") for i in range(1, 5)]).select(
            *H, "f", *[F.col(f"r{i}").alias(f"p{i}") for i in range(1, 5)], (F.col("dist") + F.col("more")).alias("dist")))
    return state.groupBy("p1", "p2", "p3", "p4").agg(
        F.max("f").alias("f"), F.array_sort(F.collect_list(F.struct("dist", "h4"))).alias("steps")).select(
        F.concat(F.array("p1", "p2", "p3"), F.transform("steps", lambda s: s["h4"])).alias("words"), "f")


def _windows(paths: DataFrame, length: int, inner: bool = False) -> DataFrame:
    """Runs of ``length`` words of each path (``inner``: without the first and the last), as h1 to h4 and a."""
    last = F.size("words") - length + 1
    at = F.explode(F.sequence(F.lit(2), last - 1) if inner else F.sequence(F.lit(1), last))
    some = paths.where(last >= 3) if inner else paths
    return some.select("words", F.col("f").alias("a"), at.alias("i")).select(
        *[(F.element_at("words", F.col("i") + i) if i < length else F.lit(0).cast("long")).alias(h) for i, h in enumerate(H)], "a")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (h1 to h4, length, a) with l, r and score of their lowest-scoring cut."""
    words = F.array(*H)

    def run_of(start: Column, n: Column) -> list[Column]:
        return [F.when(F.lit(i) < n, F.element_at(words, F.least(start + i, F.lit(4)))).otherwise(F.lit(0).cast("long"))
                for i in range(4)]

    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    left, right = run_of(F.lit(1), F.col("k")), run_of(F.col("k") + 1, F.col("length") - F.col("k"))
    parts = cut.select("*", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), *[x.alias(f"p{i}") for i, x in enumerate(p, 1)])
                                                for side, p in (("l", left), ("r", right))])).alias("p")).select(
        *H, "length", "a", "k", "p.*")
    look = counts.select(*[F.col(h).alias(f"q{i}") for i, h in enumerate(H, 1)], F.col("f").alias("part_f"))
    both = parts.join(look, [F.col(f"p{i}") == F.col(f"q{i}") for i in range(1, 5)]).groupBy(*H, "length", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"))
    # decimal: the product may pass 64 bits; the quotient is at most 1,000,000
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = F.min(F.struct("score", "k", "l", "r"))
    return both.withColumn("score", score).groupBy(*H, "length", "a").agg(lowest.alias("m")).select(
        *H, "length", "a", "m.l", "m.r", "m.score")


def mine(docs: DataFrame, min_count: int = 30, top: int = 2000, inside_percent: int = 80, lang_col: str = "lang",
         text_col: str = "text", max_words: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = _texts(docs, lang_col, text_col)
    words = vocabulary(texts)
    frequent, salt = numbered(words, min_count)
    counts = flows(edges(texts, frequent, salt, max_words), min_count)
    by_length = [counts.where(F.col(H[i]) != 0) if i == 3 else counts.where((F.col(H[i]) != 0) & (F.col(H[i + 1]) == 0))
                 for i in range(4)]
    nodes = by_length[2].drop("h4")
    paths = cut_lineage(compact(by_length[3], nodes))
    four = _windows(paths, 4).withColumn("length", F.lit(4))
    inner = _windows(paths, 3, inner=True)  # unary nodes: their neighbours' count, so never kept
    three = by_length[2].withColumnRenamed("f", "a").join(inner.select(*H), H, "left_anti").withColumn("length", F.lit(3))
    two = by_length[1].withColumnRenamed("f", "a").withColumn("length", F.lit(2))
    # a candidate lies in a longer one of count c: the greatest c among those one word longer tells all
    longer = four.unionByName(three).unionByName(inner.withColumn("length", F.lit(3)))
    zero = F.lit(0).cast("long")
    runs = longer.select("a", F.explode(F.array(
        F.struct(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.when(F.col("length") == 4, F.col("h3")).otherwise(zero).alias("s3")),
        F.struct(F.col("h2").alias("s1"), F.col("h3").alias("s2"), F.when(F.col("length") == 4, F.col("h4")).otherwise(zero).alias("s3"))))
        .alias("s")).groupBy("s.s1", "s.s2", "s.s3").agg(F.max("a").alias("inside"))
    short = three.unionByName(two)
    short = short.join(runs, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("h3") == F.col("s3")), "left").where(
        F.col("inside").isNull() | (F.col("inside").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent)).select(
        *four.columns)
    kept = cut_lineage(_scored(four.unionByName(short), counts))
    # words again, then ranks: first within parts of a language, so that no language has to pass one task
    named = kept.select(F.struct(*H).alias("id"), "length", "a", "l", "r", "score", F.posexplode(F.array(*H)).alias("i", "code")).where(
        "code <> 0").join(frequent.select("code", "lang", "word"), "code")
    named = named.groupBy("id", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
