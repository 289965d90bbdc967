"""Hilbert-curve sharding (DataFrame functions only).

Metadata columns are quantised to equal-depth cells, the cells of a document
give its place on a Hilbert curve, and the documents, sorted by that place,
are cut into runs.  Neighbours on the curve are neighbours in every dimension,
so a run covers a small box and a filter on any of the dimensions skips most
files.

The curve orders cells only; documents of one cell follow in the order of a
digest of their doc_id.  That lets a hot cell be ranked in many tasks.

Defined cases: a null string is the empty string and a null number the
smallest; a null text has size 1 and the CRC of no bytes; equal rows get
neighbouring places; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import let, ranked


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve through a grid of ``2 ** bits`` cells a side.

    The axes are turned into the curve's transposed index by Skilling's method:
    from the highest bit down, exchange or invert the low bits of the first
    axis, then Gray-encode, then interleave.  ``F.aggregate`` carries the axes
    as an array, so the expression stays small at any number of bits.
    """
    n = len(cells)
    axes = F.array(*[c.cast("int") for c in cells])
    if n < 2:
        return cells[0].cast("long")

    def turned(i: int, p: Column, q: Column):
        def one(v: Column) -> Column:
            a, b = F.get(v, F.lit(0)), F.get(v, F.lit(i))
            t = a.bitwiseXOR(b).bitwiseAND(p)
            hit = b.bitwiseAND(q) != 0
            first = F.when(hit, a.bitwiseXOR(p)).otherwise(a.bitwiseXOR(t))
            other = F.when(hit, b).otherwise(b.bitwiseXOR(t))
            return F.array(*[first if k == 0 else other if k == i else F.get(v, F.lit(k)) for k in range(n)])
        return one

    def turn(x: Column, q: Column) -> Column:
        for i in range(n):
            x = let(x, turned(i, q - 1, q))
        return x

    powers = F.array(*[F.lit(1 << k) for k in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    x = F.aggregate(powers, axes, turn)

    def gray(v: Column) -> Column:
        # axis i becomes the exclusive or of axes 0..i; then all are turned by the last one's bits
        out, acc = [], None
        for i in range(n):
            acc = F.get(v, F.lit(i)) if acc is None else acc.bitwiseXOR(F.get(v, F.lit(i)))
            out.append(acc)
        return F.array(*out)

    def finish(v: Column) -> Column:
        last = F.get(v, F.lit(n - 1))
        t = F.aggregate(powers, F.lit(0), lambda acc, q: F.when(
            last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return let(t, lambda s: F.transform(v, lambda a: a.bitwiseXOR(s)))

    def interleave(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(F.get(v, F.lit(i)), k).bitwiseAND(F.lit(1)).cast("long")
                out = out * 2 + bit
        return out

    return let(let(let(x, gray), finish), interleave)


def string_code(column: Column, shared: int) -> Column:
    """The two bytes behind the first ``shared`` characters, as a number: keeps the order, 65,536 values at most."""
    b = F.encode(F.substring(F.coalesce(column, F.lit("")), shared + 1, 2), "UTF-8")
    hexed = F.rpad(F.substring(F.hex(b), 1, 4), 4, "0")
    return F.conv(hexed, 16, 10).cast("int")


def size_code(column: Column) -> Column:
    """Eight steps for each doubling: keeps the order, some 500 values at most."""
    return F.floor(F.log2(F.greatest(F.coalesce(column, F.lit(1)), F.lit(1)).cast("double")) * 8).cast("int")


def _depth(codes: DataFrame, code: str, bits: int) -> DataFrame:
    """Equal-depth cell of each value of a code, from the rows below its middle; at most 65,536 rows."""
    below = F.sum("n").over(Window.orderBy(code).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy())
    return (codes.groupBy(code).agg(F.count(F.lit(1)).alias("n")).select(code, "n", below.alias("upto"), total.alias("all"))
            .select(F.col(code).alias(f"{code}_value"),
                    F.least(F.lit((1 << bits) - 1), F.floor((F.col("upto") * 2 - F.col("n")) * (1 << bits)
                                                            / (F.col("all") * 2))).cast("int").alias(f"{code}_cell")))


def place(docs: DataFrame, strings: list[str], id_col: str = "doc_id", text_col: str = "text",
          bits: int = 4) -> DataFrame:
    """Narrow rows (checkpointed): doc_id, size, text_crc32, the dimensions' cells and ``curve``.

    The dimensions are the string columns named and the size of the text.
    """
    bytes_ = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    raw = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(bytes_).cast("long") + 1).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"tl_s{i}") for i, c in enumerate(strings)]))
    ends = raw.agg(*[f(f"tl_s{i}").alias(f"{f.__name__}{i}") for i in range(len(strings)) for f in (F.min, F.max)]).first()
    codes, names = [], []
    for i in range(len(strings)):
        lo, hi = ends[f"min{i}"] or "", ends[f"max{i}"] or ""
        shared = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
        codes.append(string_code(F.col(f"tl_s{i}"), shared).alias(f"tl_c{i}"))
        names.append(f"tl_c{i}")
    names.append("tl_size")
    codes.append(size_code(F.col("size")).alias("tl_size"))
    out = raw.select("doc_id", "size", "text_crc32", *codes)
    for c in names:
        depth = _depth(out.select(c), c, bits)
        out = out.join(F.broadcast(depth), F.col(c) == F.col(f"{c}_value")).drop(c, f"{c}_value")
    cells = [F.col(f"{c}_cell") for c in names]
    return cut_lineage(out.select("doc_id", "size", "text_crc32", *[c.alias(f"cell_{i}") for i, c in enumerate(cells)],
                                  hilbert_index(cells, bits).alias("curve")))


def shard(docs: DataFrame, strings: list[str], shards: int = 8, law: str = "rows", id_col: str = "doc_id",
          text_col: str = "text", bits: int = 4) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, law, shard, slot, curve and cells.

    ``rows`` cuts runs whose counts differ by one at most; ``bytes`` cuts at
    equal sums of sizes, so shards differ by a document at most.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    p = place(docs, strings, id_col, text_col, bits).withColumn(
        "tl_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ties = ["doc_id", "size", "text_crc32"]
    r = ranked(p, ["curve"], "tl_key", ties, "tl_in_cell")
    cells = (p.groupBy("curve").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
             .select(F.col("curve").alias("tl_curve"), "n", "bytes",
                     F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
                     F.sum("n").over(Window.partitionBy()).alias("all"),
                     F.sum("bytes").over(Window.partitionBy()).alias("all_bytes")))  # a row for each cell: 2 ** (bits * dimensions)
    r = r.join(F.broadcast(cells), F.col("curve") == F.col("tl_curve")).withColumn(
        "tl_rank", F.col("upto") - F.col("n") + F.col("tl_in_cell"))
    if law == "rows":
        out = r.withColumn("shard", F.floor(F.col("tl_rank") * shards / F.col("all")).cast("int"))
        start = F.ceil(F.col("shard").cast("long") * F.col("all") / shards).cast("long")
        out = out.withColumn("slot", F.col("tl_rank") - start)
    else:
        # running bytes in curve order: within ranges of a million ranks, and before each range
        part = cut_lineage(r.withColumn("tl_range", F.floor(F.col("tl_rank") / 1_000_000)))
        before = (part.groupBy("tl_range").agg(F.sum("size").alias("b"))
                  .select(F.col("tl_range").alias("tl_r"), (F.sum("b").over(
                      Window.orderBy("tl_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("b")).alias("tl_b")))
        run = F.sum("size").over(Window.partitionBy("tl_range").orderBy("tl_rank").rowsBetween(Window.unboundedPreceding, -1))
        out = (part.withColumn("tl_run", F.coalesce(run, F.lit(0))).join(F.broadcast(before), F.col("tl_range") == F.col("tl_r"))
               .withColumn("shard", F.floor((F.col("tl_b") + F.col("tl_run")) * shards / F.col("all_bytes")).cast("int")))
        first = out.groupBy(F.col("shard").alias("tl_shard")).agg(F.min("tl_rank").alias("tl_first"))
        out = out.join(F.broadcast(first), F.col("shard") == F.col("tl_shard")).withColumn(
            "slot", F.col("tl_rank") - F.col("tl_first"))
    cell_names = [c for c in p.columns if c.startswith("cell_")]
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve", *cell_names)
