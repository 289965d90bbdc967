"""Quality rules with cross-document line frequency (DataFrame functions only).

Base rules look at one text: its words, symbols, repeated lines and repeated
three-word windows.  The cross-document rule hashes normalised lines, counts
for each host the distinct documents that hold a line, and takes lines above
the limit out; a document that loses too much is rejected.

Defined cases: a null text is an empty text (0 words, fails the base rules); a
null host is a host of its own; exact copies and repeated rows count as one
document in the frequencies and each get the same verdict; lines without a
word count nowhere; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE_RUN, SPACES, let, words_of

SYMBOL_RUN = r"[^#*$%&|<>]+"


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, first ones included.

    A window becomes a long: its hash in the high bits, its place in the low
    bits.  After sorting, equal windows are neighbours; where the hashes agree
    the words are compared too, so a chance collision counts nothing.
    """
    def body(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("long")))

        def key(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        def starts(s: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

            def same(x: Column, y: Column) -> Column:
                i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
                return ((F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0)
                        & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1))
                        & (F.get(w, i + 2) == F.get(w, j + 2)))

            hit = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
                           | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(mask)))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"),
                                                                 F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))),
                               F.lit(0).cast("long"), lambda acc, x: acc + x)

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(let(keys, starts), covered))

    return let(words, body)


def base_columns(text: Column) -> dict[str, Column]:
    """The five base counts of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    return {"words": by_words,
            "n_symbols": F.length(F.regexp_replace(t, SYMBOL_RUN, "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))}


def normal_line(line: Column) -> Column:
    """A line for counting: lower case, white space squeezed to one space."""
    return F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), SPACE_RUN, " ")


def line_keys(text: Column) -> Column:
    """The distinct normalised lines of a text, hashed, with their words (all occurrences)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")

    def grouped(ls: Column) -> Column:
        keyed = F.transform(ls, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("2"), x).alias("h2"),
                                                   F.size(F.split(x, " ")).cast("long").alias("w")))
        return keyed

    return let(lines, grouped)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One narrow row for each document: base counts, host, content digest and line keys (checkpointed)."""
    c = base_columns(F.col(text_col))
    m = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        c["words"].alias("tl_words"), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"),
        line_keys(F.col(text_col)).alias("lines"))
    m = m.select("doc_id", "host", "digest", "tl_words.*", "n_symbols", "n_dup_lines", "lines",
                 F.monotonically_increasing_id().alias("uid"))
    return cut_lineage(m.withColumn("base_failed", (F.col("n_words") < min_words)
                                    | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)))


def frequent_lines(m: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Lines that more than ``max(min_docs, min_share * documents)`` distinct documents of a host hold.

    Counts have a partial sum in each map task, and the line's hash is part of
    the key, so neither a hot host nor a hot line lands in one task.
    """
    once = m.select("host", "digest", F.explode("lines").alias("l")).select("host", "digest", "l.h", "l.h2").distinct()
    docs_of = m.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = (once.groupBy("host", "h", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs))
    return (counts.join(docs_of.withColumnRenamed("host", "tl_host"), F.col("host").eqNullSafe(F.col("tl_host")))
            .where(F.col("n_docs") > F.col("host_docs") * min_share)
            .select("host", "h", "h2", "n_docs"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, min_share: float = 0.02,
          min_left: float = 0.5) -> DataFrame:
    """Verdict for each document (one row for each input row).

    Returns doc_id, the base counts, base_failed, n_frequent_words (words in
    lines above the frequency limit of the document's host), kept, and the
    working columns uid, digest and frequent (hashes of those lines).
    """
    m = measure(docs, id_col, text_col, host_col, min_words, max_repeat_percent)
    often = frequent_lines(m, min_docs, min_share).select(
        F.col("host").alias("tl_host"), F.col("h").alias("tl_h"), F.col("h2").alias("tl_h2"))
    lines = m.select("uid", "host", F.explode("lines").alias("l")).select("uid", "host", "l.*")
    lost = (lines.join(often, F.col("host").eqNullSafe(F.col("tl_host")) & (F.col("h") == F.col("tl_h"))
                       & (F.col("h2") == F.col("tl_h2")))
            .groupBy("uid").agg(F.sum("w").alias("n_frequent_words"), F.collect_set("h").alias("frequent")))
    out = m.drop("lines").join(lost, "uid", "left").withColumn(
        "n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_frequent_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * min_left))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     **limits) -> DataFrame:
    """The documents that pass, without the lines above the limit.

    All columns of ``docs`` stay; ``n_chars``, where present, follows the text.
    Repeated rows have one verdict and all stay (deduplication is not this
    operator's work).
    """
    verdict = judge(docs, id_col, text_col, host_col, **limits).where("kept").select(
        F.col("doc_id").alias("tl_id"), F.col("digest").alias("tl_digest"), F.col("host").alias("tl_host"),
        F.col("frequent").alias("tl_frequent")).dropDuplicates(["tl_id", "tl_digest", "tl_host"])
    t = F.col(text_col)
    kept = docs.withColumn("tl_d", F.xxhash64(F.coalesce(t, F.lit("")))).join(
        verdict, F.col(id_col).eqNullSafe(F.col("tl_id")) & (F.col("tl_d") == F.col("tl_digest"))
        & F.col(host_col).cast("string").eqNullSafe(F.col("tl_host")))
    without = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(
        F.col("tl_frequent"), F.xxhash64(normal_line(x)))), "\n")
    kept = kept.withColumn(text_col, F.when(F.col("tl_frequent").isNull(), t).otherwise(without))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
