"""Small fixtures for the operators of the training-data folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

#: Columns whose names the operators also use for results or might use inside.
CLASHING = ["digest", "fp", "key", "rate", "shard", "slot", "kept", "size", "line", "n", "root", "uid"]


def docs(spark, rows):
    """Rows of (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(None, None, None, None), (1, None, "a", "en"), (2, "", "a", "en"), (3, "", "a", "en"), (4, " \t\n ", None, None),
           (5, "one", "b", "en"), (5, "one", "b", "en"), (None, "one", "b", "en"), (7, "lang " * 30_000, "b", "en"),
           (8, "é ü 漢字 \U0001f600 end", "c", "de"), (9, "x\ny\nx\n\nx", "c", "de"), (10, "<|endoftext|> a", "c", "de")]
