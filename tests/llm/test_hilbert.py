import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, with_clashes
from textloom.llm import hilbert
from textloom.sources.tables import table


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 4)])
def test_curve_visits_every_cell_and_moves_one_step(spark, n, bits):
    df = spark.range(1)
    for i in range(n):
        df = df.crossJoin(spark.range(1 << bits).select(F.col("id").cast("int").alias(f"x{i}")))
    cells = [F.col(f"x{i}") for i in range(n)]
    rows = sorted(df.select(*cells, hilbert.hilbert_index(cells, bits).alias("h")).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(1 << bits * n))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def check(rows, shards, total):
    assert len(rows) == total
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    return {s: len(v) for s, v in by.items()}


def test_rows_law_on_the_documents(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    rows = hilbert.shard(d, ["source", "lang"]).collect()
    counts = check(rows, 8, d.count())
    assert max(counts.values()) - min(counts.values()) <= 1
    texts = {r.doc_id: r.text.encode() for r in d.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    # a filter on either dimension skips shards
    lang = {r.doc_id: r.lang for r in d.collect()}
    touched = Counter(x for x, _ in {(lang[r.doc_id], r.shard) for r in rows})
    assert min(touched.values()) < 8


def test_bytes_law(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    rows = hilbert.shard(d, ["source", "lang"], law="bytes").collect()
    check(rows, 8, d.count())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_awkward_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, AWKWARD))
    counts = check(hilbert.shard(d, ["source", "lang"], shards=5).collect(), 5, len(AWKWARD))
    assert max(counts.values()) - min(counts.values()) <= 1
    assert hilbert.shard(d.limit(0), ["source", "lang"]).count() == 0
    with pytest.raises(ValueError):
        hilbert.shard(d, ["lang"], law="key")


def test_ranks_of_a_hot_cell_use_many_buckets(spark):
    from textloom.llm.common import ranked

    d = spark.range(2000).select("id", F.lit(1).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    got = ranked(d, ["g"], "k", ["id"], "r", rows_per_bucket=100).orderBy("r").collect()
    assert [r.r for r in got] == list(range(2000))
    assert [r.k for r in got] == sorted(r.k for r in got)
