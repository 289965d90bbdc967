"""Registered queries over files and streams that Spark writes from the
test tables into the shared scratch folder (under ``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tokens import add_specials, byte_ids
from ..operators.convert import convert_to_text, detect_format
from ..operators.pack import concat_and_chunk
from ..session import scratch_path
from ..sources import files as fl
from ..sources import sinks as sk
from ..sources.sinks import cached_stage
from ..sources.tables import table
from ..streaming import ingest as ig
from .queries_core import P01_SQL
from .records import conversation_records
from .registry import duck_strip, query


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


S01_SQL = f"""
SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (
  SELECT {duck_strip('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE line <> ''
"""


@query("s01_text_lines", S01_SQL)
def s01(spark, sf):
    """S11 write + S01 read: documents written as text files, read back one
    record per line, stripped, blanks dropped."""
    path = _scratch(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = fl.read_lines(spark, path)
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


#: Bytes of all records for which there is one more array file of each shape.
ARRAY_BYTES = 64 << 20

S03_SQL = f"""
SELECT fmt, count(*) AS n_records, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars
FROM ({P01_SQL}) GROUP BY fmt
"""


@query("s03_jsonl_convert", S03_SQL)
def s03(spark, sf):
    """S03 + X20 + P01: heterogeneous JSON Lines written from the
    conversations, read back as VARIANT and converted."""
    path = _scratch(spark, "jsonl")
    conversation_records(spark, sf).select("json").write.text(path)
    r = fl.read_jsonl(spark, path)
    out = r.select(detect_format("rec").alias("fmt"), convert_to_text("rec").alias("text"))
    return out.groupBy("fmt").agg(F.count(F.lit(1)).alias("n_records"),
                                  F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))


@query("s02_json_array_convert", S03_SQL)
def s02(spark, sf):
    """JSON array files of each record shape, exploded back to records."""
    path = _scratch(spark, "jsonarr")
    recs = conversation_records(spark, sf)
    n = recs.agg(F.sum(F.octet_length("json"))).first()[0] or 0
    arrays = recs.groupBy("shape", F.pmod(F.xxhash64("conv_id"), F.lit(n // ARRAY_BYTES + 1)).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
    # one array per file, one directory per shape
    arrays.drop("part").write.option("maxRecordsPerFile", 1).partitionBy("shape").text(path)
    r = fl.read_json_array(spark, path)
    out = r.select(detect_format("rec").alias("fmt"), convert_to_text("rec").alias("text"))
    return out.groupBy("fmt").agg(F.count(F.lit(1)).alias("n_records"),
                                  F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))


@query("s11_s19_shards_manifest",
       "SELECT source AS src, count(*) AS num_samples FROM documents GROUP BY source")
def s11(spark, sf):
    """S11 + S12 + S19 + S13: sharded write (dealt out by size), reload,
    per-source manifest; metadata written beside the data."""
    path = _scratch(spark, "shards")
    d = table(spark, sf, "documents").select(F.col("source").alias("src"), "doc_id", "text")
    n = sk.write_shards(d, path)
    sk.write_metadata(spark, path + "-metadata", dataset="documents", num_shards=n)
    back = spark.read.parquet(path)
    return sk.manifest(back, path).select("src", "num_samples")


R05_SQL = "SELECT lang, count(*) AS n_rows FROM documents GROUP BY lang"


def _stream_source(spark, sf, batches: int = 4):
    """Files for ``batches`` micro-batches of the given number of files; a file has about as much as a scan's task reads."""
    path, d = _scratch(spark, "stream-src"), table(spark, sf, "documents")
    each = -(-d.rdd.getNumPartitions() // batches)
    d.repartitionByRange(batches * each, "doc_id").write.parquet(path)
    return path, d.schema.simpleString()[7:-1].replace(":", " "), each


@query("r05_stream_language_counts", R05_SQL)
def r05(spark, sf):
    """R01 + R05: documents streamed file by file; running count per language."""
    src, schema, each = _stream_source(spark, sf)
    s = ig.stream_records(spark, src, schema, max_files_per_trigger=each, min_chars=None)
    name = "r05_" + uuid.uuid4().hex[:8]
    ig.run_available(ig.running_counts(s, "lang"), None, _scratch(spark, "ckpt-r05"), mode="complete",
                     fmt="memory", query_name=name)
    return spark.table(name)


@query("r02_stream_sources", f"""
SELECT lang AS src, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
WHERE length({duck_strip('text')}) > 50 GROUP BY lang""")
def r02(spark, sf):
    """R02 + U02: a source folder for each language, all read as one stream and written as one table."""
    root, d = _scratch(spark, "r02-src"), table(spark, sf, "documents")
    d.withColumn("folder", F.col("lang")).write.partitionBy("folder").parquet(root)
    schema = d.schema.simpleString()[7:-1].replace(":", " ")
    names = [r["lang"] for r in d.select("lang").distinct().orderBy("lang").collect()]  # the languages' fixed table
    s = ig.stream_sources(spark, {n: f"{root}/folder={n}" for n in names}, schema)
    sink = _scratch(spark, "r02-out")
    ig.run_available(s, sink, _scratch(spark, "ckpt-r02"))
    return spark.read.parquet(sink).groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"),
                                                       F.sum(F.length("text")).cast("bigint").alias("n_chars"))


R03_SQL = f"""
SELECT lang, CAST(least(count(*), 100) AS BIGINT) AS n_kept FROM documents
WHERE length({duck_strip('text')}) > 50 GROUP BY lang
"""


@query("r03_stream_cap_per_language", R03_SQL)
def r03(spark, sf):
    """R01 + R03: length-filtered stream, at most 100 documents per language
    over the whole stream (state per language)."""
    src, schema, each = _stream_source(spark, sf)
    s = ig.stream_records(spark, src, schema, max_files_per_trigger=each).select("doc_id", "lang", "text")
    capped = ig.cap_per_key(s, "lang", "doc_id", 100, "doc_id long, lang string, text string")
    sink = _scratch(spark, "r03-out")
    ig.run_available(capped, sink, _scratch(spark, "ckpt-r03"))
    return spark.read.parquet(sink).groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_kept"))


@query("r03_stream_cap_ids", f"""
SELECT doc_id, lang FROM documents WHERE length({duck_strip('text')}) > 50
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25""")
def r03_ids(spark, sf):
    """R03 with all files in one micro-batch: the first 25 documents of each language, by id."""
    src, schema, each = _stream_source(spark, sf)
    s = ig.stream_records(spark, src, schema, max_files_per_trigger=64 * each).select("doc_id", "lang")
    sink = _scratch(spark, "r03-ids")
    ig.run_available(ig.cap_per_key(s, "lang", "doc_id", 25, "doc_id long, lang string"), sink, _scratch(spark, "ckpt-r03-ids"))
    return spark.read.parquet(sink)


@query("s18_cached_stage", "SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang")
def s18(spark, sf):
    """A stage built twice at the same time, so that the second commit loses, and read a third time from the cache."""
    root = _scratch(spark, "s18")

    def counted():
        return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))

    def slow():  # another build finishes while this one is under way
        cached_stage(spark, root, counted)
        return counted().where("n_docs < 0")

    cached_stage(spark, root, slow)
    return cached_stage(spark, root, counted)


@query("r04_stream_pack")
def r04(spark, sf):
    """R04 + U04: each micro-batch is tokenised and packed as its own segment, appended as a shard of
    packed sequences (ids and mask), and the shards are read back as one table."""
    src, schema, each = _stream_source(spark, sf)
    s = ig.stream_records(spark, src, schema, max_files_per_trigger=each)
    sink = _scratch(spark, "r04-out")

    def pack(batch):
        toks = batch.select(F.col("source").alias("src"), F.col("doc_id").alias("row_idx"), "text")
        ch = concat_and_chunk(toks, 2048, ids=add_specials(byte_ids("text")), n=F.octet_length("text") + 2)
        return ch.select("src", "segment", "chunk_id", "input_ids", "attention_mask", F.size("input_ids").alias("n_tokens"))

    ig.run_available(s, None, _scratch(spark, "ckpt-r04"), foreach_batch=ig.pack_batches(pack, sink))
    return spark.read.parquet(sink)
