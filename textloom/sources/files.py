"""File scans.

Row order matters to the packers, so every scan keeps an order key:
``(_metadata.file_path, _metadata.file_block_start, in-split position)``
for line files, and the array position for JSON-array files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip


def read_lines(spark: SparkSession, paths, strip: bool = True, drop_blank: bool = True) -> DataFrame:
    """One record per line, stripped, blank lines dropped.

    Output ``(path, block, line_no, text)``; ``(path, block, line_no)`` is
    the file order (``line_no`` increases inside a split)."""
    df = spark.read.text(paths if isinstance(paths, list) else [paths])
    df = df.select(F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))
    if strip:
        df = df.withColumn("text", py_strip("text"))
    if drop_blank:
        df = df.filter(F.col("text") != "") if strip else df.filter(py_strip("text") != "")
    return df


def read_json_array(spark: SparkSession, paths) -> DataFrame:
    """Files each holding one JSON array of heterogeneous records ->
    ``(path, pos, rec VARIANT, json)`` (whole-file read, as the format requires)."""
    raw = spark.read.text(paths if isinstance(paths, list) else [paths], wholetext=True)
    arr = F.try_variant_get(F.parse_json("value"), "$", "array<variant>")
    return (raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(arr).alias("pos", "rec"))
            .withColumn("json", F.to_json("rec")))


def read_jsonl(spark: SparkSession, paths) -> DataFrame:
    """JSON Lines, blank lines skipped -> ``(path, block, line_no, rec, json)``."""
    df = spark.read.text(paths if isinstance(paths, list) else [paths])
    df = df.filter(py_strip("value") != "")
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line_no"),
                     F.parse_json("value").alias("rec"), F.col("value").alias("json"))


def read_text_files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """Every matching file under ``root`` (recursively) is one document."""
    return (spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).text(root, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_text_records(spark: SparkSession, paths) -> DataFrame:
    """JSON Lines whose ``text`` key is mandatory: a malformed line or a
    missing ``text`` fails the job."""
    df = spark.read.schema("text string").option("mode", "FAILFAST").json(paths)
    # a filter keeps the assertion in the plan (a dropped column would be pruned)
    return df.where(F.assert_true(F.col("text").isNotNull(), "record without text").isNull())


def read_tolerant(spark: SparkSession, paths, schema: str) -> tuple[DataFrame, DataFrame]:
    """Many JSON Lines files at once.  Missing and unreadable files are
    skipped, malformed records are kept out of the data, and the report has a
    row for each path asked for: ``status`` (read, missing or unreadable),
    records and corrupt records."""
    from .tables import _exists
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [p for p in paths if _exists(spark, p)]
    full = schema + ", _corrupt_record string"
    if found:
        raw = (spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(found)
               .filter(F.trim("value") != ""))
        how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        df = raw.select(F.from_json("value", full, how).alias("r"), F.col("_metadata.file_path").alias("path")).select("r.*", "path")
    else:
        df = spark.createDataFrame([], full + ", path string")
    good = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    asked = spark.createDataFrame([(p, p in found) for p in paths], "asked string, found boolean")
    counts = df.groupBy("path").agg(F.count(F.lit(1)).alias("n_records"), F.count("_corrupt_record").alias("n_corrupt"))
    # a path is matched with the file's URI by its end; folders match what lies below them
    hit = F.col("path").endswith(F.col("asked")) | F.col("path").contains(F.concat(F.col("asked"), F.lit("/")))
    report = asked.join(counts, hit, "left")  # one row for each file on either side
    return good, report.select(
        F.coalesce("path", "asked").alias("path"),
        F.when(~F.col("found"), "missing").when(F.col("path").isNull(), "unreadable").otherwise("read").alias("status"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_corrupt", F.lit(0)).alias("n_corrupt"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """``step, loss, learning_rate`` JSON Lines."""
    return spark.read.schema("step int, loss double, learning_rate double").json(path)


def read_tokenizer_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tokenizer artefact ``{"model": {"type", "vocab": {tok: id},
    "merges": ["a b" | ["a","b"]]}}`` -> (vocab, merges, info) tables.
    Both merge spellings are normalised to ``(l, r)`` (X18)."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    raw.createOrReplaceTempView("_tok_raw")
    vocab = spark.sql("SELECT key AS token, CAST(variant_get(value, '$', 'int') AS INT) AS id "
                      "FROM _tok_raw, LATERAL variant_explode(variant_get(v, '$.model.vocab'))")
    merges = spark.sql("SELECT CAST(pos AS INT) AS rank, value AS m "
                       "FROM _tok_raw, LATERAL variant_explode(variant_get(v, '$.model.merges'))")
    as_str = F.try_variant_get("m", "$", "string")
    as_arr = F.try_variant_get("m", "$", "array<string>")
    merges = merges.select("rank",
                           F.coalesce(F.element_at(as_arr, 1), F.substring_index(as_str, " ", 1)).alias("l"),
                           F.coalesce(F.element_at(as_arr, 2),
                                      F.expr("substring(try_variant_get(m, '$', 'string'), "
                                             "instr(try_variant_get(m, '$', 'string'), ' ') + 1)")).alias("r"))
    info = raw.select(F.try_variant_get("v", "$.model.type", "string").alias("type"))
    return vocab, merges, info
