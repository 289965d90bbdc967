"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it.

Each query applies its operator with production parameters to the whole of
its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (conversation_repair, exact_dedup, hilbert, html_extract, line_dedup, mixing, packing, phrases, quality_classifier, quality_rules,
               simhash, suffix_dedup, token_counts)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ 2 line dedup


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.decide(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "n_near",
                    F.col("dropped").alias("dropped_lines"))


# ---------------------------------------------------------------------- 3 SimHash


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ----------------------------------------------------------------------- 5 mixing

_UNIFORM = "(('0x' || substr(md5('7|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS bytes FROM documents),
s AS (SELECT source, sum(bytes)::DOUBLE AS size FROM d GROUP BY source),
r AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM r, range(0, 2000) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
f AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM p),
u AS (SELECT doc_id, source, {_UNIFORM} AS u FROM d),
n AS (SELECT doc_id, u.source, any_value(rate) AS rate, count(*) AS n_copies
      FROM u JOIN f ON u.source = f.source AND f.f <= u.u GROUP BY doc_id, u.source),
c AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy, rate FROM n)
SELECT doc_id, source, n_copies, copy, rate,
       row_number() OVER (ORDER BY md5('7+|' || doc_id::VARCHAR || '|' || copy::VARCHAR), doc_id, copy) - 1 AS position
FROM c"""


@query("op5_poisson_mixing", MIXING_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------- 6 packing


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


# ---------------------------------------------------------------- 8 quality rules

_WS = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, {_WORDS} AS w, text FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT doc_id, i, w[i:i + 2] AS tri FROM g),
rep AS (SELECT doc_id, tri FROM t GROUP BY doc_id, tri HAVING count(*) > 1),
cov AS (SELECT DISTINCT t.doc_id, t.i + o.o AS place FROM t JOIN rep USING (doc_id, tri), (VALUES (0), (1), (2)) o(o)),
nrep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        GROUP BY doc_id),
lines AS (SELECT r.doc_id, d.source, d.text,
                 regexp_replace(regexp_replace(lower(line), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS line
          FROM raw r JOIN d USING (doc_id) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
freq AS (SELECT source, line FROM lines GROUP BY source, line
         HAVING count(DISTINCT text) > 20
            AND count(DISTINCT text) > 0.02 * (SELECT n FROM hosts h WHERE h.source = lines.source)),
lost AS (SELECT l.doc_id, sum(len(string_split(l.line, ' ')))::BIGINT AS n FROM lines l JOIN freq USING (source, line)
         GROUP BY l.doc_id),
base AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words,
                coalesce(lost.n, 0) AS n_frequent_words
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN nrep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_words - n_frequent_words >= 0.5 * n_words AS kept
FROM base"""


@query("op8_quality_rules", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality_rules.judge(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "n_frequent_words", "base_failed", "kept")


# ----------------------------------------------------------------------- 1 sharding


@query("op1_hilbert_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), ["source", "lang"], shards=8, law="rows").drop(
        "cell_0", "cell_1", "cell_2")


# -------------------------------------------------------------------- 4 exact dedup

EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = exact_dedup.judge(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# ------------------------------------------------------------- 7 quality classifier


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- 9 HTML extraction


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.trained()).withColumn("n_chars", F.length("text").cast("long"))


# ------------------------------------------------------------------ 10 token counts


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


# --------------------------------------------------------- 11 conversation repair


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


# ------------------------------------------------------------ 13 phrase collocations


@query("op13_phrase_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------- 12 suffix-array dedup


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")
