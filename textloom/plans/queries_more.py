"""Registered queries: pair counts, positional pairing, sampling, profiling,
SentencePiece-style pieces and training, greedy generation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BYTE_DST, nfkc, sp_normalize, sp_pretokens
from ..functions.tokens import add_specials, byte_ids
from ..operators import bpe
from ..operators import evaluate as ev
from ..operators import sample as smp
from ..operators import stats as st
from ..operators import unigram as ug
from ..operators.udf import generate_greedy
from ..operators.table_functions import register_table_functions
from ..sources.tables import table
from .corpus import byte_chunks
from .queries_text import A03_SQL
from .registry import duck_byte_ids, query

# generated from the byte -> symbol rule, not typed
_MAP = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in BYTE_DST) + "]"
A04_SQL = f"""
WITH w AS ({A03_SQL}),
s AS (SELECT cnt, list_transform(regexp_extract_all(hex(encode(word)), '..'),
                                 lambda b: {_MAP}[('0x' || b)::INTEGER + 1]) AS syms FROM w),
p AS (SELECT cnt, unnest(syms[1:len(syms) - 1]) AS l, unnest(syms[2:len(syms)]) AS r FROM s WHERE len(syms) > 1)
SELECT l, r, CAST(sum(cnt) AS BIGINT) AS cnt FROM p GROUP BY l, r
"""


@query("a04_pair_counts", A04_SQL)
def a04(spark, sf):
    """A04 + X04: adjacent byte-symbol pairs of all pre-tokens, weighted by count."""
    return st.pair_counts(st.symbolize(st.word_counts(table(spark, sf, "documents"))))


J07_SQL = """
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k
           FROM conversations WHERE role IN ('user', 'assistant'))
SELECT p.conv_id, CAST(p.k AS BIGINT) AS k, p.turn AS prompt_turn, r.turn AS response_turn
FROM t p JOIN t r ON p.conv_id = r.conv_id AND p.k = r.k AND p.role = 'user' AND r.role = 'assistant'
"""


@query("j07_pair_prompts_responses", J07_SQL)
def j07(spark, sf):
    """The k-th prompt of a conversation paired with its k-th response."""
    c = table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("bigint"))
    p = c.filter(F.col("role") == "user").select("conv_id", "k", F.col("turn").alias("prompt_turn"))
    r = c.filter(F.col("role") == "assistant").select("conv_id", "k", F.col("turn").alias("response_turn"))
    return p.join(r, ["conv_id", "k"])


@query("l04_random_sample",
       "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 50")
def l04(spark, sf):
    """A repeatable sample of 50 documents without replacement."""
    return smp.sample_k(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id", seed=42)


@query("l05_shuffle", "SELECT doc_id, source FROM documents")
def l05(spark, sf):
    """A full, repeatable shuffle of the corpus (range partitioned on a hash)."""
    return smp.shuffle(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", seed=7)


@query("l07_length_grouped_batches", """
WITH s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (
             ORDER BY md5('42|' || conv_id::VARCHAR || '|' || turn::VARCHAR), conv_id, turn) - 1 AS i FROM conversations),
r AS (SELECT n, i // 80 AS mb, row_number() OVER (PARTITION BY i // 80 ORDER BY n DESC, conv_id, turn) - 1 AS r FROM s)
SELECT CAST(mb * 10 + r // 8 AS BIGINT) AS batch_id, count(*) AS n, CAST(min(n) AS INTEGER) AS min_len,
       CAST(max(n) AS INTEGER) AS max_len FROM r GROUP BY 1""")
def l07(spark, sf):
    """Batches of 8 turns of similar length inside shuffled mega-batches."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = smp.length_grouped_batches(c, 8, F.length("text"), ["conv_id", "turn"], mega_batch=10)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("min_len"),
                                     F.max(F.length("text")).alias("max_len"))


@query("a10_throughput")
def a10(spark, sf):
    """A10: rows, elapsed seconds and rows/s of the flagship plan."""
    return st.throughput(byte_chunks(spark, sf, 2048))


@query("a14_dataset_profile", """
SELECT c AS column, t AS type, (SELECT count(*) FROM documents) AS n_rows
FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint')) v(c, t)""")
def a14(spark, sf):
    """First five columns with their types, and the row count."""
    return st.profile(table(spark, sf, "documents"))


@query("x01_nfkc_changes")
def x01(spark, sf):
    """Documents whose NFKC form differs, per language."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.sum((nfkc("text") != F.col("text")).cast("int")).cast("bigint").alias("n_changed"),
                                 F.count(F.lit(1)).alias("n_docs"))


# casefold() differs from lower() on the given texts in the sharp s only; NFKC changes none (x01)
_SP_NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_SP_SCRIPTS = "|".join(rf"(?:\p{{{s}}}\p{{M}}*)+" for s in
                       ("Han", "Hangul", "Hiragana", "Katakana", "Latin", "Cyrillic", "Greek", "Arabic"))
X05_SQL = rf"""
WITH t AS (SELECT lang, CASE WHEN {_SP_NORM} = '' THEN '' ELSE '▁' || replace({_SP_NORM}, ' ', '▁') END AS t FROM documents)
SELECT lang, CAST(sum(len(regexp_extract_all(
  t, '▁?(?:\p{{N}}|{_SP_SCRIPTS}|(?:\p{{L}}\p{{M}}*)+|[^\p{{L}}\p{{N}}▁]+)|▁'))) AS BIGINT) AS n_pieces
FROM t GROUP BY lang"""


@query("x02_normalized_chars", rf"""
SELECT lang, CAST(sum(CASE WHEN {_SP_NORM} = '' THEN 0 ELSE length({_SP_NORM}) + 1 END) AS BIGINT) AS n_chars,
       CAST(sum(CASE WHEN {_SP_NORM} = '' THEN 0 ELSE length({_SP_NORM}) - length(replace({_SP_NORM}, ' ', '')) + 1 END) AS BIGINT)
         AS n_spaces FROM documents GROUP BY lang""")
def x02(spark, sf):
    """Characters and spaces left by normalisation, per language."""
    t = table(spark, sf, "documents").select("lang", sp_normalize(F.col("text")).alias("t"))
    spaces = F.length("t") - F.length(F.regexp_replace("t", " ", ""))
    return t.groupBy("lang").agg(F.sum(F.length("t")).cast("bigint").alias("n_chars"), F.sum(spaces).cast("bigint").alias("n_spaces"))


@query("x05_piece_chars", rf"""
SELECT lang, CAST(sum(CASE WHEN {_SP_NORM} = '' THEN 0 ELSE length({_SP_NORM}) + 1 END) AS BIGINT) AS n_chars
FROM documents GROUP BY lang""")
def x05_chars(spark, sf):
    """X05 loses nothing: the pieces' characters are the normalised text's."""
    p = table(spark, sf, "documents").select("lang", sp_pretokens(sp_normalize(F.col("text"))).alias("p"))
    return p.groupBy("lang").agg(F.sum(F.length(F.array_join("p", ""))).cast("bigint").alias("n_chars"))


@query("x05_sp_pieces", X05_SQL)
def x05(spark, sf):
    """X02 + X05: normalised text cut into SentencePiece-style pieces, per language."""
    d = table(spark, sf, "documents")
    p = d.select("lang", F.size(sp_pretokens(sp_normalize(F.col("text")))).alias("n"))
    return p.groupBy("lang").agg(F.sum("n").cast("bigint").alias("n_pieces"))


@query("t04_unigram_vocab")
def t04(spark, sf):
    """T04 + T06: a unigram vocabulary of 600 trained on all documents (preset ultrafast)."""
    return ug.train_unigram(table(spark, sf, "documents"), 600, preset="ultrafast").vocab


@query("x07_unigram_roundtrip", rf"""
SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN {_SP_NORM} = '' THEN 0 ELSE length({_SP_NORM}) + 1 END) AS BIGINT) AS n_chars,
       CAST(0 AS BIGINT) AS n_unknown FROM documents GROUP BY lang""")
def x07(spark, sf):
    """Documents encoded by best paths; the pieces hold every character of the normalised text."""
    d = table(spark, sf, "documents")
    e = ug.encode(d.select("doc_id", "lang", "text"), ug.train_unigram(d, 600), ["doc_id", "lang"])
    # a character outside the alphabet is its byte symbols: the first byte of each counts it
    first = F.transform("pieces", lambda p: F.when(p.rlike("^<0x[0-9A-F]{2}>$"), (~p.rlike("^<0x[89AB]")).cast("int"))
                        .otherwise(F.length(p)))
    return e.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.aggregate(first, F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint").alias("n_chars"),
        F.sum(F.size(F.filter("input_ids", lambda i: i == 3))).cast("bigint").alias("n_unknown"))


@query("t05_sentences", """
WITH s AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       CAST(sum((strlen(line) > 16384)::INT) AS BIGINT) AS n_long_lines,
       CAST(coalesce(sum(CASE WHEN strlen(line) > 16384 THEN length(line) END), 0) AS BIGINT) AS n_long_chars FROM s""")
def t05_sentences(spark, sf):
    """T05's input: every line, and what lies in lines over the limit."""
    return bpe.sentence_report(table(spark, sf, "documents"))


@query("t05_sp_bpe_merges")
def t05(spark, sf):
    """SentencePiece-style BPE (coverage 0.9995, byte fallback), 400 entries."""
    return bpe.train_sp_bpe(table(spark, sf, "documents"), 400).merges


E11_SQL = f"""
WITH RECURSIVE ids AS (SELECT [1] || {duck_byte_ids('text')} || [2] AS x FROM documents),
c AS (SELECT prev, tok, count(*) AS n FROM (
        SELECT unnest(x[1:len(x) - 1]) AS prev, unnest(x[2:len(x)]) AS tok FROM ids) GROUP BY prev, tok),
nxt AS (SELECT prev, tok FROM c QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, tok) = 1),
p AS (SELECT conv_id, turn, {duck_byte_ids('text')} AS b FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, coalesce(b[len(b)], 2) AS cur, 0 AS step FROM p
      UNION ALL
      SELECT g.conv_id, g.turn, nxt.tok, g.step + 1 FROM g JOIN nxt ON nxt.prev = g.cur
      WHERE g.step < 16 AND (g.step = 0 OR g.cur <> 2))
SELECT conv_id, turn, CAST(count(*) - 1 AS INTEGER) AS n_generated,
       CAST(coalesce(sum(CASE WHEN step > 0 THEN cur END), 0) AS BIGINT) AS gen_sum FROM g GROUP BY conv_id, turn"""


@query("e11_greedy_generation", E11_SQL)
def e11(spark, sf):
    """E11 + D05: each user turn continued greedily, up to 16 tokens, by the
    bigram model counted over the documents."""
    counts = ev.ngram_counts(table(spark, sf, "documents").select(add_specials(byte_ids("text")).alias("input_ids")))
    prompts = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        "conv_id", "turn", byte_ids("text").alias("input_ids"))
    g = generate_greedy(prompts, counts, 16)
    return g.select("conv_id", "turn", F.size("generated").alias("n_generated"),
                    F.aggregate("generated", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("gen_sum"))


# ------------------------------------------------- D06: table functions called from SQL

D06_LINES_SQL = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, p[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) AS r(i)
"""

D06_CHUNKS_SQL = """
SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, substr(text, CAST(i AS BIGINT) * 500 + 1, 500) AS chunk
FROM documents, unnest(range(0, (length(text) + 499) // 500)) AS r(i)
"""

D06_WINDOWS_SQL = """
SELECT doc_id, CAST(greatest(i + 256 - 1024, 0) AS BIGINT) AS start, CAST(least(i + 256, n) AS BIGINT) AS stop,
       CAST(least(i + 256, n) - i AS BIGINT) AS n_target
FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), unnest(range(0, n, 256)) AS r(i)
"""


def _called(spark, sf_dir, columns, call):
    register_table_functions(spark)
    return spark.sql(f"SELECT d.doc_id, {columns} FROM {{docs}} d, LATERAL {call} f", docs=table(spark, sf_dir, "documents"))


@query("d06_sql_text_lines", D06_LINES_SQL)
def d06_sql_text_lines(spark, sf_dir):
    return _called(spark, sf_dir, "f.line_no, f.line", "text_lines(d.text)")


@query("d06_sql_text_chunks", D06_CHUNKS_SQL)
def d06_sql_text_chunks(spark, sf_dir):
    return _called(spark, sf_dir, "f.chunk_no, f.chunk", "text_chunks(d.text, 500)")


@query("d06_sql_score_windows", D06_WINDOWS_SQL)
def d06_sql_score_windows(spark, sf_dir):
    return _called(spark, sf_dir, "f.start, f.stop, f.n_target", "score_windows(octet_length(d.text), 1024, 256)")
