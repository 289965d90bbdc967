"""Registered queries over a trained byte-level BPE vocabulary.

The DuckDB side trains the same small vocabulary with a recursive query (one
merge a step over the distinct words) and encodes by replaying the merges.
It also rebuilds whole id sequences, which perplexity and truncation need.
That is too slow for a vocabulary of real size, so the queries named _4000 have
no SQL; training is tested against brute force at 300.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BYTE_DST
from ..operators import bpe
from ..operators import evaluate as ev
from ..operators import pack as pk
from ..operators import stats as st
from ..session import cut_lineage
from ..sources.tables import table
from .corpus import chunk_summary, corpus, keep_for_training
from .queries_core import k01_sql
from .queries_text import _NO_WS, _PREFIXED, _WS, A03_SQL
from .registry import duck_strip, query

BASE_VOCAB = 300
N_MERGES = BASE_VOCAB - 263
FULL_VOCAB = 4000

_MAP = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in BYTE_DST) + "]"
# a symbol is wrapped in chr(1) and chr(2), so replacing a pair is one left-to-right pass
_WRAP = (f"list_reduce(list_concat([''], list_transform(regexp_extract_all(hex(encode(word)), '..'), "
         f"lambda b: chr(1) || {_MAP}[('0x' || b)::INTEGER + 1] || chr(2))), lambda a, b: a || b)")
_PAIR = "chr(1) || {l} || chr(2) || chr(1) || {r} || chr(2)"


def merges_sql(words: str, n: int) -> str:
    """A CTE list ending in ``merges(rank, l, r)`` and ``final(word, cnt, s)``."""
    return f"""w AS ({words}),
t AS (
  SELECT 0 AS step, word, cnt, {_WRAP} AS s, ''::VARCHAR AS l, ''::VARCHAR AS r FROM w
  UNION ALL
  SELECT t.step + 1, t.word, t.cnt, replace(t.s, {_PAIR.format(l='b.l', r='b.r')}, chr(1) || b.l || b.r || chr(2)), b.l, b.r
  FROM t, (SELECT l, r FROM (
             SELECT x[i] AS l, x[i + 1] AS r, cnt FROM (
               SELECT x, cnt, unnest(range(1, len(x))) AS i FROM (
                 SELECT regexp_extract_all(s, chr(1) || '([^' || chr(2) || ']+)' || chr(2), 1) AS x, cnt FROM t) WHERE len(x) > 1))
           GROUP BY l, r HAVING sum(cnt) >= 2 ORDER BY sum(cnt) DESC, l, r LIMIT 1) b
  WHERE t.step < {n}),
merges AS (SELECT step - 1 AS rank, any_value(l) AS l, any_value(r) AS r FROM t WHERE step > 0 GROUP BY step),
final AS (SELECT word, cnt, s, len(s) - len(replace(s, chr(1), '')) AS n FROM t
          WHERE step = (SELECT max(step) FROM t))"""


T01_SQL = f"WITH RECURSIVE {merges_sql(A03_SQL, N_MERGES)} SELECT CAST(rank AS INTEGER) AS rank, l, r FROM merges"
# the ids: seven specials, the 256 byte symbols in code point order, then the merged tokens
T01_VOCAB_SQL = f"""
WITH RECURSIVE {merges_sql(A03_SQL, N_MERGES)},
sp AS (SELECT unnest(['<pad>', '<s>', '</s>', '<unk>', '<|endoftext|>', '<|im_start|>', '<|im_end|>']) AS token,
              unnest(range(0, 7)) AS id),
al AS (SELECT token, row_number() OVER (ORDER BY token) + 6 AS id FROM (SELECT unnest({_MAP}) AS token))
SELECT token, CAST(id AS INTEGER) AS id FROM (
  SELECT * FROM sp UNION ALL SELECT * FROM al UNION ALL
  SELECT token, row_number() OVER (ORDER BY rank) + 262 FROM (SELECT l || r AS token, min(rank) AS rank FROM merges GROUP BY 1))
"""

def trained(spark, sf, vocab_size: int = BASE_VOCAB, lang: str | None = None) -> bpe.BpeModel:
    d = table(spark, sf, "documents")
    if lang:
        d = d.filter(F.col("lang") == lang)
    m = bpe.train_bpe(d, vocab_size=vocab_size, name=f"bpe{vocab_size}{'_' + lang if lang else ''}")
    m.vocab, m.merges = cut_lineage(m.vocab), cut_lineage(m.merges)
    return m


def encoded(spark, sf, max_length: int | None = None, keep: bool = False, vocab_size: int = BASE_VOCAB):
    d = table(spark, sf, "documents")
    m = trained(spark, sf, vocab_size)
    return bpe.encode(keep_for_training(d) if keep else d, m, ["doc_id"], max_length=max_length)


@query("t01_bpe_merges", T01_SQL)
def t01_merges(spark, sf):
    """Merges learned from all documents (vocabulary of 300)."""
    return trained(spark, sf).merges


@query("t01_bpe_vocab", T01_VOCAB_SQL)
def t01_vocab(spark, sf):
    return trained(spark, sf).vocab


@query("t01_bpe_merges_4000")
def t01_merges_full(spark, sf):
    """Merges learned from all documents (vocabulary of 4,000)."""
    return trained(spark, sf, FULL_VOCAB).merges


def _sums(e):
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


# A03's words for each document, with their ids summed
_DOC_WORDS = (A03_SQL.replace("WITH t AS (SELECT ", "WITH t AS (SELECT doc_id, ")
              .replace("SELECT unnest(regexp_extract_all(t, ", "SELECT doc_id, unnest(regexp_extract_all(t, ")
              .replace("SELECT word FROM (", "SELECT doc_id, word FROM (")
              .replace("SELECT CASE WHEN regexp_matches(run", "SELECT doc_id, CASE WHEN regexp_matches(run")
              .replace("SELECT word, count(*) AS cnt FROM w GROUP BY word", "SELECT doc_id, word, count(*) AS k FROM w GROUP BY ALL"))
_ENCODED = f"""{merges_sql(A03_SQL, N_MERGES)},
v AS (SELECT token, id FROM ({T01_VOCAB_SQL})),
wi AS (SELECT word, count(*) AS n, sum(v.id) AS s FROM (
         SELECT word, unnest(regexp_extract_all(s, chr(1) || '([^' || chr(2) || ']+)' || chr(2), 1)) AS token FROM final)
       JOIN v USING (token) GROUP BY word),
dw AS (SELECT doc_id, sum(k * n) AS n, sum(k * s) AS s FROM ({_DOC_WORDS}) JOIN wi USING (word) GROUP BY doc_id)"""
X06_SQL = f"""WITH RECURSIVE {_ENCODED}
SELECT doc_id, CAST(coalesce(dw.n, 0) + 2 AS BIGINT) AS n_tokens, CAST(coalesce(dw.s, 0) + 3 AS BIGINT) AS id_sum
FROM documents LEFT JOIN dw USING (doc_id)"""
A08_SQL = f"""WITH RECURSIVE {_ENCODED}
SELECT lang, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(coalesce(dw.n, 0)) AS BIGINT) AS total_tokens,
       CASE WHEN sum(dw.n) > 0 THEN round(sum(length(text)) / sum(dw.n), 6) ELSE 0.0 END AS chars_per_token
FROM documents LEFT JOIN dw USING (doc_id) GROUP BY ROLLUP (lang)"""

# whole sequences: a text's words in order (between chr(3) and chr(4); white space that no word takes stays outside, its
# last character alone where the next word doesn't begin with a space), then their ids
SEQUENCES = f"""{merges_sql(A03_SQL, N_MERGES)},
v AS (SELECT token, id FROM ({T01_VOCAB_SQL})),
wi AS (SELECT word, list(v.id ORDER BY i) AS ids FROM (
         SELECT word, unnest(x) AS token, unnest(range(0, len(x))) AS i FROM (
           SELECT word, regexp_extract_all(s, chr(1) || '([^' || chr(2) || ']+)' || chr(2), 1) AS x FROM final))
       JOIN v USING (token) GROUP BY word),
mk AS (SELECT doc_id, regexp_replace(regexp_replace({_PREFIXED}, '({_NO_WS})', chr(3) || '\\1' || chr(4), 'g'),
                                     '([{_WS}])' || chr(3) || '([^ ])', chr(3) || '\\1' || chr(4) || chr(3) || '\\2', 'g') AS m
       FROM documents),
dw AS (SELECT doc_id, unnest(x) AS word, unnest(range(0, len(x))) AS i FROM (
         SELECT doc_id, list_transform(regexp_extract_all(m, chr(3) || '[^' || chr(4) || ']*' || chr(4) || '|[{_WS}]+'),
                                       lambda q: replace(replace(q, chr(3), ''), chr(4), '')) AS x FROM mk)),
body AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS b FROM dw JOIN wi USING (word) GROUP BY doc_id),
enc AS (SELECT doc_id, source, text, coalesce(b, []) AS b FROM documents LEFT JOIN body USING (doc_id))"""
_KEPT = f"text IS NOT NULL AND length(text) > 0 AND length({duck_strip('text')}) > 50"
K06_BPE_SQL = f"""WITH RECURSIVE {SEQUENCES}
SELECT doc_id, CAST(len(b[1:510]) + 2 AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(b[1:510]), 0) + 3 AS BIGINT) AS id_sum
FROM enc WHERE {_KEPT}"""


@query("x06_bpe_encode", X06_SQL)
def x06(spark, sf):
    """X06 + J01 + X08: every document encoded."""
    return _sums(encoded(spark, sf))


@query("k06_bpe_truncate", K06_BPE_SQL)
def k06_bpe(spark, sf):
    """X01 -> X03 -> X06 -> X08/X09: training documents encoded with the
    trained vocabulary, cut to 512 tokens with the template."""
    return _sums(encoded(spark, sf, max_length=512, keep=True))


@query("x06_bpe_encode_4000")
def x06_full(spark, sf):
    return _sums(encoded(spark, sf, vocab_size=FULL_VOCAB))


@query("k06_bpe_truncate_4000")
def k06_bpe_full(spark, sf):
    return _sums(encoded(spark, sf, max_length=512, keep=True, vocab_size=FULL_VOCAB))


@query("x16_roundtrip", "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_mismatch FROM documents")
def x16(spark, sf):
    """X15 + X16 + J02: decode(encode(text)) against NFKC(text) with the prefix space."""
    return bpe.roundtrip_mismatches(table(spark, sf, "documents"), trained(spark, sf), ["doc_id"])


@query("j06_special_tokens",
       "SELECT token, CAST(id AS INTEGER) AS expected_id, CAST(id AS INTEGER) AS id, true AS present, true AS id_matches FROM ("
       "SELECT unnest(['<pad>', '<s>', '</s>', '<unk>', '<|endoftext|>', '<|im_start|>', '<|im_end|>']) AS token, "
       "unnest(range(0, 7)) AS id)")
def j06(spark, sf):
    return bpe.special_token_report(trained(spark, sf).vocab)


@query("a08_fertility_bpe", A08_SQL)
def a08_bpe(spark, sf):
    """A08 with the trained vocabulary: chars per BPE token, per language and overall."""
    return _fertility(spark, sf, BASE_VOCAB)


@query("a08_fertility_bpe_4000")
def a08_bpe_full(spark, sf):
    return _fertility(spark, sf, FULL_VOCAB)


def _fertility(spark, sf, vocab_size: int):
    d = table(spark, sf, "documents").join(encoded(spark, sf, vocab_size=vocab_size), "doc_id")
    return st.fertility(d, "text", F.size("input_ids") - 2, by="lang")


@query("t02_extend_vocabulary")
def t02(spark, sf):
    """T02 + J03-J05 + W04 + U03 + U05: an English-only base vocabulary of
    300 extended to 500 with the whole corpus; base ids are kept."""
    base = trained(spark, sf, BASE_VOCAB, "en")
    ext = bpe.extend_vocabulary(base, table(spark, sf, "documents"), 500)
    kept = ext.vocab.join(base.vocab.withColumnRenamed("id", "base_id"), "token", "left")
    return kept.select("token", "id", (F.col("base_id").isNotNull()).alias("from_base"),
                       F.coalesce(F.col("base_id") == F.col("id"), F.lit(True)).alias("id_kept"))


@query("a13_tokenizer_comparison",
       f"SELECT name, 'BPE' AS type, CAST({BASE_VOCAB} AS BIGINT) AS vocab_size, CAST({N_MERGES} AS BIGINT) AS n_merges "
       f"FROM (VALUES ('bpe{BASE_VOCAB}'), ('bpe{BASE_VOCAB}_en')) t(name)")
def a13(spark, sf):
    """Vocabulary size, merge count and model type per tokenizer, by name."""
    rows = []
    for m in (trained(spark, sf), trained(spark, sf, BASE_VOCAB, "en")):
        both = m.vocab.select(F.lit(1).alias("v")).union(m.merges.select(F.lit(0).alias("v")))
        rows.append(both.agg(F.sum("v").cast("bigint").alias("vocab_size"), F.sum(1 - F.col("v")).cast("bigint").alias("n_merges"))
                    .select(F.lit(m.name).alias("name"), F.lit("BPE").alias("type"), "vocab_size", "n_merges"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("name")


_K04_CHUNKS = k01_sql(500_000).replace("2048", "512").split("), o AS (", 1)[1]
K04_SQL = f"""WITH RECURSIVE {SEQUENCES},
d AS (SELECT source AS src, doc_id AS row_idx, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 500000 AS segment,
             [1] || b || [2] AS ids FROM enc WHERE {_KEPT}), o AS ({_K04_CHUNKS}"""


@query("k04_bpe_chunks", K04_SQL)
def k04(spark, sf):
    """BPE-encoded training documents concatenated per source and cut
    into 512-token chunks (short tails dropped)."""
    return _chunks(spark, sf, BASE_VOCAB)


@query("k04_bpe_chunks_4000")
def k04_full(spark, sf):
    return _chunks(spark, sf, FULL_VOCAB)


def _chunks(spark, sf, vocab_size: int):
    docs = keep_for_training(corpus(spark, sf)).select("src", "row_idx")
    e = encoded(spark, sf, vocab_size=vocab_size).withColumnRenamed("doc_id", "row_idx").join(docs, "row_idx")
    return chunk_summary(pk.concat_and_chunk(e, 512))


# ------------------------------------------------ perplexity over BPE ids ----

_LOSS = f"""WITH RECURSIVE {SEQUENCES},
e AS (SELECT doc_id, [1] || b || [2] AS ids FROM enc),
pos AS (SELECT doc_id, len(ids) AS n, unnest(range(1, len(ids))) AS pos,
             unnest(ids[1:len(ids) - 1]) AS prev, unnest(ids[2:len(ids)]) AS tok FROM e),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
m AS (SELECT prev, tok, count(*) AS cnt FROM pos JOIN good USING (doc_id) GROUP BY prev, tok),
ctx AS (SELECT prev, sum(cnt) AS c FROM m GROUP BY prev),
tn AS (SELECT doc_id, n, pos, CASE WHEN ctx.c IS NULL THEN ln({BASE_VOCAB}.0)
                                   ELSE -ln((coalesce(m.cnt, 0) + 1.0) / (ctx.c + {BASE_VOCAB}.0)) END AS nll
       FROM pos LEFT JOIN m USING (prev, tok) LEFT JOIN ctx ON pos.prev = ctx.prev)
"""
PPL_LENGTH, PPL_STRIDE = 512, 128


def _good_model(spark, sf):
    """BPE ids of all documents, and a bigram model of those that a label calls good."""
    ids = cut_lineage(encoded(spark, sf))
    good = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1")
    return ids, ev.bigram_model(ev.ngram_counts(ids.join(good, "doc_id", "left_semi")), BASE_VOCAB)


@query("e05_bpe_perplexity", _LOSS + "SELECT doc_id, round(exp(avg(nll)), 6) AS perplexity FROM tn GROUP BY doc_id")
def e05_bpe(spark, sf):
    """E03 + E05 over BPE ids: a bigram model of the documents labelled good, held as
    tables, scores every document whole."""
    ids, model = _good_model(spark, sf)
    return ev.per_text_perplexity(ids, model, ["doc_id"])


@query("e02_bpe_perplexity", _LOSS + f""",
ww AS (SELECT doc_id, n, nll,
             unnest(generate_series(greatest(floor((pos - {PPL_LENGTH}) / {PPL_STRIDE}) + 1, 0)::BIGINT,
                                    least(floor((pos - 1) / {PPL_STRIDE}), greatest(ceil((n - {PPL_LENGTH}) / {PPL_STRIDE}), 0))::BIGINT)) AS q
      FROM tn),
wl AS (SELECT doc_id, q, avg(nll) AS loss, least(q * {PPL_STRIDE} + {PPL_LENGTH}, n) - q * {PPL_STRIDE} AS trg_len
       FROM ww GROUP BY doc_id, q, n)
SELECT round(exp(sum(loss * trg_len) / sum(trg_len)), 6) AS perplexity, count(*) AS n_windows FROM wl""")
def e02_bpe(spark, sf):
    """E01 + E02 + E03 over BPE ids: the same model over windows of 512 with stride 128."""
    ids, model = _good_model(spark, sf)
    return ev.perplexity(ev.score_windows(ids, model, ["doc_id"], PPL_LENGTH, PPL_STRIDE), ["doc_id"])
