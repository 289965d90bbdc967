"""Registered queries: losses, perplexity, n-gram scoring, quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import add_specials, byte_ids
from ..operators import evaluate as ev
from ..operators import losses as ls
from ..operators import quant as qt
from ..operators.stats import windowed_mean
from ..sources.tables import table
from .registry import duck_byte_ids, query

BYTE_VOCAB = 263          # 7 specials + 256 bytes
MAXLEN, STRIDE = 256, 64  # evaluation windows over conversation turns


def _logits(spark, sf):
    """``embeddings`` read as (logits, label): 64 classes, labels 0-9."""
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits"), "label")


# ------------------------------------------------------------ losses -------
_Z = """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
y AS (SELECT vec_id, label, z, list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) AS lse FROM x),
l AS (SELECT vec_id, label, z, lse, lse - z[label + 1] AS ce,
             (z[label + 1] - lse) AS lp_true, list_sum(z) - len(z) * lse AS lp_sum, len(z) AS V FROM y)
"""
_FOCAL = "pow(1 - exp(-ce), 2.0) * ce"
_SMOOTH = "-((1 - 0.1) * lp_true + (0.1 / (V - 1)) * (lp_sum - lp_true))"


@query("e06_cross_entropy_mean",
       _Z + "SELECT round(sum(ce) / greatest(count(*), 1), 6) AS loss, count(*) AS n_valid FROM l WHERE label <> -100")
def e06(spark, sf):
    d = _logits(spark, sf)
    return ls.reduce_loss(d, ls.cross_entropy(), reduction="mean")


@query("e06_cross_entropy_per_row", _Z + "SELECT vec_id, round(ce, 6) AS loss FROM l WHERE label <> -100")
def e06_rows(spark, sf):
    d = _logits(spark, sf)
    return ls.reduce_loss(d, ls.cross_entropy(), reduction="none").select(
        "vec_id", F.round("loss", 6).alias("loss"))


@query("e07_chunked_cross_entropy_by_label",
       _Z + "SELECT label, round(sum(ce) / greatest(count(*), 1), 6) AS loss, count(*) AS n_valid FROM l "
            "WHERE label <> -100 GROUP BY label")
def e07(spark, sf):
    """Σloss / max(Σvalid, 1) per group; partial sums per task are the chunks."""
    d = _logits(spark, sf)
    return ls.reduce_loss(d, ls.cross_entropy(), reduction="mean", by=["label"])


@query("e08_focal_loss_mean",
       _Z + f"SELECT round(sum({_FOCAL}) / greatest(count(*), 1), 6) AS loss, count(*) AS n_valid FROM l WHERE label <> -100")
def e08(spark, sf):
    return ls.reduce_loss(_logits(spark, sf), ls.focal(gamma=2.0), reduction="mean")


@query("e09_label_smoothing_mean",
       _Z + f"SELECT round(sum({_SMOOTH}) / greatest(count(*), 1), 6) AS loss, count(*) AS n_valid FROM l WHERE label <> -100")
def e09(spark, sf):
    return ls.reduce_loss(_logits(spark, sf), ls.label_smoothing(smoothing=0.1), reduction="mean")


@query("e10_multi_objective_mean",
       _Z + f"SELECT round(sum(0.7 * ce + 0.2 * {_FOCAL} + 0.1 * {_SMOOTH}) / greatest(count(*), 1), 6) AS loss, "
            "count(*) AS n_valid FROM l WHERE label <> -100")
def e10(spark, sf):
    return ls.reduce_loss(_logits(spark, sf), ls.loss_column({"type": "multi_objective"}), reduction="mean")


def _some_ignored(spark, sf):
    """Labels under 3 become the ignore index."""
    return _logits(spark, sf).withColumn("label", F.when(F.col("label") < 3, -100).otherwise(F.col("label")))


@query("e06_ignored_per_row", _Z + "SELECT vec_id, CASE WHEN label < 3 THEN 0.0 ELSE round(ce, 6) END AS loss FROM l")
def e06_ignored(spark, sf):
    """E06 ``none``: a value for every row, 0 where the label is ignored."""
    d = ls.reduce_loss(_some_ignored(spark, sf), ls.loss_column({"type": "cross_entropy", "params": {}}), reduction="none")
    return d.select("vec_id", F.round("loss", 6).alias("loss"))


@query("e07_ignored_by_label", _Z + """, m AS (SELECT CASE WHEN label < 3 THEN -100 ELSE label END AS label, ce FROM l)
SELECT label, CASE WHEN label = -100 THEN 0.0 ELSE round(sum(ce) / count(*), 6) END AS loss,
       CAST(sum((label <> -100)::INT) AS BIGINT) AS n_valid FROM m GROUP BY label""")
def e07_ignored(spark, sf):
    """A group without a valid row has loss 0."""
    return ls.reduce_loss(_some_ignored(spark, sf), ls.cross_entropy(), reduction="mean", by=["label"])


@query("e08_ignored_focal_config", _Z + f"""
SELECT round(sum(CASE WHEN label >= 3 THEN pow(1 - exp(-ce), 1.5) * ce * 0.25 END) / sum((label >= 3)::INT), 6) AS loss,
       CAST(sum((label >= 3)::INT) AS BIGINT) AS n_valid FROM l""")
def e08_ignored(spark, sf):
    """D04 with a ``params`` object, over partly ignored labels."""
    loss = ls.loss_column({"type": "focal", "params": {"gamma": 1.5, "alpha": 0.25}})
    return ls.reduce_loss(_some_ignored(spark, sf), loss, reduction="mean")


@query("e04_batch_mean_perplexity",
       _Z + "SELECT round(avg(bl), 6) AS eval_loss, round(exp(avg(bl)), 6) AS perplexity FROM "
            "(SELECT vec_id // 8 AS b, avg(ce) AS bl FROM l GROUP BY b)")
def e04(spark, sf):
    """Per-row CE, batches of 8 rows, mean of batch means -> exp."""
    d = _logits(spark, sf).withColumn("loss", ls.cross_entropy()).withColumn(
        "batch_id", F.floor(F.col("vec_id") / 8))
    return ev.batch_mean_perplexity(d)


@query("a12_windowed_mean_loss",
       _Z + "SELECT CAST((vec_id + 1 - 1) // 10 AS BIGINT) AS window, round(avg(ce), 6) AS mean_loss, count(*) AS n_steps, "
            "CAST(max(vec_id + 1) AS BIGINT) AS last_step FROM l GROUP BY 1")
def a12(spark, sf):
    """A per-step loss log (step = vec_id + 1, loss = CE) averaged per 10 steps."""
    log = _logits(spark, sf).select((F.col("vec_id") + 1).alias("step"), ls.cross_entropy().alias("loss"))
    return windowed_mean(log, "step", "loss", 10)


# -------------------------------------------------------- n-gram / ppl -----
_BIGRAMS = f"""m AS (
  SELECT prev, tok, count(*) AS cnt FROM (
    SELECT unnest(ids[1:len(ids) - 1]) AS prev, unnest(ids[2:len(ids)]) AS tok
    FROM (SELECT [1] || {duck_byte_ids('text')} || [2] AS ids FROM documents))
  GROUP BY prev, tok)"""
E03_SQL = f"WITH {_BIGRAMS} SELECT prev, tok, cnt FROM m"


def _doc_ids(spark, sf):
    return table(spark, sf, "documents").select(add_specials(byte_ids("text")).alias("input_ids"))


def _turn_ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", add_specials(byte_ids("text")).alias("input_ids"))


@query("e03_bigram_counts", E03_SQL)
def e03(spark, sf):
    """Bigram counts over the byte-tokenised documents (the scorer's model)."""
    return ev.ngram_counts(_doc_ids(spark, sf))


_TOKEN_NLL = f"""WITH {_BIGRAMS},
ctx AS (SELECT prev, sum(cnt) AS c FROM m GROUP BY prev),
lp AS (SELECT m.prev, m.tok, -ln((m.cnt + 1.0) / (ctx.c + {BYTE_VOCAB}.0)) AS nll FROM m JOIN ctx USING (prev)),
e AS (SELECT conv_id, turn, [1] || {duck_byte_ids('text')} || [2] AS ids FROM conversations),
t AS (SELECT conv_id, turn, len(ids) AS n, unnest(range(1, len(ids))) AS pos,
             unnest(ids[1:len(ids) - 1]) AS prev, unnest(ids[2:len(ids)]) AS tok FROM e),
tn AS (SELECT t.conv_id, t.turn, t.n, t.pos,
              coalesce(lp.nll, -ln(1.0 / (ctx.c + {BYTE_VOCAB}.0)), ln({BYTE_VOCAB}.0)) AS nll
       FROM t LEFT JOIN lp ON t.prev = lp.prev AND t.tok = lp.tok LEFT JOIN ctx ON t.prev = ctx.prev)
"""


def _windows(spark, sf, mode):
    scorer = ev.bigram_scorer(ev.ngram_counts(_doc_ids(spark, sf)), BYTE_VOCAB, 1.0)
    return ev.score_windows(_turn_ids(spark, sf), scorer, ["conv_id", "turn"], MAXLEN, STRIDE, mode)


E02R_SQL = _TOKEN_NLL + f""",
w AS (SELECT conv_id, turn, n, nll,
             unnest(generate_series(greatest(floor((pos - {MAXLEN}) / {STRIDE}) + 1, 0)::BIGINT,
                                    least(floor((pos - 1) / {STRIDE}), greatest(ceil((n - {MAXLEN}) / {STRIDE}), 0))::BIGINT)) AS q
      FROM tn),
wl AS (SELECT conv_id, turn, q, avg(nll) AS loss, least(q * {STRIDE} + {MAXLEN}, n) - q * {STRIDE} AS trg_len
       FROM w GROUP BY conv_id, turn, q, n)
SELECT round(exp(sum(loss * trg_len) / sum(trg_len)), 6) AS perplexity, count(*) AS n_windows FROM wl
"""


@query("e02_perplexity_reference", E02R_SQL)
def e02r(spark, sf):
    """E01+E03+E02: bigram model from documents scores conversation turns in
    windows of 256 with stride 64, overlaps counted again (reference mode)."""
    return ev.perplexity(_windows(spark, sf, "reference"), ["conv_id", "turn"], "reference")


E02S_SQL = _TOKEN_NLL + f""",
wl AS (SELECT conv_id, turn, n, (pos // {STRIDE}) * {STRIDE} AS b, avg(nll) AS loss,
              least((pos // {STRIDE}) * {STRIDE} + {STRIDE}, n) - (pos // {STRIDE}) * {STRIDE} AS trg_len
       FROM tn GROUP BY conv_id, turn, n, b),
ps AS (SELECT conv_id, turn, n, sum(loss * trg_len) AS nll, count(*) AS nw FROM wl GROUP BY conv_id, turn, n)
SELECT round(exp(sum(nll) / sum(n)), 6) AS perplexity, CAST(sum(nw) AS BIGINT) AS n_windows FROM ps
"""


@query("e02_perplexity_standard", E02S_SQL)
def e02s(spark, sf):
    """E02 standard mode: each token scored once; divide by the token count."""
    return ev.perplexity(_windows(spark, sf, "standard"), ["conv_id", "turn"], "standard")


@query("e05_per_text_perplexity",
       _TOKEN_NLL + "SELECT conv_id, turn, round(exp(avg(nll)), 6) AS perplexity FROM tn GROUP BY conv_id, turn")
def e05(spark, sf):
    scorer = ev.bigram_scorer(ev.ngram_counts(_doc_ids(spark, sf)), BYTE_VOCAB, 1.0)
    return ev.per_text_perplexity(_turn_ids(spark, sf), scorer, ["conv_id", "turn"])


E01_SQL = f"""
SELECT conv_id, turn, CAST(b AS BIGINT) AS begin, CAST(least(b + {MAXLEN}, n) AS BIGINT) AS "end" FROM (
  SELECT conv_id, turn, n, unnest(generate_series(0, greatest(n - 1, 0), {STRIDE})) AS b
  FROM (SELECT conv_id, turn, strlen(text) + 2 AS n FROM conversations))
WHERE b = 0 OR b - {STRIDE} + {MAXLEN} < n
"""


@query("e01_stride_windows", E01_SQL)
def e01(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", (F.octet_length("text") + 2).alias("n"))
    w = t.select("conv_id", "turn", F.explode(ev.stride_windows("n", MAXLEN, STRIDE)).alias("w"))
    return w.select("conv_id", "turn", F.col("w.begin").cast("bigint").alias("begin"),
                    F.col("w.end").cast("bigint").alias("end"))


# ------------------------------------------------------- quantisation ------
GS = 32


def _quant_sql(symmetric: bool) -> str:
    if symmetric:
        scale = f"greatest(list_max(list_transform(xs, lambda v: abs(v))) / 7.0, 1e-5)"
        zero = "0.0"
        lo, hi = -8, 7
    else:
        scale = "greatest((list_max(xs) - list_min(xs)) / 15.0, 1e-5)"
        zero = "(0.0 - list_min(xs) / scale)"
        lo, hi = 0, 15
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, unnest(range(0, len(e) // {GS})) AS gi FROM e),
s AS (SELECT vec_id, gi, list_slice(e, gi * {GS} + 1, gi * {GS} + {GS}) AS xs FROM g),
s2 AS (SELECT vec_id, gi, xs, {scale} AS scale FROM s),
s3 AS (SELECT vec_id, gi, xs, scale, {zero} AS zero FROM s2),
q AS (SELECT vec_id, gi, xs, scale, zero,
             list_transform(xs, lambda v: least(greatest(round_even(v / scale + zero, 0), {lo}), {hi})) AS q FROM s3)
SELECT vec_id, CAST(sum(list_sum(q)) AS BIGINT) AS q_sum,
       CAST(sum(list_sum(list_transform(q, lambda v: abs(v)))) AS BIGINT) AS q_abs_sum,
       round(sum(scale), 6) AS scale_sum,
       round(sum(list_sum(list_transform(q, lambda v, i: pow((v - zero) * scale - xs[i], 2)))) / 64, 9) AS mse
FROM q GROUP BY vec_id
"""


def _quant_query(spark, sf, symmetric: bool):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    r = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"),
                 qt.quantize("embedding", 64, GS, 4, symmetric).alias("qz"))
    deq = qt.dequantize(F.col("qz.q"), F.col("qz.scale"), F.col("qz.zero"), GS)
    return r.select(
        "vec_id",
        F.aggregate("qz.q", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("q_sum"),
        F.aggregate("qz.q", F.lit(0).cast("bigint"), lambda a, v: a + F.abs(v)).alias("q_abs_sum"),
        F.round(F.aggregate("qz.scale", F.lit(0.0), lambda a, v: a + v), 6).alias("scale_sum"),
        F.round(qt.mse(deq, F.col("x")), 9).alias("mse"))


@query("q01_symmetric_int4", _quant_sql(True))
def q01(spark, sf):
    """Q01+Q04: symmetric int4, groups of 32, dequantised error per vector."""
    return _quant_query(spark, sf, True)


@query("q02_asymmetric_int4", _quant_sql(False))
def q02(spark, sf):
    """Q02+Q04: asymmetric int4 with zero points, groups of 32."""
    return _quant_query(spark, sf, False)


Q03_SQL = _quant_sql(True).split("SELECT vec_id, CAST(sum(list_sum(q))")[0] + """,
qq AS (SELECT vec_id, flatten(list(q ORDER BY gi)) AS q FROM q GROUP BY vec_id)
SELECT vec_id, CAST(list_sum(list_transform(range(0, len(q) // 2),
         lambda i: (q[2 * i + 1]::INTEGER & 15) | ((q[2 * i + 2]::INTEGER & 15) << 4))) AS BIGINT) AS packed_sum,
       CAST(len(q) // 2 AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS mismatches
FROM qq
"""


@query("q03_pack_int4_roundtrip", Q03_SQL)
def q03(spark, sf):
    """Q03: pack two nibbles per byte and unpack with sign extension."""
    e = table(spark, sf, "embeddings")
    r = e.select("vec_id", qt.quantize("embedding", 64, GS, 4, True)["q"].alias("q"))
    r = r.withColumn("packed", qt.pack_int4(F.col("q"))).withColumn("back", qt.unpack_int4(F.col("packed")))
    return r.select(
        "vec_id",
        F.aggregate("packed", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("packed_sum"),
        F.size("packed").cast("bigint").alias("n_bytes"),
        F.aggregate(F.zip_with("q", "back", lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"),
                    lambda a, v: a + v).alias("mismatches"))


Q06_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) / 7.0 AS scale FROM e)
SELECT round(avg(list_sum(list_transform(x, lambda v: pow(round_even(v / scale, 0) * scale - v, 2))) / len(x)), 9) AS quant_loss,
       count(*) AS n_units FROM s
"""


@query("q06_fake_quant_error", Q06_SQL)
def q06(spark, sf):
    """Q05+Q06: per-tensor fake quantisation, mean of per-unit MSE."""
    return qt.quantization_error(table(spark, sf, "embeddings"), "embedding", 4)


@query("q06_fake_quant_zero_vectors", """
WITH e AS (SELECT CAST(CASE WHEN label = 0 THEN list_transform(embedding, lambda v: 0) ELSE embedding END AS DOUBLE[]) AS x
           FROM embeddings),
s AS (SELECT x, list_max(list_transform(x, lambda v: abs(v))) / 7.0 AS scale FROM e)
SELECT round(avg(CASE WHEN scale = 0 THEN 0 ELSE
         list_sum(list_transform(x, lambda v: pow(round_even(v / scale, 0) * scale - v, 2))) / len(x) END), 9) AS quant_loss,
       count(*) AS n_units FROM s""")
def q06_zero(spark, sf):
    """Q05+Q06: all-zero vectors (label 0 here) stay zero and cost nothing."""
    e = table(spark, sf, "embeddings").withColumn("embedding", F.when(
        F.col("label") == 0, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding")))
    return qt.quantization_error(e, "embedding", 4)


@query("q07_size_report",
       f"SELECT CAST(count(*) * 64 * 4 AS BIGINT) AS bytes_before, CAST(count(*) * (32 + 2 * 2) AS BIGINT) AS bytes_after, "
       f"round(256.0 / 36, 6) AS ratio, 1.0 AS quantized_share FROM embeddings")
def q07(spark, sf):
    return qt.size_report(table(spark, sf, "embeddings"), 64, GS, True)
