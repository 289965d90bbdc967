"""Quality classifier with hierarchical empirical Bayes.

A document classifier gives evidence from the whole text: a logistic model
over hashed byte trigrams and a few style measures, fitted on a bounded sample
of labelled rows.  Evidence alone is weak for borderline texts, so hosts and
paths lend theirs: a path's rate of good documents is shrunk towards its
host's, a host's towards the corpus's, and the amounts of shrinking are
estimated from the spread between hosts and between paths (method of moments).
Sparse sites fall back to the prior above them.  A document's own evidence is
taken out of its path's rate before both are combined.

The only collected data are the training sample (``max_training_rows`` rows of
``FEATURES`` numbers) and the corpus's few moments.

Defined cases: null and empty texts have no trigrams and zero measures; null
hosts and paths are sites of their own; repeated rows count as often as they
stand; of several labels for one doc_id the majority counts, and none at a tie;
of several texts under one labelled doc_id the one with the smallest SHA-256 is
the sample; labels for unknown documents and null labels are not used; with
only one class among the labels the classifier's evidence is 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1024
STYLE = 10
FEATURES = BUCKETS + STYLE


def features(text: str | None) -> np.ndarray:
    """Whole text to numbers: square-rooted, length-normalised trigram counts and style measures."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(FEATURES, np.float32)
    n = len(raw)
    if not n:
        return out
    counts = np.zeros(BUCKETS, np.int64)
    for s in range(0, n, 1 << 20):  # bounded memory for very long texts
        p = raw[s:s + (1 << 20) + 2].astype(np.uint32)
        if len(p) >= 3:
            h = ((p[:-2] * np.uint32(65_599) + p[1:-1]) * np.uint32(65_599) + p[2:]) * np.uint32(2_654_435_761)
            counts += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    tri = np.sqrt(counts)
    norm = np.sqrt((tri * tri).sum())
    if norm:
        out[:BUCKETS] = tri / norm
    by = np.bincount(raw, minlength=256)
    letters = by[65:91].sum() + by[97:123].sum() + by[128:].sum()
    spaces = by[32] + by[9:14].sum()
    symbols = sum(int(by[ord(c)]) for c in "#*$%&|<>!")
    words = text.split()
    again = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
    out[BUCKETS:] = (np.log1p(n) / 10, by[65:91].sum() / max(letters, 1), by[48:58].sum() / n * 5, symbols / n * 5,
                     spaces / n * 5, by[10] / n * 20, (by[44] + by[46]) / n * 20, letters / n, again * 5, len(set(words)) / max(len(words), 1))
    return out


class LogisticModel:
    """Weights with the log-odds of the classes among the training rows."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good to bad: the model's log-odds less the prior's."""
        return np.clip(x @ self.weights[:-1] + self.weights[-1] - self.prior, -12, 12)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> LogisticModel:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    good = float(y.mean()) if len(y) else 0.5
    if not 0 < good < 1:
        return LogisticModel(w, 0.0)
    penalty = np.full(len(w), ridge * 1.0)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * len(y) / 100 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty * len(y) / 100 + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return LogisticModel(w, float(np.log(good / (1 - good))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_training_rows: int = 4000) -> LogisticModel:
    """Fit on labelled documents; beyond ``max_training_rows`` those with the smallest hashes of their ids."""
    sample = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("tl_id")).agg(F.avg(F.col(label_col).cast("int")).alias("share"))
              .where("share != 0.5").select("tl_id", (F.col("share") > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("tl_id"), "tl_id").limit(max_training_rows))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("tl_id"))
    # one text for each id (at most max_training_rows), settled in the tasks before the shuffle
    text = F.coalesce("text", F.lit(""))
    own = own.groupBy("doc_id", "y").agg(F.min(F.struct(F.sha2(text, 256).alias("digest"), text.alias("text"))).alias("t"))
    own = own.select("doc_id", "t.text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)],
                                             names=["doc_id", "x", "y"])

    rows = own.mapInArrow(run, "doc_id long, x binary, y int").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), FEATURES)
    return fit_logistic(x, np.array([r["y"] for r in rows], np.float64))


def evidence(docs: DataFrame, model: LogisticModel, columns: list, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, the given key columns (strings) and ``evidence`` of each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *columns)
    names = [c for c in narrow.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column(1)
            for s in range(0, b.num_rows, 512):
                x = np.array([features(t) for t in texts.slice(s, 512).to_pylist()], np.float64)
                out.append(model.evidence(x.reshape(-1, FEATURES)))
            cols = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out) if out else [], pa.float64())],
                                             names=[*names, "evidence"])

    return narrow.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)
                             + ", evidence double")


def _strength(groups: DataFrame, mean, n: str = "n", s: str = "s", s2: str = "s2") -> float:
    """Beta prior's weight in documents, by moments, from groups of two or more.

    The variance of group means beyond what the spread inside groups explains
    is the variance between sites.
    """
    g = groups.where(F.col(n) > 1)
    m = F.col(s) / F.col(n)
    inside = F.greatest(F.col(s2) / F.col(n) - m * m, F.lit(0.0)) / (F.col(n) - 1)
    r = g.agg(F.sum(F.col(n) * (m - mean) ** 2).alias("between"), F.sum(F.col(n) * inside).alias("noise"),
              F.sum(n).alias("n"), F.sum(F.col(n) * mean * (1 - mean)).alias("spread")).first()
    if not r["n"]:
        return 10.0
    between = max((r["between"] - r["noise"]) / r["n"], 1e-6)
    return float(np.clip(r["spread"] / r["n"] / between - 1, 1.0, 1e6))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), label_col: str = "quality",
             max_training_rows: int = 4000, threshold: float = 0.5) -> DataFrame:
    """One row for each input row: doc_id, evidence, host_rate, path_rate, probability, kept."""
    model = train(docs, labels, id_col, text_col, label_col, max_training_rows)
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in path_cols])
    own = evidence(docs, model, [F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000")).alias("host"),
                                 path.alias("path")], id_col, text_col)
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior))))
    own = cut_lineage(own.withColumn("p", p))
    paths = cut_lineage(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"),
                                                        F.sum(F.col("p") * F.col("p")).alias("s2")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = all_["s"] / all_["n"] if all_["n"] else 0.5
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("tl_host"),
                         ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host") == F.col("tl_host")).drop("tl_host")
    k_path = _strength(paths, F.col("host_rate"))
    paths = paths.select(F.col("host").alias("tl_host"), F.col("path").alias("tl_path"), "n", "s", "host_rate")
    out = own.join(paths, (F.col("host") == F.col("tl_host")) & (F.col("path") == F.col("tl_path")))
    rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("path_rate", rate).withColumn(
        "probability", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "probability",
                      (F.col("probability") >= threshold).alias("kept"))
