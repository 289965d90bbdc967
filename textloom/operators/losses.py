"""Losses over ``(logits ARRAY<FLOAT>, label INT)`` rows.

Per-row values are native higher-order expressions (log-sum-exp with the
max subtracted, so large logits do not overflow); reductions are plain
``sum``/``count`` aggregates, i.e. Spark's partial+final aggregation is the
"chunked" two-phase mean.  A row whose label is the ignore index
has loss 0 and counts in no mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE_INDEX


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def logsumexp(logits) -> Column:
    x = _c(logits).cast("array<double>")
    m = F.array_max(x)
    return m + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, v: a + v))


def cross_entropy(logits="logits", label="label") -> Column:
    """E06 per row: ``logsumexp(z) - z[label]``; 0 for an ignored label."""
    z = _c(logits).cast("array<double>")
    return _unless_ignored(label, logsumexp(z) - F.get(z, _c(label)))


def focal(logits="logits", label="label", gamma: float = 2.0, alpha: float | None = None) -> Column:
    """E08 per row: ``(1 - p_t)^gamma * ce`` (times ``alpha`` when given)."""
    ce = cross_entropy(logits, label)
    out = F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    return out * F.lit(alpha) if alpha is not None else out


def _unless_ignored(label, value: Column) -> Column:
    return F.when(_c(label) == IGNORE_INDEX, F.lit(0.0)).otherwise(value)


def label_smoothing(logits="logits", label="label", smoothing: float = 0.1) -> Column:
    """E09 per row: true class weight ``1-s``, others ``s/(V-1)``."""
    z = _c(logits).cast("array<double>")
    lse = logsumexp(z)
    V = F.size(z)
    lp_true = F.get(z, _c(label)) - lse
    lp_sum = F.aggregate(z, F.lit(0.0), lambda a, v: a + v) - V * lse
    return _unless_ignored(label, -((1 - smoothing) * lp_true + (F.lit(smoothing) / (V - 1)) * (lp_sum - lp_true)))


def multi_objective(logits="logits", label="label", ce_weight: float = 0.7, focal_weight: float = 0.2,
                    smooth_weight: float = 0.1, focal_gamma: float = 2.0, smoothing: float = 0.1) -> Column:
    """E10 per row: weighted sum; the weights must total 1 (±1e-6)."""
    total = ce_weight + focal_weight + smooth_weight
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"the three weights add up to {total}, not to one")
    parts = []
    if ce_weight:
        parts.append(F.lit(ce_weight) * cross_entropy(logits, label))
    if focal_weight:
        parts.append(F.lit(focal_weight) * focal(logits, label, focal_gamma))
    if smooth_weight:
        parts.append(F.lit(smooth_weight) * label_smoothing(logits, label, smoothing))
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


LOSSES = {
    "cross_entropy": cross_entropy, "ce": cross_entropy,
    "focal": focal, "label_smoothing": label_smoothing, "multi_objective": multi_objective,
}


def loss_column(config: dict, logits="logits", label="label") -> Column:
    """Loss factory ``{"type": name, "params": {...}}`` (parameters may also
    stand beside the type); an unknown name is an error."""
    cfg = dict(config)
    name = cfg.pop("type", "cross_entropy")
    params = {**(cfg.pop("params", None) or {}), **cfg}
    if name not in LOSSES:
        raise ValueError(f"no loss is called {name!r}; there are {', '.join(sorted(LOSSES))}")
    return LOSSES[name](logits, label, **params)


def reduce_loss(df: DataFrame, per_row: Column, label="label", reduction: str = "mean",
                ignore_index: int = IGNORE_INDEX, by: list[str] | None = None) -> DataFrame:
    """mean = Σloss / max(Σvalid, 1) over rows whose label is
    not ``ignore_index`` (0 when none is valid); ``sum``; or ``none``: a value
    for each row, 0 where ignored."""
    valid = _c(label) != ignore_index
    if reduction == "none":
        return df.withColumn("loss", F.when(valid, per_row).otherwise(F.lit(0.0)))
    agg, n = F.coalesce(F.sum(F.when(valid, per_row)), F.lit(0.0)), F.count(F.when(valid, F.lit(1)))
    if reduction == "mean":
        agg = agg / F.greatest(n, F.lit(1))
    elif reduction != "sum":
        raise ValueError(f"unknown reduction {reduction!r}")
    g = df.groupBy(*by) if by else df
    return g.agg(F.round(agg, 6).alias("loss"), n.alias("n_valid"))
