"""E06-E10 against numpy; Q01-Q07 properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import losses as ls
from textloom.operators import quant as qt


def _np_ce(z, y):
    m = z.max(axis=1, keepdims=True)
    lse = (m + np.log(np.exp(z - m).sum(axis=1, keepdims=True)))[:, 0]
    return lse - z[np.arange(len(y)), y], lse


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(32, 100)) * 3
    z[0, :] += 1000.0  # very large logits must not overflow
    y = rng.integers(0, 100, size=32)
    y_ign = y.copy()
    y_ign[:4] = -100
    df = spark.createDataFrame([(i, [float(v) for v in z[i]], int(y_ign[i])) for i in range(32)],
                               "i int, logits array<double>, label int")
    keep = y_ign != -100
    ce, lse = _np_ce(z[keep], y_ign[keep])
    got = ls.reduce_loss(df, ls.cross_entropy(), reduction="mean").first()
    assert got.loss == pytest.approx(ce.mean(), abs=1e-5) and got.n_valid == 28
    p = np.exp(-ce)
    foc = ((1 - p) ** 2 * ce).mean()
    assert ls.reduce_loss(df, ls.focal(gamma=2.0), reduction="mean").first().loss == pytest.approx(foc, abs=1e-5)
    V, s = 100, 0.1
    lp = z[keep] - lse[:, None]
    true = np.full_like(lp, s / (V - 1))
    true[np.arange(keep.sum()), y_ign[keep]] = 1 - s
    sm = (-(true * lp).sum(axis=1)).mean()
    assert ls.reduce_loss(df, ls.label_smoothing(smoothing=s), reduction="mean").first().loss == pytest.approx(sm, abs=1e-5)
    mo = 0.7 * ce.mean() + 0.2 * foc + 0.1 * sm
    assert ls.reduce_loss(df, ls.multi_objective(), reduction="mean").first().loss == pytest.approx(mo, abs=1e-5)
    assert ls.reduce_loss(df, ls.cross_entropy(), reduction="sum").first().loss == pytest.approx(ce.sum(), abs=1e-4)
    with pytest.raises(ValueError):
        ls.multi_objective(ce_weight=0.5, focal_weight=0.2, smooth_weight=0.1)
    with pytest.raises(ValueError):
        ls.loss_column({"type": "nope"})


def test_all_ignored_gives_zero_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0], -100)], "logits array<double>, label int")
    r = ls.reduce_loss(df, ls.cross_entropy(), reduction="mean").collect()
    assert [(x.loss, x.n_valid) for x in r] == [(0.0, 0)]
    rows = df.select(ls.cross_entropy().alias("a"), ls.focal().alias("b"), ls.label_smoothing().alias("c")).first()
    assert tuple(rows) == (0.0, 0.0, 0.0)
    assert [x.loss for x in ls.reduce_loss(df, ls.cross_entropy(), reduction="none").collect()] == [0.0]
    assert ls.reduce_loss(df, ls.cross_entropy(), reduction="sum").first().loss == 0.0


def test_zero_vectors_stay_zero(spark):
    df = spark.createDataFrame([([0.0] * 4,), ([0.0, 7.0, -3.4, 1.0],)], "embedding array<double>")
    assert [list(r[0]) for r in df.select(qt.fake_quantize()).collect()] == [[0.0] * 4, [0.0, 7.0, -3.0, 1.0]]
    assert qt.quantization_error(df.limit(1)).first().quant_loss == 0.0


def _np_quant(x, gs, sym):
    g = x.reshape(-1, gs)
    if sym:
        scale = np.maximum(np.abs(g).max(axis=1) / 7, 1e-5)
        zero = np.zeros_like(scale)
        q = np.clip(np.rint(g / scale[:, None]), -8, 7)
    else:
        scale = np.maximum((g.max(axis=1) - g.min(axis=1)) / 15, 1e-5)
        zero = -g.min(axis=1) / scale
        q = np.clip(np.rint(g / scale[:, None] + zero[:, None]), 0, 15)
    return q.reshape(-1), scale, zero


def test_quantize_matches_numpy_and_roundtrips(spark):
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=64), np.zeros(64), np.full(64, -3.0)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "i int, v array<double>")
    for sym in (True, False):
        rows = df.select("i", qt.quantize("v", 64, 32, 4, sym).alias("z")).orderBy("i").collect()
        for r, x in zip(rows, xs):
            q, scale, zero = _np_quant(x, 32, sym)
            assert list(r.z.q) == [int(v) for v in q]
            assert np.allclose(r.z.scale, scale) and np.allclose(r.z.zero, zero)
            deq = (np.array(r.z.q).reshape(-1, 32) - np.array(r.z.zero)[:, None]) * np.array(r.z.scale)[:, None]
            assert np.all(np.abs(deq.reshape(-1) - x) <= np.repeat(r.z.scale, 32) / 2 + 1e-9) or not sym
    r = df.select(qt.quantize("v", 64, 32, 4, True)["q"].alias("q")).withColumn(
        "back", qt.unpack_int4(qt.pack_int4(F.col("q")))).collect()
    assert all(list(x.q) == list(x.back) for x in r)
    with pytest.raises(ValueError):
        qt.quantize("v", 64, 48)
