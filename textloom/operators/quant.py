"""Group-wise vector quantisation (Q01-Q07) as array expressions.

A vector of ``d`` values is cut into ``d / group_size`` groups; each group
gets a scale (and zero point when asymmetric).  Rounding is ``rint``
(half-to-even, like ``torch.round``).  Everything stays row-local: no
shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _groups(x: Column, group_size: int, dims: int) -> Column:
    if dims % group_size:
        raise ValueError(f"dimension {dims} is not divisible by group size {group_size}")
    return F.transform(F.sequence(F.lit(0), F.lit(dims // group_size - 1)),
                       lambda g: F.slice(x, g * group_size + 1, group_size))


def quantize(vec="embedding", dims: int = 64, group_size: int = 128, bits: int = 4,
             symmetric: bool = True) -> Column:
    """Q01/Q02: ``struct(q ARRAY<INT>, scale ARRAY<DOUBLE>, zero ARRAY<DOUBLE>)``."""
    x = _c(vec).cast("array<double>")
    if symmetric:
        qmin, qmax = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    else:
        qmin, qmax = 0, 2 ** bits - 1

    def per_group(g):
        if symmetric:
            scale = F.greatest(F.array_max(F.transform(g, lambda v: F.abs(v))) / F.lit(float(qmax)), F.lit(1e-5))
            zero = F.lit(0.0)
        else:
            mn, mx = F.array_min(g), F.array_max(g)
            scale = F.greatest((mx - mn) / F.lit(float(qmax - qmin)), F.lit(1e-5))
            zero = F.lit(float(qmin)) - mn / scale
        q = F.transform(g, lambda v: F.least(F.greatest(F.rint(v / scale + zero), F.lit(float(qmin))),
                                             F.lit(float(qmax))).cast("int"))
        return F.struct(q.alias("q"), scale.alias("scale"), zero.alias("zero"))

    gs = F.transform(_groups(x, group_size, dims), per_group)
    return F.struct(F.flatten(F.transform(gs, lambda s: s["q"])).alias("q"),
                    F.transform(gs, lambda s: s["scale"]).alias("scale"),
                    F.transform(gs, lambda s: s["zero"]).alias("zero"))


def dequantize(q: Column, scale: Column, zero: Column, group_size: int) -> Column:
    """Q04: ``(q - zero) * scale`` with the group's parameters."""
    return F.transform(q, lambda v, i: (v - F.element_at(zero, F.floor(i / group_size).cast("int") + 1))
                       * F.element_at(scale, F.floor(i / group_size).cast("int") + 1))


def pack_int4(q: Column) -> Column:
    """Q03: two 4-bit values per byte, low nibble first (values 0..255)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(q) / 2).cast("int") - 1),
                       lambda i: F.element_at(q, i * 2 + 1).bitwiseAND(F.lit(15))
                       .bitwiseOR(F.shiftleft(F.element_at(q, i * 2 + 2).bitwiseAND(F.lit(15)), 4)))


def unpack_int4(packed: Column, signed: bool = True) -> Column:
    """Q03 inverse; ``signed`` sign-extends each nibble (-8..7)."""
    def nib(v):
        return F.when(F.lit(signed) & (v >= 8), v - 16).otherwise(v)
    pairs = F.transform(packed, lambda b: F.array(nib(b.bitwiseAND(F.lit(15))),
                                                  nib(F.shiftright(b, 4).bitwiseAND(F.lit(15)))))
    return F.flatten(pairs)


def fake_quantize(vec="embedding", bits: int = 4) -> Column:
    """Q05: one scale per tensor (``max|x| / (2^(b-1)-1)``), round, rescale;
    an all-zero vector stays zero."""
    x = _c(vec).cast("array<double>")
    scale = F.array_max(F.transform(x, lambda v: F.abs(v))) / F.lit(float(2 ** (bits - 1) - 1))
    return F.transform(x, lambda v: F.coalesce(F.rint(F.try_divide(v, scale)) * scale, F.lit(0.0)))


def mse(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda u, v: (u - v) * (u - v))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(d)


def quantization_error(df: DataFrame, vec="embedding", bits: int = 4) -> DataFrame:
    """Q06: mean over units (rows) of the per-unit MSE of fake quantisation."""
    x = _c(vec).cast("array<double>")
    return df.agg(F.round(F.avg(mse(fake_quantize(vec, bits), x)), 9).alias("quant_loss"),
                  F.count(F.lit(1)).alias("n_units"))


def size_report(df: DataFrame, dims: int, group_size: int, symmetric: bool = True) -> DataFrame:
    """Q07: bytes before (fp32) and after (packed int4 + fp16 scale
    [+ fp16 zero point] per group), ratio, share of values quantised."""
    groups = dims // group_size
    per_vec_after = dims // 2 + groups * (2 if symmetric else 4)
    n = F.count(F.lit(1))
    return df.agg((n * dims * 4).cast("bigint").alias("bytes_before"),
                  (n * per_vec_after).cast("bigint").alias("bytes_after"),
                  F.round(F.lit(dims * 4 / per_vec_after), 6).alias("ratio"),
                  F.lit(1.0).alias("quantized_share"))
