"""Filters and predicates (F01-F10), all pushed-down-able native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nonempty(col="text") -> Column:
    """``len(text) > 0`` (no strip: whitespace-only text survives)."""
    return F.length(_c(col)) > 0


def nonblank(col="line") -> Column:
    """drop lines that are blank after stripping."""
    return py_strip(_c(col)) != ""


def min_stripped_length(col="text", k: int = 50) -> Column:
    """stripped length strictly greater than ``k``."""
    return F.length(py_strip(_c(col))) > k


def min_chunk(col="input_ids", k: int = 128) -> Column:
    """keep token chunks of at least ``k`` tokens."""
    return F.size(_c(col)) >= k


def nonempty_ids(col="input_ids") -> Column:
    """drop zero-length token sequences."""
    return F.size(_c(col)) > 0


def convertible(col="text") -> Column:
    """drop records whose conversion gave NULL or ''."""
    c = _c(col)
    return c.isNotNull() & (c != "")


def vocab_seed(col="token") -> Column:
    """vocabulary entries usable as training text (not ``<…>``, length > 1)."""
    c = _c(col)
    return ~c.startswith("<") & (F.length(c) > 1)


def config_mentions(col, needles=("ko", "en")) -> Column:
    """case-insensitive substring match on a config name."""
    low = F.lower(_c(col))
    cond = None
    for n in needles:
        cond = low.contains(n) if cond is None else cond | low.contains(n)
    return cond


def string_columns(df: DataFrame) -> list[str]:
    """names of the string-typed fields of a schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def apply(df: DataFrame, *conds: Column) -> DataFrame:
    for c in conds:
        df = df.filter(c)
    return df
