"""Query registry: every operator that the driver checks, with its DuckDB oracle.

``QUERIES[name] = (callable(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Each query reads the given tables (or data Spark derives from them) in
full; nothing is sampled, capped or filtered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# DuckDB spellings shared by the oracle SQL --------------------------------
# The characters Python's str.strip() removes, as an RE2 class.
DUCK_SPACE = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{DUCK_SPACE}+|{DUCK_SPACE}+$', '', 'g')"


def duck_nonblank(x: str) -> str:
    return f"nullif({duck_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '')"


def duck_byte_ids(x: str, offset: int = 7) -> str:
    return (f"list_transform(regexp_extract_all(hex(encode({x})), '..'), "
            f"lambda b: ('0x' || b)::INTEGER + {offset})")


def load_all() -> dict:
    """Import every module that registers queries, then return the registry."""
    from . import (queries_bpe, queries_chat, queries_core, queries_eval,  # noqa: F401
                   queries_io, queries_more, queries_text, queries_tokens)
    return QUERIES
