"""User batch functions and pluggable scorers.

``map_batches`` runs a user function over Arrow batches (``mapInPandas``):
the user's object (e.g. a model) is created once per task by a factory,
never shipped per row.  The default generator is a greedy bigram
decoder whose table (one best next token per context, at most V rows) is
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import EOS_ID


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                factory: Callable[[], object] | None = None) -> DataFrame:
    """``fn(batch)`` or ``fn(batch, obj)`` with ``obj = factory()``
    built once per task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        obj = factory() if factory is not None else None
        for b in it:
            yield fn(b, obj) if factory is not None else fn(b)

    return df.mapInPandas(run, schema)


def best_next(counts: DataFrame) -> DataFrame:
    """Greedy decoding table: the most frequent next token per context."""
    from pyspark.sql import Window
    w = Window.partitionBy("prev").orderBy(F.col("cnt").desc(), F.col("tok"))
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select("prev", "tok")


def generate_greedy(prompts: DataFrame, counts: DataFrame, max_new_tokens: int = 16,
                    ids: str = "input_ids", eos_id: int = EOS_ID) -> DataFrame:
    """Continue each prompt greedily with a bigram table; stops at EOS.
    Output adds ``generated`` (new ids only)."""
    nxt = {r["prev"]: r["tok"] for r in best_next(counts).collect()}   # ≤ vocabulary size rows
    cols = prompts.columns

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seq in b[ids]:
            cur = int(seq[-1]) if len(seq) else eos_id
            gen = []
            for _ in range(max_new_tokens):
                cur = nxt.get(cur)
                if cur is None:
                    break
                gen.append(int(cur))
                if cur == eos_id:
                    break
            out.append(gen)
        b = b.copy()
        b["generated"] = out
        return b

    schema = prompts.schema.simpleString()[7:-1] + ", generated array<int>"
    return map_batches(prompts.select(*cols), fn, schema)
