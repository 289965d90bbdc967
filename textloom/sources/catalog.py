"""Source specs and the language -> corpus-config table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language code -> encyclopedia corpus config.
LANGUAGE_CONFIGS = {
    "ko": "20231101.ko", "en": "20231101.en", "ja": "20231101.ja", "zh": "20231101.zh",
    "de": "20231101.de", "fr": "20231101.fr", "es": "20231101.es", "ru": "20231101.ru",
    "pt": "20231101.pt", "it": "20231101.it", "vi": "20231101.vi", "th": "20231101.th",
    "ar": "20231101.ar",
}


def language_configs(spark: SparkSession) -> DataFrame:
    """The fixed 13-row dimension table (safe to broadcast)."""
    return spark.createDataFrame(list(LANGUAGE_CONFIGS.items()), "lang string, config string")


def select_languages(spark: SparkSession, languages: list[str]) -> DataFrame:
    """Keep known codes; none valid -> error."""
    cfg = language_configs(spark).filter(F.col("lang").isin(list(languages)))
    if not set(languages) & set(LANGUAGE_CONFIGS):
        raise ValueError(f"no supported language in {languages}")
    return cfg


def parse_specs(specs: DataFrame, spec: str = "spec", explicit_config: str | None = None) -> DataFrame:
    """``name[:config]`` split on the first ':'; an explicit config
    overrides the spec's own, for the first source (idx 0) only."""
    s = F.col(spec)
    has = F.instr(s, ":") > 0
    name = F.when(has, F.substring_index(s, ":", 1)).otherwise(s)
    cfg = F.when(has, F.expr(f"substring({spec}, instr({spec}, ':') + 1)"))
    if explicit_config is not None:
        cfg = F.when(F.col("idx") == 0, F.lit(explicit_config)).otherwise(cfg)
    kind = F.when(s.rlike(r"\.(json|jsonl|txt|parquet)$") | s.startswith("/") | s.startswith("./"),
                  F.lit("file")).otherwise(F.lit("hf"))
    return specs.select("idx", kind.alias("kind"), name.alias("name"), cfg.alias("config"))


def spec_column(col: str) -> Column:
    return F.col(col)
