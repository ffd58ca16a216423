"""The grid of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, years: tuple[str, ...] = ("2023", "2024"), runs: int = 5) -> DataFrame:
    """year, type, shot, prompt, split, run: SAR has shots only, LLM shots and prompts, the others prompts at shot 0; prompt 1 also runs split."""
    lists = {"year": list(years), "type": ["SAR", "LLM", "All", "None", "human", "automatic"], "shot": [0, 1, 3, 5], "prompt": [0, 1, 2], "split": [False, True]}
    out = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()], F.sequence(F.lit(1), F.lit(runs)).alias("run"))
    for name in (*lists, "run"):
        out = out.withColumn(name, F.explode(name))
    sar, llm = F.col("type") == "SAR", F.col("type") == "LLM"
    shots = sar | llm | (F.col("shot") == 0)
    return out.filter(shots & (sar == (F.col("prompt") == 0)) & (~F.col("split") | (F.col("prompt") == 1)))
