"""Weighted evidence: signals by subject -> score, evidence list, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"build file": 5, "source tree": 0, "application config": 3, "dockerfile": 4, "docker-compose services": 2, "kubernetes deployment": 3, "helm chart": 3, "SpringBootApplication": 5, "controller annotation": 2, "RequestMapping": 0}
THRESHOLD = 7


def score(signals: DataFrame, subject: list[str], signal: str = "signal", detail: str = "detail", weight: str = "weight") -> DataFrame:
    """(subject, score, evidence) from rows (subject, signal, detail, weight): a signal counts once, with its smallest detail.

    Two partial aggregations; no window, so a subject with very many rows costs no task more than another.
    """
    once = signals.groupBy(*subject, signal).agg(F.max(weight).alias("__w"), F.min(detail).alias("__d"))
    text = F.when(F.col("__d").isNull() | (F.col("__d") == ""), F.col(signal)).otherwise(F.concat(F.col(signal), F.lit(": "), F.col("__d")))
    return once.groupBy(*subject).agg(F.sum("__w").cast("int").alias("score"), F.array_sort(F.collect_list(text)).alias("evidence"))


def accepted(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold)
