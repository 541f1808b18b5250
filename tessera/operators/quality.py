"""Retrieval metrics and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(metrics: DataFrame, as_of: Column, days: int = 7, *, low: float = 2.0) -> DataFrame:
    """One row over the last days of a metrics table (query, strategy, bm25_candidates, final_count, elapsed_ms, top_score, sources_count, ts)."""
    m = metrics.where(F.col("ts") >= F.date_sub(as_of.cast("date"), days))
    silent = ((F.col("bm25_candidates") > 0) & (F.col("final_count") < 2)) | ((F.col("top_score") > 0) & (F.col("top_score") < 1.0))
    rate = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    return m.agg(F.count("*").alias("total"), F.avg("elapsed_ms").alias("avg_ms"), F.avg("final_count").alias("avg_results"), rate(F.col("final_count") == 0).alias("zero_rate"), rate(F.col("top_score") < low).alias("low_rate"), F.avg("sources_count").alias("diversity"), F.count_if(silent).alias("silent"))


def strategies(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(F.coalesce("strategy", F.lit("unknown")).alias("strategy")).agg(F.count("*").alias("n"))


def slow(metrics: DataFrame, over_ms: float = 2000.0, top: int = 10) -> DataFrame:
    return metrics.where(F.col("elapsed_ms") > over_ms).orderBy(F.desc("elapsed_ms"), "metric_id").limit(top)


def zero_results(metrics: DataFrame, top: int = 10) -> DataFrame:
    return metrics.where("final_count = 0").orderBy(F.desc("ts"), "metric_id").limit(top)


def per_query(results: DataFrame) -> DataFrame:
    """The metric of each query's (query_id, score, source) results."""
    return results.groupBy("query_id").agg(F.count("*").alias("final_count"), F.max("score").alias("top_score"), F.avg("score").alias("avg_score"), (F.max("score") - F.min("score")).alias("score_spread"), F.countDistinct("source").alias("sources_count"))


def record(results: DataFrame, path: str, mode: str = "append") -> None:
    results.write.mode(mode).parquet(path)


def rubric(answers: DataFrame) -> DataFrame:
    """0-4 points an answer (n_passages, answer) and the total per cent."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    points = F.when(F.col("n_passages") >= 1, 1).otherwise(0) + F.when(F.col("n_passages") >= 3, 1).otherwise(0) + F.when((low != "") & ~low.contains("error"), 1).otherwise(0) + F.when((low != "") & ~low.contains("i don't have"), 1).otherwise(0)
    return answers.agg(F.sum(points).alias("points"), (100.0 * F.sum(points) / (4 * F.count("*"))).alias("per_cent"))


def latency(metrics: DataFrame, by: str, time: str = "elapsed_ms") -> DataFrame:
    """n, min_ms, avg_ms, max_ms of each group."""
    return metrics.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"), F.min(time).alias("min_ms"), F.avg(time).alias("avg_ms"), F.max(time).alias("max_ms"))
