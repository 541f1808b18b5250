"""Score fusion, near-equal result removal and final ranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, recency_weight


def merged_score(a: Column, b: Column, weights: tuple[float, float] = (0.6, 0.4), both: float = 1.3) -> Column:
    total = weights[0] * F.coalesce(a, F.lit(0.0)) + weights[1] * F.coalesce(b, F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), both * total).otherwise(total)


def merge(lexical: DataFrame, vector: DataFrame, key: str, *, weights: tuple[float, float] = (0.6, 0.4), both: float = 1.3) -> DataFrame:
    """query_id, key, score: weighted scores of (query_id, key, score) results, more if both found a row."""
    a, b = lexical.select("query_id", key, F.col("score").alias("a")), vector.select("query_id", key, F.col("score").alias("b"))
    return a.join(b, ["query_id", key], "full_outer").select("query_id", key, merged_score(F.col("a"), F.col("b"), weights, both).alias("score"))


def first_of_variants(results: DataFrame, key: str) -> DataFrame:
    """Of (query_id, variant, rank, key) the first occurrence of each key, in order of variant and rank."""
    w = Window.partitionBy("query_id", key).orderBy("variant", "rank")
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def signature_words(text: Column, chars: int = 200) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.left(text, F.lit(chars))), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similar_pairs(results: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """query_id, first, second, similarity among (query_id, rank, text) results: a result list is bounded by its top_k."""
    a = results.select("query_id", F.col("rank").alias("first"), signature_words(F.col("text")).alias("wa"))
    b = results.select("query_id", F.col("rank").alias("second"), signature_words(F.col("text")).alias("wb"))
    return a.join(b, "query_id").where("first < second").select("query_id", "first", "second", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") > threshold)


def drop_similar(results: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Results in rank order without those too similar to one kept before: greedy within each query's bounded list, so a fold over its array, which carries the rows along."""
    rest = [c for c in results.columns if c not in ("query_id", "rank")]
    rows = results.select("query_id", F.struct(F.col("rank").cast("int").alias("rank"), signature_words(F.col("text")).alias("w"), F.struct(*rest).alias("rest")).alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list("r"), lambda x, y: x["rank"] - y["rank"]).alias("rs"))
    keep = F.aggregate("rs", F.array().cast("array<struct<rank:int,w:array<string>>>"), lambda kept, r: F.when(F.exists(kept, lambda k: jaccard(k["w"], r["w"]) > threshold), kept).otherwise(F.concat(kept, F.array(F.struct(r["rank"].alias("rank"), r["w"].alias("w"))))))
    kept = let(F.transform(keep, lambda k: k["rank"]), lambda ranks: F.filter("rs", lambda r: F.array_contains(ranks, r["rank"])))
    return rows.select("query_id", F.explode(kept).alias("r")).select("query_id", "r.rank", "r.rest.*")


def rerank(results: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, *, top_k: Column | int = 10, where: Column | None = None) -> DataFrame:
    """Adds `rerank` and orders by it. scorer takes batches of (query, text); without one the overlap of their words stands in. Only queries with `where` are reranked and cut at top_k."""
    if scorer is None:
        r = jaccard(signature_words(F.col("query")), signature_words(F.col("text"), 2000))
    else:
        r = F.pandas_udf(scorer, "double")(F.col("query"), F.col("text"))
    out = results.withColumn("rerank", r if where is None else F.when(where, r))
    w = Window.partitionBy("query_id").orderBy(F.round("rerank", 9).desc(), F.round("score", 9).desc(), "rank")
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where((F.col("rank") <= top_k) if where is None else (~where | (F.col("rank") <= top_k)))


def final_scores(results: DataFrame, as_of: Column, *, created: str = "created_at", decay: float = 365.0) -> DataFrame:
    """score becomes 0.5 rerank + 0.3 score + recency where reranked, else score + 0.8 recency."""
    recency = recency_weight(F.col(created), as_of, decay)
    plain = F.col("score") + 0.8 * recency
    new = F.when(F.col("rerank") > 0, 0.5 * F.col("rerank") + 0.3 * F.col("score") + recency).otherwise(plain) if "rerank" in results.columns else plain
    return results.withColumn("score", new)
