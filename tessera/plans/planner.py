"""Query planner: type, confidence and retrieval plan of each query, as Column expressions (queries are rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V

OTHERS = [t for t in V.QUERY_PATTERNS if t != "personal"]


def type_scores(query: Column) -> dict[str, Column]:
    low = F.lower(query)
    return {t: 0.3 * sum((F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0)) for t, patterns in V.QUERY_PATTERNS.items()}


def classify(queries: DataFrame, query: str = "query") -> DataFrame:
    """queries with query_type and confidence. Ties go to the earlier type; personal yields to another type of 0.7 of its score."""
    scored = queries.withColumns({f"__{t}": s for t, s in type_scores(F.col(query)).items()})
    other = F.greatest(*[F.col(f"__{t}") for t in OTHERS])
    best = F.greatest(other, F.col("__personal"))
    personal = (F.col("__personal") > other) & ~((other >= F.col("__personal") * 0.7) & (other > 0))
    kind = F.when(best < 0.1, "exploratory").when(personal, "personal")
    for t in OTHERS:
        kind = kind.when(F.col(f"__{t}") == other, t)
    confidence = F.when(best < 0.1, 0.3).when(personal, F.least(F.col("__personal"), F.lit(1.0))).otherwise(F.least(other, F.lit(1.0)))
    return scored.withColumn("query_type", kind).withColumn("confidence", confidence).drop(*[f"__{t}" for t in V.QUERY_PATTERNS])


def plan(queries: DataFrame, query: str = "query", top_k: int = 10) -> DataFrame:
    """classify() and strategy, top_k, use_reranker, use_vectors, recency_boost, expanded_queries."""
    out = classify(queries, query)
    rules = F.create_map(*[x for t, p in V.PLANS.items() for x in (F.lit(t), F.struct(*[F.lit(v).alias(n) for n, v in zip(("s", "k", "r", "v", "b"), p, strict=True)]))])
    rule = F.element_at(rules, F.col("query_type"))
    out = out.withColumns({"strategy": rule["s"], "top_k": (rule["k"] * top_k).cast("long"), "use_reranker": rule["r"], "use_vectors": rule["v"], "recency_boost": rule["b"]})
    return out.withColumn("expanded_queries", F.when(F.col("query_type") == "temporal", temporal_expansions(F.col(query))).otherwise(F.array(query)))


def temporal_expansions(query: Column) -> Column:
    dated = F.lower(query).rlike(r"(\d+)\s+(days?|weeks?|months?)\s+ago")
    return F.array_compact(F.array(query, F.concat(query, F.lit(" recent latest new")), F.when(dated, F.concat(query, F.lit(" activity work discussion")))))
