"""Hybrid retrieval: variants, lexical and vector candidates, fusion, near-equal removal, reranking, recency.

Queries are a batch of questions of checked size, so their terms are literals in the plan: each text is scored where it is read,
and only (query, id, score) is shuffled. Each query follows its own plan where the planner's columns are there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, lexical, vector

#: Candidates a variant, as a multiple of top_k.
CANDIDATES = {"bm25_only": 3, "hybrid": 3, "vector_only": 3, "long_context": 5}
LEXICAL, VECTOR = ("bm25_only", "hybrid", "long_context"), ("hybrid", "vector_only")
MAX_QUERIES = 1000


def variants(queries: DataFrame) -> DataFrame:
    """query_id, variant, query: each query as it is and, if that adds terms, expanded."""
    terms = T.retrieval_tokens(T.ascii_lower(F.col("query")))
    wide = lexical.expand_retrieval_query(terms)
    each = F.array_compact(F.array(F.col("query"), F.when(F.size(wide) > F.size(terms), F.array_join(wide, " "))))
    return queries.select("query_id", F.posexplode(each).alias("variant", "query"))


def held(queries: DataFrame) -> DataFrame:
    """The queries as rows that the driver holds; more than MAX_QUERIES at once are an error."""
    rows = queries.limit(MAX_QUERIES + 1).toArrow()
    if rows.num_rows > MAX_QUERIES:
        raise ValueError(f"ask {MAX_QUERIES} queries at once at most")
    return queries.sparkSession.createDataFrame(rows)  # from Arrow, so that what follows from it is worked out without a job


def largest(queries: DataFrame, value: Column | str) -> int:
    return max((r[0] for r in queries.select(value).collect()), default=0)


def search(docs: DataFrame, queries: DataFrame, *, top_k: int = 10, candidates: int = 50, most: int = 10, use_reranker: bool = False, reranker=None, key: str = "doc_id") -> DataFrame:
    """query_id, rank, key, score: the quick search. The best `candidates` by BM25 are scored by how often they hold the query's terms, near-equal ones go, the rest are ranked.

    With use_reranker, the reranker's score takes the place of that: only those above 0 stay, rounded to 4 places, and near-equal ones go after reranking."""
    found = lexical.bm25(docs, queries, key=key, top_k=candidates).select("query_id", key, F.col("rank").cast("int").alias("rank"))
    terms = T.index_tokens(F.col("query"))
    own = queries.select("query_id", "query", F.when(F.size(terms) > 0, terms).otherwise(F.slice(F.split(F.lower("query"), r"\s+"), 1, 10)).alias("terms"))
    rows = docs.select(key, "text").join(found, key).join(F.broadcast(own), "query_id")  # as many queries as BM25 broadcasts
    rows = rows.withColumn("score", F.round(lexical.keyword_score(F.lower("text"), F.col("terms")), 3)).withColumn("text", F.left("text", F.lit(500))).drop("terms")
    limit = min(top_k, most)
    if use_reranker:
        scored = fusion.rerank(rows, reranker, top_k=candidates).where("rerank > 0").withColumn("score", F.round("rerank", 4))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
        kept = fusion.drop_similar(scored.drop("rerank").withColumn("rank", F.row_number().over(w)))
        w = Window.partitionBy("query_id").orderBy("rank")
    else:
        kept = fusion.drop_similar(rows)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", key, "score")


def lexical_candidates(docs: DataFrame, queries: DataFrame, top: Column | int, key: str = "doc_id") -> DataFrame:
    """Rows that hold a query term, by overlap score: query_id, rank, key, score; `top` (of query columns) for each variant."""
    asked = variants(queries).select("query_id", "variant", T.retrieval_tokens(T.ascii_lower(F.col("query"))).alias("terms")).where(F.size("terms") > 0).collect()
    words = sorted({t for r in asked for t in r.terms})
    place = {t: i for i, t in enumerate(words)}
    rows = [{"query_id": r.query_id, "variant": r.variant, "at": [place[t] for t in r.terms]} for r in asked]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    table = literal(rows, "array<struct<query_id long, variant int, at array<int>>>")
    # each different term is counted once a text; a variant's score sums what its terms have
    counts = lambda x: F.transform(literal(words, "array<string>"), lambda t: F.when(F.contains(x, t), T.occurrences(x, t)).otherwise(0))
    score = lambda n, at: lexical.overlap_of_counts(F.transform(at, lambda i: F.get(n, i)))
    scores = lambda n: F.filter(F.transform(table, lambda a: F.struct(a["query_id"].alias("query_id"), a["variant"].alias("variant"), score(n, a["at"]).alias("score"))), lambda s: s["score"] > 0)
    found = T.let(T.ascii_lower(F.col("text")), lambda x: F.when(F.length(x) >= 20, T.let(counts(x), lambda n: F.when(F.exists(n, lambda c: c > 0), scores(n)))))
    scored = docs.select(key, F.explode_outer(found).alias("s")).select(key, "s.*").where("score is not null")  # an inner explode would score once more, to filter empty arrays first
    limits = queries.select("query_id", (F.lit(top) if isinstance(top, int) else top).alias("top"))
    w = Window.partitionBy("query_id", "variant").orderBy(F.round("score", 9).desc(), key)
    most = largest(limits, "top")
    scored = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)  # a literal, so that tasks keep no more
    scored = scored.join(limits, "query_id").where(F.col("rank") <= F.col("top"))
    return fusion.first_of_variants(scored, key).select("query_id", "rank", key, "score")


def hybrid_retrieve(docs: DataFrame, queries: DataFrame, as_of: Column, *, embeddings: DataFrame | None = None, strategy: str = "hybrid", fast_mode: bool = False, top_k: int = 10, reranker=None, use_reranker: bool = False, faithful: bool = False, key: str = "doc_id") -> DataFrame:
    """query_id, rank, key, score. docs: key, text, created_at; queries: query_id, query (and embedding, where vectors are used).

    Where queries have the planner's strategy, top_k, use_reranker and use_vectors, these hold for each query instead of the
    arguments. fast_mode takes hybrid and long_context as bm25_only. A query is reranked if it has more than top_k results and isn't
    bm25_only. faithful=True leaves single-stage results unscored before recency, as the original system does."""
    plan = {"strategy": F.lit(strategy), "top_k": F.lit(top_k).cast("long"), "use_reranker": F.lit(use_reranker), "use_vectors": F.lit(True)}
    queries = held(queries.withColumns({c: v for c, v in plan.items() if c not in queries.columns}))
    if fast_mode:
        queries = queries.withColumn("strategy", F.when(F.col("strategy").isin("hybrid", "long_context"), "bm25_only").otherwise(F.col("strategy")))
    times = F.element_at(F.create_map(*[F.lit(x) for kv in CANDIDATES.items() for x in kv]), F.col("strategy"))
    found = lexical_candidates(docs, queries.where(F.col("strategy").isin(*LEXICAL)), F.col("top_k") * times, key).select("query_id", key, F.col("score").alias("a"))
    with_vectors = queries.where(F.col("strategy").isin(*VECTOR) & F.col("use_vectors"))
    if embeddings is not None:
        most = largest(with_vectors, "top_k")
        near = vector.nearest(embeddings, with_vectors, key=key, top_k=3 * most).join(with_vectors.select("query_id", "top_k"), "query_id").where(F.col("rank") <= 3 * F.col("top_k"))
        found = found.join(near.select("query_id", key, F.col("score").alias("b")), ["query_id", key], "full_outer")
    else:
        found = found.withColumn("b", F.lit(None).cast("double"))
    one = lambda weight: F.lit(0.0) if faithful else F.lit(weight)
    found = found.withColumns({"lexical": F.count("a").over(Window.partitionBy("query_id")) > 0, "near": F.count("b").over(Window.partitionBy("query_id")) > 0})  # a query's own candidates
    both = fusion.merged_score(F.col("a"), F.col("b"))
    score = F.when(F.col("lexical") & F.col("near"), both).when(F.col("near"), one(0.4) * F.col("b")).otherwise(one(0.6) * F.col("a"))
    found = found.select("query_id", key, score.alias("score"))
    # late materialisation: texts are fetched for candidates only, a bounded number a query
    rows = docs.select(key, "text", "created_at").join(F.broadcast(found), key).join(queries.select("query_id", "query", "strategy", "top_k", "use_reranker"), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    rows = fusion.drop_similar(rows.withColumn("rank", F.row_number().over(w)))
    wants = F.col("use_reranker") & (F.col("strategy") != "bm25_only") & (F.count("*").over(Window.partitionBy("query_id")) > F.col("top_k"))
    rows = fusion.rerank(rows.withColumn("wants", wants), reranker, top_k=2 * F.col("top_k"), where=F.col("wants"))
    rows = fusion.final_scores(rows, as_of)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("top_k")).select("query_id", "rank", key, "score")
