"""Exact top-k by exhaustive term-at-a-time accumulation.

Each dimension is a term and each vector's integer weight at it a posting. For a block of candidates, one
dense score array per query is filled term by term: the queries that have the term scatter their weight
times the term's postings into their arrays. The k best of each array are selected by partition, merged
over the blocks of a task, and the tasks' lists are merged by a window over at most k rows a query and task.

Queries are handed out in blocks of a fixed number of rows, so what is broadcast is bounded however many
queries there are; every block meets all candidates, and no score is skipped.

Cases: vectors that are null or empty of an id, or hold a null or non-finite component, take no part; shorter vectors
count as zero beyond their end; ties go to the smaller id; repeated candidate rows count separately; a
query id that is repeated asks once (its first usable vector in order of components); an empty table gives no rows; a score that a long can't hold
counts in full in the ranking of a task and is given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

BLOCK = 2048
QUERIES_AT_ONCE = 64


def integer_weights(lists: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the usable vectors, one column each, and which rows these are."""
    values, offsets = lists.values, lists.offsets.to_numpy()
    ok = ~np.asarray(lists.is_null()) if lists.null_count else np.ones(len(lists), bool)
    x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    ok &= bad[offsets[1:]] == bad[offsets[:-1]]
    rows = np.flatnonzero(ok)
    sizes = (offsets[1:] - offsets[:-1])[rows]
    dim = int(sizes.max(initial=0))
    fits = not len(rows) or np.abs(x[np.isfinite(x)]).max(initial=0) < 2.0**28
    out = np.zeros((dim, len(rows)), np.int64 if fits else object)
    if len(rows) and (sizes == dim).all() and len(rows) == len(lists):
        out[:] = x[offsets[0] : offsets[-1]].reshape(len(rows), dim).T.astype(np.int64) if fits else np.vectorize(int, otypes=[object])(x[offsets[0] : offsets[-1]].reshape(len(rows), dim).T)
    else:
        for j, r in enumerate(rows):
            part = x[offsets[r] : offsets[r + 1]]
            out[: len(part), j] = part.astype(np.int64) if fits else [int(v) for v in part]
    return out, rows


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Term at a time; queries and block have a row for each term."""
    wide = queries.dtype == object or block.dtype == object
    scores = np.zeros((queries.shape[1], block.shape[1]), object if wide else np.int64)
    for t in range(min(len(queries), len(block))):
        having = np.flatnonzero(queries[t])
        if len(having) == queries.shape[1]:
            scores += queries[t][:, None] * block[t][None, :]
        elif len(having):
            scores[having] += queries[t, having][:, None] * block[t][None, :]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest (ties: smaller id) of one array whose ids ascend."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        s = scores[keep]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        keep = keep[np.r_[above, np.flatnonzero(s == least)[: k - len(above)]]]
    return scores[keep], ids[keep]


def exact_top_k(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, queries_per_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query(id column) holds, its k best other rows."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = src.where(is_query(F.col("id")) & usable).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // queries_per_block))
    spark, tables, parts = vectors.sparkSession, None, []
    if blocks > 1:  # written once, or each block would gather all queries anew
        tables = Tables(spark, "topk")
        asked = tables.keep(asked)
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks() if blocks > 1 else asked.toArrow().combine_chunks()
        if not len(block):
            continue
        lists = block.column("v").combine_chunks()
        q, rows = integer_weights(lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks), scale)
        q_ids = block.column("id").to_numpy()[rows]
        sent = spark.sparkContext.broadcast((q_ids, q))  # at most queries_per_block vectors

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            found: list[tuple] = [(np.zeros(0, q.dtype), np.zeros(0, np.int64)) for _ in q_ids]
            for b in batches:
                c, rows = integer_weights(b.column(1), scale)
                ids = b.column(0).to_numpy()[rows]
                order = np.argsort(ids, kind="stable")
                for i in range(0, len(order), BLOCK):
                    at = order[i : i + BLOCK]
                    part, part_ids = np.ascontiguousarray(c[:, at]), ids[at]
                    for j in range(0, len(q_ids), QUERIES_AT_ONCE):
                        scores = accumulate(np.ascontiguousarray(q[:, j : j + QUERIES_AT_ONCE]), part)
                        for n, row in enumerate(scores, j):
                            s, d = best(row, part_ids, q_ids[n], k)
                            s, d = np.r_[found[n][0], s], np.r_[found[n][1], d]
                            o = np.lexsort((d, -s))[:k] if s.dtype != object else sorted(range(len(s)), key=lambda x: (-s[x], d[x]))[:k]
                            found[n] = (s[o], d[o])
            most = 2**63 - 1
            out = [(int(qi), int(d), max(-most, min(most, int(s)))) for qi, (ss, ds) in zip(q_ids, found, strict=True) for s, d in zip(ss, ds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        part = src.mapInArrow(search, "query_id long, vec_id long, score long")
        if blocks > 1:
            part = tables.keep(part)
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
