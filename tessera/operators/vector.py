"""Hash embeddings and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import read_if_there


def _hasher(dim: int, words: int) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the places that a text's words hit, and its vector."""
    known: dict[str, bytes] = {}
    fade = 1.0 - 0.01 * np.arange(words)

    def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
        first = text.lower().split()[:words]
        if len(known) > 200_000:
            known.clear()
        for w in first:
            if w not in known:
                known[w] = hashlib.md5(w.encode()).digest()
        byte = np.frombuffer(b"".join(known[w] for w in first), np.uint8).astype(np.int64)
        v = np.bincount(byte % dim, byte / 255.0 * np.repeat(fade[: len(first)], 16), dim)
        return np.unique(byte % dim), v / (np.sqrt((v * v).sum()) or 1.0)

    return hashed


def hash_model(dim: int = 384, words: int = 100) -> Callable[[list[str]], list[np.ndarray]]:
    """The stand-in where no model is at hand: unit feature-hash vectors. Each md5 byte of a word adds its value, one per cent less for each word before."""
    hashed = _hasher(dim, words)
    return lambda texts: [hashed(t)[1] for t in texts]


def hash_embeddings(df: DataFrame, key: str, text: str, *, dim: int = 384, words: int = 100) -> DataFrame:
    """key, at, value: the places of each text's hash_model() vector that its words hit.

    Over Arrow batches: exploded to a row a byte it took ten times as long."""
    src = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hasher(dim, words)
        for b in batches:
            found = [hashed(t) for t in b.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
            places, values = (np.concatenate([np.zeros(0), *x]) for x in ([at for at, _ in found], [v[at] for at, v in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(places.astype(np.int64)), pa.array(values)], [key, "at", "value"])

    return src.mapInArrow(embed, f"{key} {src.schema[key].dataType.simpleString()}, at long, value double")


_models: dict[str, Callable[[list[str]], list]] = {}


def embed(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], list]] = hash_model, *, name: str = "hash", batch: int = 64, chars: int = 1000) -> DataFrame:
    """key, status (embedded or failed), model, embedding, error of each text, cut at `chars`.

    model() is made once in each Python worker; it takes lists of texts. A batch that it fails on is tried again text by text, so that only those
    that fail alone are failed; they don't fail the job."""
    src = df.select(key, F.left(F.coalesce(F.col(text), F.lit("")), F.lit(chars)).alias("__text"))

    def tried(run: Callable[[list[str]], list], texts: list[str]) -> list[tuple]:
        try:
            found = run(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return [("embedded", [float(x) for x in v], None) for v in found]
        except Exception as e:  # a model's own errors
            return [("failed", None, f"{type(e).__name__}: {e}"[:500])] if len(texts) == 1 else [t for x in texts for t in tried(run, [x])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models[name] = model()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                done = tried(_models[name], part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done]), pa.array([name] * len(done)), pa.array([d[1] for d in done], pa.list_(pa.float32())), pa.array([d[2] for d in done], pa.string())], [key, "status", "model", "embedding", "error"])

    return src.mapInArrow(work, f"{key} {src.schema[key].dataType.simpleString()}, status string, model string, embedding array<float>, error string")


def embed_pending(df: DataFrame, path: str, key: str, text: str, model: Callable[[], Callable[[list[str]], list]] = hash_model, *, name: str = "hash") -> DataFrame:
    """Embeds what the table at path hasn't embedded yet, failed rows included, appends it, and returns each key's latest state (embedding_states())."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, status string, model string, embedding array<float>, error string, attempt int"
    states = embedding_states(read_if_there(spark, path, schema), key)
    todo = df.join(states.select(key, "status", F.col("attempt").alias("last")), key, "left").where("status is null or status = 'failed'")
    new = embed(todo, key, text, model, name=name).join(states.select(key, F.col("attempt").alias("last")), key, "left").withColumn("attempt", F.coalesce(F.col("last") + 1, F.lit(1))).drop("last")
    new.select(key, "status", "model", "embedding", "error", "attempt").write.mode("append").parquet(path)
    return embedding_states(spark.read.schema(schema).parquet(path), key)


def embedding_states(rows: DataFrame, key: str) -> DataFrame:
    """Each key's latest attempt."""
    return rows.groupBy(key).agg(F.max_by(F.struct("status", "model", "embedding", "error", "attempt"), "attempt").alias("s")).select(key, "s.*")


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", top_k: int = 10, queries_per_block: int = 4096, rows_at_once: int = 2048) -> DataFrame:
    """query_id, rank, key, distance, score (10 less the distance, at least 0): exact, by Euclidean distance, ties by key.

    Queries go out in blocks of a fixed number, and every block meets all vectors where they are read: a matrix product finds the k nearest of some thousand rows for all
    queries of a block at once (and what is as near but for rounding), whose distances are then worked out in full; a task sends k rows a query at most.
    Vectors that are null, hold a null or no number, or are of another length than the query, take no part."""
    spark, kinds = vectors.sparkSession, {c: d for c, d in vectors.select(key).dtypes} | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, distance double"
    src = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    blocks = max(1, -(-asked.count() // queries_per_block))
    parts = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        sizes = np.array([len(v) for v in block.column("v").to_pylist()], int)
        for size in np.unique(sizes):
            of = block.take(pa.array(np.flatnonzero(sizes == size)))
            sent = spark.sparkContext.broadcast((of.column("query_id").combine_chunks(), np.array(of.column("v").to_pylist(), float)))  # at most queries_per_block vectors

            def search(batches: Iterator[pa.RecordBatch], sent=sent, size=size) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                best = (np.zeros(0, int), np.zeros(0), None)  # query, distance, key
                for b in batches:
                    lists = b.column(1)
                    rows = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == size)
                    if not len(rows):
                        continue
                    c = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)
                    keys = b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    for at in range(0, len(rows), rows_at_once):
                        best = merge_nearest(best, *within(q, c[at : at + rows_at_once], top_k), keys[at : at + rows_at_once], top_k)
                if best[2] is not None:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[2]), pa.array(best[1])], ["query_id", key, "distance"])

            parts.append(src.mapInArrow(search, schema))
    scored = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", key, "distance", F.greatest(F.lit(0.0), 10.0 - F.col("distance")).alias("score"))


def within(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the pairs among which each query's k nearest rows are."""
    about = (c * c).sum(1)[None, :] + (q * q).sum(1)[:, None] - 2.0 * (q @ c.T)
    last = np.partition(about, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(q), np.inf)
    slack = 1e-9 * (1.0 + (c * c).sum(1).max() + (q * q).sum(1))
    query, row = np.nonzero(about <= (last + slack)[:, None])
    return query, row, np.sqrt(((c[row] - q[query]) ** 2).sum(1))


def merge_nearest(best: tuple, query: np.ndarray, row: np.ndarray, distance: np.ndarray, keys: np.ndarray, k: int) -> tuple:
    """The k nearest a query of those held and new ones; ties by key."""
    query, distance, key = (np.r_[best[0], query], np.r_[best[1], distance], keys[row] if best[2] is None else np.r_[best[2], keys[row]])
    order = np.lexsort((key, distance, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < k]
    return query[place < k], distance[order], key[order]
