"""Embedder hook with failures, and exact nearest neighbours against brute force."""

import numpy as np
import pytest

from tessera.operators import vector

VECTORS = "vec_id long, embedding array<float>"


def brute(vectors, queries, k):
    out = []
    for q, qv in queries:
        if qv is None or None in qv:
            continue
        usable = [(v, x) for v, x in vectors if x is not None and None not in x and len(x) == len(qv) and all(a == a for a in x)]
        near = sorted((float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(qv, np.float32).astype(float)) ** 2).sum())), v) for v, x in usable)[:k]
        out += [(q, i, v, round(d, 6)) for i, (d, v) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("parts", "block", "at_once"), [(1, 4096, 2048), (5, 7, 16), (3, 1, 3)])
def test_nearest_against_brute_force(spark, parts, block, at_once):
    rng = np.random.default_rng(parts)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(200)]  # many ties
    rows += [(1000, None), (1001, [None] * 6), (1002, [1.0, 2.0]), (1003, [float("nan")] * 6), (1004, []), (1005, rows[3][1])]
    asked = [(i, rows[i][1]) for i in range(0, 200, 9)] + [(500, [1.0, 2.5]), (501, None), (502, [None] * 6)]
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    got = vector.nearest(df, queries, top_k=7, queries_per_block=block, rows_at_once=at_once)
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 6)) for r in got.collect()) == brute(rows, asked, 7)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0])], VECTORS)
    assert vector.nearest(none, some.withColumnRenamed("vec_id", "query_id")).count() == 0
    assert vector.nearest(some, none.withColumnRenamed("vec_id", "query_id")).count() == 0
    plan = vector.nearest(some, some.withColumnRenamed("vec_id", "query_id"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def failing_model():
    calls = []

    def run(texts):
        calls.append(len(texts))
        assert max(map(len, texts)) <= 1000
        if any("bad" in t for t in texts):
            raise RuntimeError("no vector")
        return [[float(len(t)), float(len(calls) > 0)] for t in texts]

    return run


def test_texts_that_fail_leave_the_others_embedded(spark, tmp_path):
    rows = [(i, f"text {i}" + (" bad" if i in (3, 77, 78) else "") + "x" * (3000 if i == 5 else 0)) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    path = str(tmp_path / "e")
    got = {r.id: r for r in vector.embed_pending(df, path, "id", "t", failing_model, name="failing").collect()}
    assert {i for i, r in got.items() if r.status == "failed"} == {3, 77, 78} and len(got) == 201
    assert got[3].error == "RuntimeError: no vector" and got[3].embedding is None and got[5].embedding[0] == 1000.0 and got[200].embedding[0] == 0.0
    got = {r.id: r for r in vector.embed_pending(df.where("id <> 78"), path, "id", "t").collect()}
    assert {(r.id, r.model, r.attempt) for r in got.values() if r.attempt > 1} == {(3, "hash", 2), (77, "hash", 2)} and got[78].status == "failed"
    assert len(got[3].embedding) == 384 and abs(sum(x * x for x in got[3].embedding) - 1) < 1e-5
    assert spark.read.parquet(path).count() == 203


def test_a_model_that_returns_too_few_vectors_has_failed(spark):
    got = vector.embed(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), "id", "t", lambda: lambda texts: [], name="short").collect()
    assert [(r.status, r.error) for r in got] == [("failed", "ValueError: 0 vectors for 1 texts")] * 2
