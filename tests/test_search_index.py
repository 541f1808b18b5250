"""The stored index: equal to searching the texts, updated by what has changed only, repeatable, pruned by bucket."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators import search_index as S

DOCS = "doc_id long, text string"


def corpus(n=200, seed=3):
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(120)] + ["license", "public", "general"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def shown(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())


def postings(index):
    return sorted((r.term, r.doc_id, r.dl, r.tf, tuple(r.positions or ())) for r in S.current(index).collect())


@pytest.fixture
def home(tmp_path):
    return str(tmp_path / "index")


def test_search_equals_search_over_texts_after_updates_and_compaction(spark, home, tmp_path):
    old, new = corpus(), dict(corpus())
    new |= {5: "license license w001", 7: "", 9: None, 300: "general public license", 301: "general license public"}
    S.update(spark.createDataFrame(old, DOCS), home, 0, buckets=8)
    S.update(spark.createDataFrame(list(new.items()), DOCS), home, 1, buckets=8)
    S.update(spark.createDataFrame([(5, "w002 again"), (300, "general public license")], DOCS), home, 2, buckets=8)
    new[5] = "w002 again"
    questions = asked(spark, "public license", "w001 w002 w003", "nothing there", "", "general")
    want = shown(lexical.bm25(spark.createDataFrame([(i, t or "") for i, t in new.items()], DOCS), questions))  # a null text counts as empty
    index = S.stored(spark, home)
    assert shown(S.search(index, questions, buckets=8)) == want
    assert index.where("segment = 2").select("doc_id").distinct().count() == 1  # 300 has not changed
    to = str(tmp_path / "compact")
    S.compact(spark, home, to)
    assert shown(S.search(S.stored(spark, to), questions, buckets=8)) == want
    assert postings(S.stored(spark, to)) == postings(index)
    assert S.stored(spark, to).select("segment").distinct().count() == 1


def test_an_update_writes_what_has_changed(spark, home):
    docs = corpus(400)
    S.update(spark.createDataFrame(docs, DOCS), home, 0)
    whole = S.stored(spark, home).count()
    docs[11] = (11, docs[11][1] + " w001 w002")
    docs[12] = (12, "quite new")
    S.update(spark.createDataFrame(docs, DOCS), home, 1)
    added = S.stored(spark, home).where("segment = 1")
    assert {r.doc_id for r in added.select("doc_id").distinct().collect()} == {11, 12}
    assert added.count() < whole / 50


def test_a_repeated_update_changes_nothing(spark, home):
    S.update(spark.createDataFrame(corpus(), DOCS), home, 0)
    more = spark.createDataFrame([*corpus(40, seed=9), (1000, "general public license")], DOCS)
    S.update(more, home, 1)
    once = sorted(map(str, S.stored(spark, home).collect()))
    S.update(more, home, 1)
    assert sorted(map(str, S.stored(spark, home).collect())) == once


def test_odd_rows(spark, home):
    assert S.search(S.stored(spark, home), asked(spark, "license")).count() == 0  # no index yet
    S.update(spark.createDataFrame([], DOCS), home, 0)
    rows = [(1, None), (2, ""), (None, "license"), (3, "license one"), (3, "license two"), (4, "the and of"), (5, "license " * 5000)]
    S.update(spark.createDataFrame(rows, DOCS), home, 1)
    index = S.stored(spark, home)
    assert S.current(index, index.where(F.col("bucket") == S.DOCUMENTS)).count() == 5
    assert {r.doc_id for r in S.match(index, any_of=["license"]).collect()} == {3, 5}
    assert S.match(index, any_of=["one"]).count() + S.match(index, any_of=["two"]).count() == 1


def test_match_forms(spark, home):
    texts = ["general public license", "public license general", "license general public license text", "public domain", "", "general general public public license"]
    S.update(spark.createDataFrame(list(enumerate(texts)), DOCS), home, 0, buckets=4)
    index = S.stored(spark, home)
    ids = lambda **kw: {r.doc_id for r in S.match(index, buckets=4, **kw).collect()}
    assert ids(any_of=["domain", "text"]) == {2, 3}
    assert ids(all_of=["general", "license"]) == {0, 1, 2, 5}
    assert ids(phrases=[["general", "public"]]) == {0, 2, 5}
    assert ids(phrases=[["general", "general"]]) == {5}
    assert ids(phrases=[["general", "public"], ["public", "license"]], none_of=["text"]) == {0, 5}
    assert ids(any_of=["public"], all_of=["license"], phrases=[["license", "general"]]) == {1, 2}
    assert ids(none_of=["general"]) == {3, 4}
    assert ids(any_of=["unknown"]) == set()


def test_a_search_reads_its_buckets(spark, home):
    S.update(spark.createDataFrame(corpus(), DOCS), home, 0, buckets=16)
    index = S.stored(spark, home)
    read = S.of_terms(index, asked(spark, "license").select(F.col("query").alias("term")), 16)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.inputFiles()}
    assert files <= {str(n) for n in range(-1, 16)}
    n = spark.range(1).select(S.bucket_of(F.lit("license"), 16)).first()[0]
    assert index.where(F.col("bucket") == n).where("term = 'license'").count() > 0


def test_a_document_is_cut_into_postings_where_it_is(spark, home):
    """Neither the terms of a document nor the postings of the index are shuffled but to their buckets."""
    texts = [(0, "gamma alpha beta alpha"), (1, ""), (2, "alpha"), (3, "the of"), (4, "alpha " * 3000 + "omega")]
    rows = S.segment_rows(spark.createDataFrame(texts, DOCS), S.stored(spark, home), 0, 4)
    got = {(r.doc_id, r.term): r for r in rows.collect()}
    assert {k: (r.dl, r.tf, r.positions[:3]) for k, r in got.items() if k[1]} == {(0, "alpha"): (4, 2, [1, 3]), (0, "beta"): (4, 1, [2]), (0, "gamma"): (4, 1, [0]), (2, "alpha"): (1, 1, [0]), (4, "alpha"): (3001, 3000, [0, 1, 2]), (4, "omega"): (3001, 1, [3000])}
    assert {k[0]: (r.dl, r.tf, r.positions) for k, r in got.items() if not k[1]} == {0: (4, 1, None), 1: (0, 1, None), 2: (1, 1, None), 3: (0, 1, None), 4: (3001, 1, None)}
    assert "collect_list" not in rows._jdf.queryExecution().executedPlan().toString()
    S.update(spark.createDataFrame(texts, DOCS), home, 0)
    S.update(spark.createDataFrame([(2, "omega")], DOCS), home, 1)
    live = S.current(S.stored(spark, home))
    assert "Exchange hashpartitioning" not in live._jdf.queryExecution().executedPlan().toString()
    assert {r.term for r in live.where("doc_id = 2").collect()} == {"", "omega"}
