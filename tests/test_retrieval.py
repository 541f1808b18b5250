"""Quick search, passages of records, profiles, times and titles on literals."""

import json

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lexical
from tessera.operators import records as R
from tessera.plans import archive, retrieve

from .test_operators import one

DOCS = "doc_id long, text string"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_search_scores_dedups_and_cuts(spark):
    same = "docker container " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, same), (2, same + " more"), (3, "docker docker docker docker docker docker"), (4, "nothing of that kind"), (5, "a container with docker")] + [(10 + i, f"docker number{i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(20)]
    got = [(r.doc_id, r.score) for r in retrieve.search(spark.createDataFrame(rows, DOCS), asked(spark, "docker container"), top_k=50).orderBy("rank").collect()]
    assert len(got) == 10 and got[0][1] == 3.0 and got[1][1] == 3.0 and (3, 3.0) in got  # two terms once each; one term six times: 2.0 at most, and 1 for the match
    assert len({1, 2} & {d for d, _ in got}) == 1 and 4 not in {d for d, _ in got}
    assert retrieve.search(spark.createDataFrame(rows, DOCS), asked(spark, "unknownword")).count() == 0


def test_reranked_search_keeps_positive_scores(spark):
    rows = [(i, f"docker text {'good' if i % 2 else 'poor'} number{i} " + " ".join(f"x{i}y{j}" for j in range(9))) for i in range(12)]
    scorer = lambda q, t: t.map(lambda x: 0.123456 if "good" in x else -1.0).astype("float64")

    def typed(q: pd.Series, t: pd.Series) -> pd.Series:
        return scorer(q, t)

    got = retrieve.search(spark.createDataFrame(rows, DOCS), asked(spark, "docker"), use_reranker=True, reranker=typed).collect()
    assert {r.doc_id for r in got} == {1, 3, 5, 7, 9, 11} and {r.score for r in got} == {0.1235}


def test_passages_count_terms_of_the_record(spark):
    records = spark.createDataFrame([(1, "alpha in one place, omega in another", 0.5, "2024"), (2, "nothing at all", 0.5, "2024"), (3, "alpha omega", None, None)], "doc_id long, text string, importance double, created_at string")
    chunks = spark.createDataFrame([(1, 0, "alpha in one place"), (1, 1, "omega in another"), (1, 2, "neither"), (1, 12, "alpha omega too late"), (3, 0, "alpha omega"), (3, 1, "Alpha omega"), (2, 0, "alpha omega")], "doc_id long, chunk_index int, chunk_text string")
    got = {(r.doc_id, r.chunk_index): round(r.score, 4) for r in lexical.search_record_passages(records, chunks, "alpha omega").collect()}
    assert got == {(1, 0): 0.5 + 0.8 + 0.3 + 3.6, (1, 1): 0.5 + 0.8 + 0.3 + 3.6, (1, 2): 0.5 + 0.6 + 3.6, (3, 0): round(1.6 + 3.6 + 4 - 6 / 220, 4)}


def test_profile(spark):
    full = {"name": "Kim", "location": "your location", "timezone": "", "interests": ["a", "Your Project", "b"], "hardware": {"gpu_card": "x", "ram": "YOUR RAM "}, "tools_used": [], "projects": ["your project 1"]}
    assert one(spark, json.dumps(full), R.profile_text) == "- Name: Kim\n- Interests: a, b\n- Hardware: Gpu Card: x"
    assert [one(spark, x, R.profile_text) for x in ("{}", "{broken", None, json.dumps({"name": 5, "projects": [1, 2]}))] == ["", "", "", "- Projects: 1, 2"]


def test_times_of_any_type(spark):
    of = lambda x: spark.createDataFrame([(json.dumps(x),)], "x string").select(T.iso_of_variant(F.parse_json("x")).alias("y")).first().y
    assert of(1700000000000) == "2023-11-14T22:13:20" and of(1700000000123) == "2023-11-14T22:13:20.123000" and of(86400000.5) == "1970-01-02T00:00:00.000500"
    assert of("2024-01-01") == "2024-01-01" and of("1700000000000") == "2023-11-14T22:13:20" and of("") is None and of(True) is None and of(None) is None and of([1]) is None


def test_titles_of_metadata(spark):
    of = lambda x: spark.createDataFrame([(x,)], "x string").select(T.titled_by_metadata(F.col("x"), F.lit("else")).alias("y")).first().y
    assert of('{"title": "abc", "subject": "a subject"}') == "a subject" and of('{"title": 12345, "name": "a name"}') == "a name"
    assert [of(x) for x in (None, "{}", "{", json.dumps({"title": "x" * 100}))] == ["else"] * 4


def test_enrichment_skips_and_falls_back(spark):
    long = "We fixed a docker error in scripts/run.py, which took some time to find out."
    records = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, None), (5, "short")], DOCS)
    chunks = spark.createDataFrame([(3, 0, "A python script was written here,"), (3, 1, "and it was tested with care as well."), (3, 5, "kubernetes"), (5, 0, "short")], "doc_id long, chunk_index int, chunk_text string")
    got = {r.doc_id: r for r in archive.enrich_pending(records, chunks, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    assert set(got) == {1, 3} and "scripts/run.py" in "|".join(got[1].files) or "run.py" in got[1].files
    assert got[3].summary.startswith("A python script")
    titled = archive.titles(spark.createDataFrame([(i, None, f"Title: number {i}x", "chat") for i in range(5)], "doc_id long, title string, text string, category string"), limit=2)
    assert {r.doc_id for r in titled.collect()} == {0, 1}


def test_metrics_are_recorded_and_reported(spark, tmp_path):
    from datetime import datetime

    from tessera.operators import quality

    kind = "metric_id long, ts timestamp_ntz, query string, strategy string, bm25_candidates long, final_count long, elapsed_ms double, top_score double, sources_count long"
    usual = {"metric_id": 0, "ts": datetime(2024, 1, 31), "query": "q", "strategy": None, "bm25_candidates": 5, "final_count": 3, "elapsed_ms": 0.0, "top_score": 4.0, "sources_count": 2}
    one_day = lambda i, **kw: tuple((usual | {"metric_id": i, "elapsed_ms": 10.0 * i} | kw).values())
    path = str(tmp_path / "metrics")
    quality.record(spark.createDataFrame([one_day(1), one_day(2, final_count=0, top_score=0.0)], kind), path)
    quality.record(spark.createDataFrame([one_day(3, strategy="hybrid"), one_day(4, ts=datetime(2023, 1, 1))], kind), path)
    stored = spark.read.parquet(path)
    r = quality.report(stored, R.as_of()).first()
    assert (r.total, r.avg_ms, r.silent) == (3, 20.0, 1) and round(r.zero_rate, 4) == 0.3333
    assert {(x.strategy, x.n, x.min_ms, x.max_ms) for x in quality.latency(stored, "strategy").collect()} == {("unknown", 3, 10.0, 40.0), ("hybrid", 1, 30.0, 30.0)}


def test_records_are_exported_as_json_lines(spark, tmp_path):
    from tessera.sources import conversations

    lines = [json.dumps({"id": f"c{i}", "messages": [{"role": "user", "content": f"text {i} é"}]}) for i in range(20)]
    records = conversations.jsonl_records(spark.createDataFrame(list(enumerate(lines, 1)), "number long, line string"))
    conversations.export_jsonl(records, str(tmp_path / "out"))
    again = conversations.jsonl_records(conversations.lines(spark, str(tmp_path / "out")).select("number", F.replace("line", F.lit("external_id"), F.lit("id")).alias("line")))
    shown = lambda df: sorted((r.external_id, r.messages[0].content) for r in df.collect())
    assert shown(again) == shown(records) and len(shown(again)) == 20
