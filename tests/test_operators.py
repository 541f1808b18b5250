"""Operators on literals, with the cases that the tables don't hold."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, fusion, lexical
from tessera.operators import records as R
from tessera.plans import planner, retrieve
from tessera.sources import archives, conversations, files
from tessera.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize_text_decomposes(spark):
    assert one(spark, "Él ﬁ ½ ßa", T.normalize_text) == "el fi 12 a"
    assert one(spark, None, T.normalize_text) == ""


def test_html_to_text(spark):
    html = "<style>p{}</style><script>if (a</p>) x</script><p>One&nbsp;&amp; two</p><div>x</div>three<br/>four &lt;5"
    assert one(spark, html, T.html_to_text) == "One & two\nthree\nfour <5"


def test_clean_message_keeps_thought_text_but_not_artifacts(spark):
    text = '<thinking>idea</thinking>\n\n{"description": 1, "subject": 2}\n\nanswer'
    assert one(spark, text, T.clean_message) == "idea\n\nanswer"


def test_summary_strips_the_whole_prefix(spark):
    assert one(spark, "user: this is a long enough line\n$ code line that is skipped", T.summary) == "this is a long enough line"
    assert one(spark, "assistant: this is a long enough line", T.summary) == "this is a long enough line"


def test_title_heuristic(spark):
    title = lambda t, c="chat": one(spark, t, lambda x: T.title_heuristic(x, F.lit(c)))
    assert title("intro\n# A heading: here") == "here" or title("intro\n# A heading") == "A heading"
    assert title("x\ndef run_all(a):\n", "code") == "Code: run_all"
    assert title("User: a sentence of middling length") == "a sentence of middling length"
    assert title("few words") == "[CHAT] few words..."
    assert title("") is None


def test_recency_weight(spark):
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    w = lambda v: one(spark, v, lambda x: T.recency_weight(x.cast("timestamp_ntz"), as_of))
    assert w(None) == 0.5 and w("2024-03-01 00:00:00") == 1.0 and w("2024-01-31 12:00:00") == 1.0
    assert w("2023-02-01 00:00:00") == pytest.approx(2.718281828**-1)


@pytest.mark.parametrize("n", [0, 49, 50, 512, 513, 2000])
def test_fixed_chunks_tile_the_text(n):
    text = "é" * n
    got = list(chunking.fixed(text, 512, 50))
    assert "".join(t for t, _, _ in got) == ("" if n < 50 else text if n % 512 == 0 or n % 512 >= 50 or n < 512 else text[: n - n % 512])
    assert all(e - s == len(t) for t, s, e in got)


def test_recursive_chunks():
    text = ("word " * 30 + "\n") * 8
    got = list(chunking.recursive(text, 512, 50))
    assert all(len(t) <= 512 and text[s:e].strip() == t for t, s, e in got) and len(got) == 3
    assert [len(t) for t, _, _ in chunking.recursive("x" * 1100, 512, 50)] == [512, 512, 76]
    assert [len(t) for t, _, _ in chunking.recursive("x" * 600 + " " + "y" * 60, 512, 50)] == [600, 60]


def test_sliding_windows_overlap_and_end_at_sentences():
    text = "A sentence of some words here. " * 60
    got = list(chunking.slide(text, 512, 64, 50))
    assert all(t.endswith(".") for t, _, _ in got) and all(b[1] == a[2] - 64 for a, b in zip(got, got[1:], strict=False))


def test_auto_chunk_picks_a_strategy(spark):
    rows = [(1, "# a\n\n## b\n\n### c\n\n" + "p " * 60, "web"), (2, "```\n" * 4 + "x" * 60, "web"), (3, "user: hi there you\nassistant: " + "yes " * 30, "codex"), (4, "plain " * 20, "web"), (5, None, "web")]
    got = chunking.auto_chunk(spark.createDataFrame(rows, "doc_id int, text string, source string"), "doc_id")
    assert {(r.doc_id, r.strategy) for r in got.collect()} == {(1, "semantic"), (2, "fixed"), (3, "conversation"), (4, "recursive")}


def test_chunks_by_name_tell_how_they_were_cut(spark):
    rows = [(1, "fixed", "abc " * 300), (2, "sliding", "abc " * 300), (3, "none such", "abc " * 300), (4, "recursive", "x" * 1200), (5, "semantic", "one " * 20 + "\n\n" + "two " * 20), (6, "conversation", "User: " + "hello " * 20 + "\nAI: " + "fine " * 90), (7, None, "plain " * 20), (8, "fixed", "short text, but long enough to be kept as a chunk"), (9, "fixed", None)]
    got = chunking.chunk_records(spark.createDataFrame(rows, "id long, name string, text string").withColumn("source", F.lit(None).cast("string")), "id", strategy=F.col("name")).collect()
    kinds = {r.id: (r.strategy, json.loads(r.metadata)) for r in got if r.chunk_index == 0}
    assert kinds[1] == ("fixed", {"size": 511}) and kinds[2][1]["overlap"] == 64 and kinds[3][0] == "sliding"
    assert kinds[4] == ("recursive", {"fallback": "character_split"}) and kinds[5] == ("semantic", {"paragraph_count": 2})
    assert kinds[6] == ("conversation", {"turn_count": 1, "roles": ["user"]}) and kinds[7][0] == "recursive" and kinds.get(9) is None
    said = [r for r in got if r.id == 6]
    assert [(r.start_char, r.end_char) for r in said] == [(0, 126), (126, 580)]
    plan = chunking.chunk_records(spark.createDataFrame(rows, "id long, name string, text string"), "id", source="name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_bm25_ranks_rare_terms_first(spark):
    docs = spark.createDataFrame([(i, "common words here") for i in range(9)] + [(9, "common rare words")], "doc_id long, text string")
    got = lexical.bm25(docs, spark.createDataFrame([(0, "rare common")], "query_id int, query string")).collect()
    assert got[0].doc_id == 9 and len(got) == 10


def test_drop_similar_keeps_at_the_threshold(spark):
    a, b, c = "a b c d e f g h i j", "a b c d e f g h i j k", "z"
    rows = [(0, 0, a), (0, 1, b), (0, 2, c), (0, 3, ""), (0, 4, ""), (0, 5, "a b c d e f g h")]
    got = fusion.drop_similar(spark.createDataFrame(rows, "query_id int, rank int, text string"))
    assert sorted(r.rank for r in got.collect()) == [0, 2, 3, 4, 5]  # 10/11 is above 0.8, 8/10 isn't


def test_merge_rewards_both(spark):
    kind = "query_id int, doc_id int, score double"
    got = fusion.merge(spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], kind), spark.createDataFrame([(0, 2, 1.0), (0, 3, 1.0)], kind), "doc_id")
    assert {r.doc_id: round(r.score, 6) for r in got.collect()} == {1: 0.6, 2: 1.3, 3: 0.4}


def test_planner(spark):
    q = ["compare a and b", "what is new", "i have my gpu", "3 days ago", "hello"]
    got = planner.plan(spark.createDataFrame(list(enumerate(q)), "query_id int, query string")).orderBy("query_id").collect()
    assert [r.query_type for r in got] == ["comparative", "temporal", "personal", "temporal", "exploratory"]
    assert got[0].top_k == 30 and got[0].strategy == "long_context" and len(got[3].expanded_queries) == 3 and got[4].confidence == 0.3


def test_hybrid_retrieve_without_vectors(spark):
    docs = spark.createDataFrame([(1, "the docker container runs in production", None), (2, "nothing to be seen in this text", None)], "doc_id long, text string, created_at timestamp_ntz")
    q = spark.createDataFrame([(0, "docker")], "query_id int, query string")
    got = retrieve.hybrid_retrieve(docs, q, R.as_of(), strategy="hybrid", fast_mode=True).collect()
    assert [r.doc_id for r in got] == [1] and got[0].score > 0.4
    faithful = retrieve.hybrid_retrieve(docs, q, R.as_of(), strategy="bm25_only", faithful=True).collect()
    assert faithful[0].score == pytest.approx(0.4)


def test_jsonl_records_tolerate_shapes(spark):
    lines = [
        {"id": "a", "title": "T", "createdAt": 1700000000000, "messages": [{"role": "user", "content": "hello code"}, "bad", {"sender": "bot", "content": ["x", {"text": "y"}, {"description": "d", "subject": "s"}]}]},
        {"session_id": "b", "turns": [{"message": {"content": "inner"}}], "date": "2024-01-01"},
        {"id": "empty", "messages": []},
    ]
    df = spark.createDataFrame([(i + 1, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "{broken"), (10, json.dumps({"messages": [{"text": "t"}]}))], "number long, line string")
    got = {r.external_id: r for r in conversations.jsonl_records(df).collect()}
    assert set(got) == {"a", "b", "line_10"}
    assert got["a"].created_at == "2023-11-14T22:13:20" and got["a"].category == "code"
    assert [(m.role, m.content) for m in got["a"].messages] == [("user", "hello code"), ("bot", "x\ny")]
    assert [(m.role, m.content) for m in got["b"].messages] == [("unknown", "inner")]


def test_normalized_records_keep_a_given_category(spark):
    line = json.dumps({"conversation_id": "c", "category": "note", "messages": [{"role": "user", "text": "hi"}]})
    assert conversations.normalized_records(spark.createDataFrame([(1, line)], "number long, line string")).first().category == "note"


def test_event_sessions(spark):
    events = [{"type": "session_start", "title": "S"}, {"type": "message", "message": {"role": "assistant", "visibility": "user_only", "content": "hidden"}}, {"type": "message", "message": {"role": "user", "content": "r" * 600 + "</system-reminder>ask"}}]
    df = spark.createDataFrame([("d/s1.jsonl", i, json.dumps(e)) for i, e in enumerate(events)], "path string, number long, line string")
    got = conversations.event_sessions(df, "factory").collect()
    assert len(got) == 1 and (got[0].external_id, got[0].title, got[0].content_text) == ("s1", "S", "user: ask")


def test_takeout_records(spark):
    docs = [[{"conversations": [{"id": "g", "messages": [{"parts": [{"text": "think"}]}]}]}, {"query": {"text": "cats"}, "id": "q"}], {"note": "n" * 60}, {"short": "x"}]
    got = conversations.takeout_records(spark.createDataFrame([(f"p{i}", json.dumps(d)) for i, d in enumerate(docs)], "path string, line string")).collect()
    assert {(r.external_id, r.record_type, r.category) for r in got} == {("g", "conversation", "reasoning"), ("q", "search", "chat"), ("p1", "document", "chat")}


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.md").write_text("note")
    with zipfile.ZipFile(tmp_path / "takeout.zip", "w") as z:
        z.writestr("Gemini/chat.json", "{}")
    (tmp_path / "broken.zip").write_bytes(b"no")
    found = files.classify(files.discover(spark, str(tmp_path))).collect()
    assert {(r.suffix, r.extractor) for r in found} == {(".md", "text_extractor"), (".zip", "takeout_extractor"), (".zip", "archive_extractor")}
    assert [r.name for r in archives.zip_members(spark, str(tmp_path)).collect()] == ["Gemini/chat.json"]
    assert files.text_files(spark, str(tmp_path)).first().text == "note"
    flags = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"\0" * 9),), (bytearray(b"text"),), (bytearray(b""),)], "c binary").select(files.is_binary(F.col("c")).alias("b")).collect()
    assert [r.b for r in flags] == [True, True, False, False]


def test_activity_entries(spark):
    html = 'x<div class="outer-cell">Gemini<br></p>You asked what is it<br>10 abr 2026, 19:55:59 CEST<br><p>It is &amp; a long answer</p></div>outer-cell no date'
    got = archives.activity_entries(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r.date, r.prompt, r.response) for r in got] == [("10 abr 2026, 19:55:59 CEST", "what is it", "It is   a long answer")]


def test_incremental_ingest_takes_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, hash string, modified timestamp"
    batch = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")
    from datetime import datetime

    t = datetime(2024, 1, 1)
    batch([("a", "1", t), ("b", "1", t)])
    for more in ([], [("a", "1", t), ("a", "2", t)]):
        if more:
            batch(more)
        stream = ingest.changed_files(spark.readStream.schema(schema).parquet(src))
        ingest.ingest_once(stream, sink, str(tmp_path / "ck"))
    got = spark.read.option("recursiveFileLookup", "true").parquet(out).select("path", "hash").collect()
    assert sorted(map(tuple, got)) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_upsert_marks_changed_files(spark):
    kind = "path string, hash string"
    old = spark.createDataFrame([("a", "1", "ingested"), ("b", "1", "ingested"), ("gone", "1", "failed")], kind + ", status string")
    got = files.upsert(old, spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], kind)).collect()
    assert {r.path: r.status for r in got} == {"a": "ingested", "b": "pending", "c": "pending", "gone": "failed"}


def test_entry_has_a_query_for_each_oracle():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_archive_jobs(spark, tmp_path):
    from tessera.plans import archive

    exports, home = tmp_path / "exports", tmp_path / "home"
    (exports / "sub").mkdir(parents=True)
    talk = lambda text: json.dumps({"id": text[:4], "title": "T", "messages": [{"role": "user", "content": text}]}) + "\n"
    (exports / "chat.jsonl").write_text(talk("hello there, this is a message of more than fifty characters in all") + "{broken\n")
    (exports / "sub" / "normalized_x.jsonl").write_text(json.dumps({"id": "n", "category": "note", "messages": [{"text": "normalised text that is long enough to make a chunk of its own"}]}) + "\n")
    (exports / "notes.md").write_text("a note " * 20)
    (exports / "photo.png").write_bytes(b"\x89PNG")
    with zipfile.ZipFile(exports / "takeout-1.zip", "w") as z:
        z.writestr("Gemini/chat.json", json.dumps({"id": "z", "messages": [{"role": "user", "content": "from a takeout archive, long enough to be chunked as well, yes"}]}))
        z.writestr("photo.json", "{}")
    config = archive.Config(str(exports), str(home), {"all": "*"})
    assert archive.missing_tables(spark, config) == list(archive.TABLES)
    assert {(r.status, r.n) for r in archive.run_discovery(spark, config).collect()} == {("pending", 5)}
    assert archive.classification_report(archive.read(spark, config, "source_files")).first()[:3] == (5, 4, 1)
    assert {(r.category, r.n) for r in archive.run_extraction(spark, config).collect()} == {("chat", 2), ("note", 2)}
    assert {r.status: r.n for r in archive.run_discovery(spark, config).collect()} == {"ingested": 4, "skipped": 1}
    assert sum(r.n for r in archive.run_chunking(spark, config).collect()) == 4
    assert sum(r.n for r in archive.run_chunking(spark, config).collect()) == 4  # nothing is chunked twice
    assert archive.run_embedding(spark, config).first().n == 4 == archive.run_embedding(spark, config).first().n
    (exports / "chat.jsonl").write_text(talk("changed text, again with more than fifty characters in this line"))
    archive.run_discovery(spark, config)
    archive.run_extraction(spark, config)
    assert {r.external_id for r in archive.read(spark, config, "content_records").where("record_type = 'conversation'").collect()} == {"chan", "n", "z"}
    shown = archive.status(spark, config, R.as_of())
    assert shown["counts"].first().n_records == 4 and shown["quality"] is None
