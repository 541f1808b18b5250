"""The archive's batch jobs over exports of every form; record text; incremental ingest that is interrupted."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.plans import archive
from tessera.sources import files
from tessera.streaming import ingest

LONG = "this is a text of more than fifty characters, so that it becomes a chunk"


def exports(root):
    (root / "factory" / "-home-user").mkdir(parents=True)
    (root / "qwen" / "projects" / "p" / "chats").mkdir(parents=True)
    (root / "factory" / "-home-user" / "s1.jsonl").write_text("\n".join(json.dumps(e) for e in [{"type": "session_start", "title": "A session"}, {"type": "message", "message": {"role": "user", "content": f"please write code, {LONG}"}}]))
    (root / "factory" / "-home-user" / "s1.settings.json").write_text(json.dumps({"model": "some model"}))
    (root / "qwen" / "projects" / "p" / "chats" / "q1.jsonl").write_text(json.dumps({"type": "user", "message": {"parts": [{"text": LONG}]}}))
    (root / "chat.jsonl").write_text("".join(json.dumps({"id": f"c{i}", "messages": [{"role": "user", "content": f"{LONG} {i}"}]}) + "\n" for i in range(3)))
    (root / "notes.md").write_text("a note " * 20)
    (root / "photo.png").write_bytes(b"\x89PNG")
    with zipfile.ZipFile(root / "takeout-1.zip", "w") as z:
        z.writestr("Gemini/chat.json", json.dumps([[{"id": f"z{i}", "messages": [{"role": "user", "content": f"from an archive, {LONG} {i}"}]}] for i in range(2)]))


def test_extraction_dispatches_counts_and_recovers(spark, tmp_path):
    root = tmp_path / "exports"
    exports(root)
    config = archive.Config(str(root), str(tmp_path / "home"), {"factory": "s*.jsonl", "qwen": "q*.jsonl", "rest": ["chat*", "*.md", "*.png", "*.zip"]})
    archive.run_discovery(spark, config)
    archive.run_extraction(spark, config)
    records = archive.read(spark, config, "content_records")
    got = {r.external_id: r for r in records.collect()}
    assert set(got) == {"s1", "q1", "c0", "c1", "c2", "z0", "z1", next(k for k in got if k.endswith("notes.md"))}
    assert (got["s1"].title, got["s1"].model, got["s1"].category, got["s1"].form) == ("A session", "some model", "code", "factory") and got["q1"].form == "qwen"
    state = {r.path.rsplit("/", 1)[1]: r for r in archive.read(spark, config, "source_files").collect()}
    assert {k: r.status for k, r in state.items()} == {"s1.jsonl": "ingested", "q1.jsonl": "ingested", "chat.jsonl": "ingested", "notes.md": "ingested", "photo.png": "skipped", "takeout-1.zip": "ingested"}
    assert {k: r.record_count for k, r in state.items()} == {"s1.jsonl": 1, "q1.jsonl": 1, "chat.jsonl": 3, "notes.md": 1, "photo.png": 0, "takeout-1.zip": 2}
    assert json.loads(state["chat.jsonl"].metadata)["classification"]["extractor"] == "jsonl_extractor"
    batch = archive.read(spark, config, "ingestion_batches").collect()
    assert [(b.files_processed, b.files_skipped, b.files_failed, b.records_created, b.status) for b in batch] == [(5, 1, 0, 8, "completed")]
    archive.run_chunking(spark, config)
    state = {r.path.rsplit("/", 1)[1]: r for r in archive.read(spark, config, "source_files").collect()}
    assert state["chat.jsonl"].chunk_count == 3 and state["takeout-1.zip"].chunk_count == 2 and state["photo.png"].chunk_count == 0
    # a file changes, one is new and goes again before it's read
    (root / "chat.jsonl").write_text(json.dumps({"id": "c9", "messages": [{"role": "user", "content": LONG}]}) + "\n")
    (root / "chat-2.jsonl").write_text("{}")
    with zipfile.ZipFile(root / "takeout-1.zip", "w") as z:
        z.writestr("Gemini/chat.json", json.dumps({"id": "z7", "messages": [{"role": "user", "content": LONG}]}))
    archive.run_discovery(spark, config)
    (root / "chat-2.jsonl").unlink()
    archive.run_extraction(spark, config)
    ids = {r.external_id for r in archive.read(spark, config, "content_records").collect()}
    assert ids >= {"s1", "q1", "c9", "z7"} and not ids & {"c0", "z0", "z1"}
    gone = archive.read(spark, config, "source_files").where("status = 'failed'").collect()
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in gone] == [("chat-2.jsonl", "File not found")]
    assert archive.read(spark, config, "ingestion_batches").orderBy("started_at").collect()[1].files_failed == 1
    assert json.loads(archive.read(spark, config, "workflow_state").first().value)["records_created"] == 2
    archive.run_extraction(spark, config)  # nothing is due but the lost file
    assert {r.external_id for r in archive.read(spark, config, "content_records").collect()} == ids
    manifest = [json.loads(x) for f in (tmp_path / "home" / "manifest_json").glob("part-*") for x in f.read_text().splitlines()]
    assert len(manifest) == 7


def test_config_of_file_and_environment(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"root": "a", "home": "b", "sources": {"x": ["*.md", "*.txt"], "y": "*.zip"}}))
    c = archive.Config.load(str(tmp_path / "c.json"), {"TESSERA_HOME": "elsewhere"})
    assert (c.root, c.home, c.patterns()) == ("a", "elsewhere", [("x", "*.md"), ("x", "*.txt"), ("y", "*.zip")])


def test_session_logs_of_qwen_lie_in_chats(spark, tmp_path):
    exports(tmp_path)
    assert [r.path.rsplit("/", 1)[1] for r in files.session_logs(spark, str(tmp_path), "qwen").collect()] == ["q1.jsonl"]
    assert files.session_logs(spark, str(tmp_path), "factory").count() == 3
    (tmp_path / "b.settings.json").write_text("{broken")
    assert {r.session.rsplit("/", 1)[1]: r.model for r in files.session_models(spark, str(tmp_path)).collect()} == {"s1": "some model", "b": "unknown"}


def test_manifest_keeps_other_metadata(spark):
    rows = [("a.jsonl", "pending", '{"x": {"y": [1, 2]}, "classification": "old"}'), ("b.png", "failed", None), ("c.md", "ingested", "{}"), ("d.md", "pending", "not json"), ("e.md", "pending", None)]
    got = {r.path: r for r in files.classify_manifest(spark.createDataFrame(rows, "path string, status string, metadata string"), spark.createDataFrame([("a.jsonl",), ("b.png",), ("d.md",)], "path string")).collect()}
    assert json.loads(got["a.jsonl"].metadata) == {"x": {"y": [1, 2]}, "classification": {"file_type": "jsonl", "extractor": "jsonl_extractor", "processable": True}}
    assert json.loads(got["b.png"].metadata)["classification"]["processable"] is False and got["c.md"].metadata == "{}" and "classification" in got["d.md"].metadata
    assert (got["e.md"].status, got["e.md"].error) == ("failed", "File not found") and got["c.md"].error is None


def test_record_text(spark):
    meta = [{"content_text": LONG, "text": LONG}, {"content_text": "short", "summary": LONG, "body": ["a", 1, {"k": 2}, *"bcdefghij"], "description": "short", "content": []}, {"content_preview": "p"}, None, {"text": 5}]
    rows = [(i, "T" if i else "", "chat" if i != 3 else None, m and json.dumps(m), f"d/{i}.jsonl" if i != 4 else "d/x.md", f"id{i}") for i, m in enumerate(meta)] + [(5, None, None, "{broken", "d/2.jsonl", "line_3")]
    records = spark.createDataFrame(rows, "record_id long, title string, category string, metadata string, path string, external_id string")
    talk = lambda i, *ms: json.dumps({"id": i, "messages": [{"role": "user", "content": m} for m in ms]})
    lines = [("d/1.jsonl", 1, talk("other", "no")), ("d/1.jsonl", 2, talk("id1", "hello", "", ["x", "y"])), ("d/1.jsonl", 3, talk("id1", "a later line of this id")), ("d/2.jsonl", 1, "{broken"), ("d/2.jsonl", 3, json.dumps({"turns": [{"text": "by number"}]})), ("d/4.jsonl", 1, talk("id4", "not read")), ("d/0.jsonl", 1, talk("id0", "not read"))]
    got = {r.record_id: r.record_text for r in R.with_text(records, spark.createDataFrame(lines, "path string, number long, line string")).collect()}
    assert got == {
        0: LONG,
        1: f"Title: T\n\nCategory: chat\n\n{LONG}\n\n" + "\n".join(["a", "1", '{"k":2}', *"bcdefgh"]) + "\n\nuser: hello\nuser: x y",
        2: "Title: T\n\nCategory: chat\n\np",
        3: "Title: T",
        4: "Title: T\n\nCategory: chat",
        5: "unknown: by number",
    }
    assert R.with_text(records).count() == 6


@pytest.mark.parametrize("when", ["before", "after"])
def test_ingest_survives_a_failure_around_the_write(spark, tmp_path, monkeypatch, when):
    source, home, mark = (str(tmp_path / x) for x in ("in", "records", "checkpoint"))
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
    run = lambda: ingest.ingest_documents(ingest.read_parquet_stream(spark, source, spark.createDataFrame([], "doc_id long, text string")), home, mark)
    now = lambda: {r.record_id: (r.text, r.batch) for r in ingest.current_records(spark.read.schema(ingest.RECORDS).parquet(home)).collect()}
    put([(1, "one"), (2, "two"), (None, "lost"), (3, None)])
    run()
    assert now() == {1: ("one", 0), 2: ("two", 0), 3: ("", 0)}
    put([(2, "two, later"), (1, "one"), (4, "four"), (4, "four")])
    whole = ingest.record_batch

    def failing(docs, earlier, number):
        if when == "before":
            raise RuntimeError("lost")
        whole(docs, earlier, number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(home)
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "record_batch", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(ingest, "record_batch", whole)
    for _ in range(2):
        run()
        assert now() == {1: ("one", 0), 2: ("two, later", 1), 3: ("", 0), 4: ("four", 1)}
    assert spark.read.parquet(home).where(F.col("batch") == 1).count() == 2
