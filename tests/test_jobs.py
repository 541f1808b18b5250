"""The jobs on copies of small tables: what is new only, repeated and interrupted runs, odd rows, the command line."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import archive, search_index
from jobs.common import settings
from jobs.queries import ORACLES, QUERIES
from tessera.operators import lexical
from tessera.operators import search_index as S

from .test_oracles import DATA, duck, rows  # noqa: F401

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn int, role string, text string"


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def put(spark, folder, number, docs):
    """One more file in a folder of documents."""
    spark.createDataFrame(docs, DOCS).coalesce(1).write.mode("append").parquet(str(folder))
    assert len(list(Path(folder).glob("part-*"))) == number


def postings(df):
    return sorted((r.term, r.doc_id, r.dl, r.tf, tuple(r.positions or ())) for r in df.collect())


def built_anew(spark, tmp_path, docs):
    home = str(tmp_path / f"anew{len(docs)}")
    S.update(spark.createDataFrame(docs, DOCS), home, 0)
    return postings(S.stored(spark, home))


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    first = [(i, f"general words w{i} w{i % 7}") for i in range(60)]
    put(spark, tmp_path / "in", 1, first)
    home = str(tmp_path / "home")
    assert postings(search_index.run(spark, str(tmp_path / "in"), home)) == built_anew(spark, tmp_path, first)
    before = sorted(map(str, Path(home, "index").rglob("*.parquet")))
    search_index.run(spark, str(tmp_path / "in"), home)  # nothing new
    assert sorted(map(str, Path(home, "index").rglob("*.parquet"))) == before
    assert "0 rows were new" in caplog.text and "read 60 documents" in caplog.text
    put(spark, tmp_path / "in", 2, [(3, "another text"), (4, first[4][1]), (70, "license"), (71, None), (None, "lost")])
    now = dict(first) | {3: "another text", 70: "license", 71: None}
    got = search_index.run(spark, str(tmp_path / "in"), home)
    assert postings(got) == built_anew(spark, tmp_path, list(now.items()))
    assert {r.doc_id for r in S.stored(spark, f"{home}/index").where("segment = 1").select("doc_id").collect()} == {3, 70, 71}
    assert "of 3 new or changed documents" in caplog.text
    asked = spark.createDataFrame([(0, "license general w3")], "query_id long, query string")
    texts = spark.createDataFrame([(i, t or "") for i, t in now.items()], DOCS)
    found = lambda df: [(r["rank"], r.doc_id, round(r.score, 6)) for r in df.orderBy("rank").collect()]
    assert found(S.search(S.stored(spark, f"{home}/index"), asked)) == found(lexical.bm25(texts, asked))


def test_index_after_a_failure_between_writing_and_remembering(spark, tmp_path, monkeypatch):
    docs = [(i, f"some words w{i}") for i in range(30)]
    put(spark, tmp_path / "in", 1, docs)
    home, whole = str(tmp_path / "home"), S.write_segment

    def write_and_fail(rows, to):
        whole(rows, to)
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "write_segment", write_and_fail)
    with pytest.raises(Exception, match="lost"):
        search_index.run(spark, str(tmp_path / "in"), home)
    monkeypatch.setattr(S, "write_segment", whole)
    put(spark, tmp_path / "in", 2, [(30, "one more"), (2, "changed")])
    got = postings(search_index.run(spark, str(tmp_path / "in"), home))
    assert got == built_anew(spark, tmp_path, list((dict(docs) | {30: "one more", 2: "changed"}).items()))


def test_index_in_several_batches(spark, tmp_path):
    every = {}
    for n in range(1, 4):
        put(spark, tmp_path / "in", n, new := [(i, f"words of file {n} w{i}") for i in range(n * 5, n * 5 + 10)])
        every |= dict(new)
    home = str(tmp_path / "home")
    got = postings(search_index.run(spark, str(tmp_path / "in"), home, files_per_batch=1))
    assert S.stored(spark, f"{home}/index").select("segment").distinct().count() == 3
    assert [p[1] for p in got if p[0] == ""] == sorted(every)


def tables(spark, root):
    documents = [(1, "First document with enough words in its first line. " * 20, "a"), (2, "short", ""), (3, None, None), (None, "no id", "a"), (4, "short", "b"), (5, "# one\n\n## two\n\n### three\n\n" + "words and words. " * 50, "b"), (5, "", "c")]
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{root}/documents")
    pages = [(1, "https://www.example.com/x", "<p>A visible paragraph of some length &amp; more</p><script>no</script>"), (2, "nonsense", None), (3, "http://b.org", "<p>A visible paragraph of some length &amp; more</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages")
    turns = [(1, 1, "assistant", "the answer to it"), (1, 0, "user", "the question"), (2, 0, "user", " "), (3, 0, None, "who says this"), (None, 0, "user", "lost"), *((4, i, "user", "word " * 120) for i in range(9))]
    spark.createDataFrame(turns, TURNS).write.parquet(f"{root}/conversations")
    return {t: f"{root}/{t}" for t in ("documents", "pages", "conversations")}


def test_archive_of_odd_rows_and_repeated_runs(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    given, home = tables(spark, tmp_path), str(tmp_path / "home")
    got = {(r.record_type, r.record_id): r for r in archive.run(spark, home, **given).collect()}
    assert sorted(got) == [("conversation", 1), ("conversation", 3), ("conversation", 4), ("document", 1), ("document", 2), ("document", 3), ("document", 5), ("page", 1), ("page", 2)]
    assert got["document", 2].n_copies == 2 and got["document", 2].source == "unknown" and got["document", 2].n_chunks == 0
    assert got["page", 1].n_copies == 2 and got["page", 1].source == "www.example.com" and got["page", 2].text == ""
    assert got["conversation", 1].text == "user: the question\n\nassistant: the answer to it" and got["conversation", 4].n_chunks == 3
    assert "read 7 documents from" in caplog.text and "read 3 pages" in caplog.text and "read 4 conversations" in caplog.text and "wrote 9 rows to" in caplog.text
    chunks = spark.read.parquet(f"{home}/chunks")
    assert {r.strategy for r in chunks.where("record_type = 'document' and record_id = 5").collect()} == {"semantic"}
    again = {(r.record_type, r.record_id): r for r in archive.run(spark, home, **given).collect()}
    assert again == got
    assert {p.name for p in Path(home, "records").glob("record_type=*")} == {f"record_type={t}" for t in ("document", "page", "conversation")}


def test_archive_leaves_types_that_are_not_given(spark, tmp_path):
    given, home = tables(spark, tmp_path), str(tmp_path / "home")
    archive.run(spark, home, **given)
    spark.createDataFrame([(9, "http://c.org", "<p>quite another page than before</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/later")
    got = archive.run(spark, home, pages=f"{tmp_path}/later")
    assert got.where("record_type = 'page'").select("record_id").collect()[0][0] == 9 and got.where("record_type = 'page'").count() == 1
    assert got.where("record_type <> 'page'").count() == 7
    with pytest.raises(ValueError, match="at least one"):
        archive.run(spark, home)


def test_settings_of_file_and_options(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": "a", "home": "b", "buckets": 8}))
    assert settings(["--config", str(tmp_path / "c.json"), "--home", "c"], "", "search_index.json", ["documents", "home"]) == {"documents": "a", "home": "c", "buckets": 8}
    assert set(settings([], "", "archive.json", ["home"])) == {"documents", "pages", "conversations", "home"}


def test_command_line(spark, tmp_path):
    given = tables(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 4, "documents": "", "home": ""}))
    root = Path(search_index.__file__).parents[1]
    options = ["--config", str(tmp_path / "c.json"), "--documents", given["documents"], "--home", str(tmp_path / "home")]
    done = subprocess.run([sys.executable, "-m", "jobs.search_index", *options], cwd=root, capture_output=True, text=True, timeout=240, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "is up to date" in done.stderr
    index = S.stored(spark, str(tmp_path / "home" / "index"))
    assert index.where(index["bucket"] == S.DOCUMENTS).count() == 5
