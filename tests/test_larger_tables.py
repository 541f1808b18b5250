"""Queries on small tables with what only larger ones hold, against their SQL."""

import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import archive as archive_job
from tessera.functions import fixed_values as V
from tessera.functions import text as T
from tessera.operators import chunking
from tessera.oracles import ORACLES
from tessera.plans import archive
from tessera.queries import QUERIES

from .test_oracles import rows

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, root, name, **tables):
    """The query's rows, which are its SQL's, on tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{root}/{table}.parquet/*.parquet'")
    ours, theirs = QUERIES[name](spark, str(root)).toPandas(), con.sql(ORACLES[name]).df()
    assert rows(ours) == rows(theirs)
    return ours


def test_manifest_of_pages_that_share_an_address(spark, tmp_path):
    pages = [(i, None if i % 11 == 0 else "https://a.org/takeout" if i % 2 else "https://a.org/same", "<p>x</p>") for i in range(211)]
    got = same_as_sql(spark, tmp_path, "manifest_metadata", pages=(pages, "page_id long, url string, html string"))
    assert len(got) == 211 and (got.error == "File not found").sum() == sum(i % 7 == 0 and i % 3 < 2 for i in range(211))


def test_titles_of_records_some_of_which_are_code(spark, tmp_path):
    texts = ["import os\ndef first(x):\n    return x", "a line about the code of some length\nmore", "# A title of its own\nimport x", "plain words in one line, long enough\nmore", "Title: the tool script\nmore", None, "", "reason enough"]
    docs = [(2 * i + odd, t, "en", "src", 0) for i, t in enumerate(texts) for odd in (0, 1)]
    got = same_as_sql(spark, tmp_path, "title_pipeline", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert set(got.doc_id) == {6, 8, 14}
    records = spark.createDataFrame([(0, None, texts[0], "code"), (2, "", texts[3], "chat")], "doc_id long, title string, text string, category string")
    assert {r.doc_id: r.title for r in archive.titles(records).collect()} == {0: "Code: first", 2: texts[3].split("\n")[0]}


def test_normalised_texts_of_any_character_and_without_python_for_latin_ones(spark):
    texts = [*map(chr, range(1, 0x2200, 3)), "".join(map(chr, range(0x80, 0x250))), None, "", "İstanbul Straße ŁÓDŹ ﬁ ½ ™ é 한 x"]
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalize_text(F.col("t")).alias("n"))
    want = [unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode("ascii").lower() for t in texts]
    assert [r.n for r in made.orderBy("i").collect()] == want
    assert len(T.ACCENTED) > 200 and all(T._ascii(x).isalpha() for x in T.ACCENTED)


def test_chunks_are_cut_from_few_rows_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001))], ["n"])
    parts = list(chunking.few_rows([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) == chunking.ROWS and [n for p in parts for n in p.column(0).to_pylist()] == list(range(1001))


def test_texts_are_lowered_once_not_for_each_word(spark):
    """Keywords lower the text for themselves."""
    texts = spark.createDataFrame([("document", 1, "s", "Docker and CLAUDE in one line of text", "h")], "record_type string, record_id long, source string, text string, text_sha256 string")
    records = archive_job.records_of(texts)
    x = F.col("text")
    want = texts.select(T.category(x), T.labels_found(x, V.TOOLS), T.labels_found(x, V.TASKS)).first()
    assert tuple(records.select("category", "tools", "tasks").first()) == tuple(want) and want[1] == ["claude"]
    for df in (records, archive.enriched(texts.withColumnRenamed("record_id", "doc_id"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
