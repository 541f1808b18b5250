"""Every stage of the pipeline on awkward rows and on no rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")
CLASH = {"id": "long", "h": "string", "quality": "int", "size": "int", "fp": "long", "term": "string"}
STAGES = dict(C.STAGES)
PROSE = "a quite plain sentence with some words in it, number {}. " * 30
ODD = [
    (None, None, None, None, None),
    (None, "", "en", "s", 0),
    (None, PROSE.format(*[1] * 30), "en", None, 10),
    (None, PROSE.format(*[1] * 30), "en", None, 10),
    (1, "repeated id", "en", "s", 5),
    (1, "repeated id", "en", "s", 5),
    (1, "repeated id, other text", "en", "s", 5),
    (900001, "x" * 300_000, "en", "s", 5),
    (900002, "word " * 50_000, None, "s", 5),
    (900003, " \n ", "en", "s", 2),
    (900004, "a tie of two words", "en", "s", 3),
    (900005, "a tie of two words", "en", "s", 3),
]


def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in CLASH.items()])


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows_give_no_rows(spark, name):
    none = odd(spark).limit(0)
    assert STAGES[name](spark, none, str(SMALL)).count() == 0


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())


def test_quality_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    both = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in CLASH.items()]).unionByName(odd(spark))
    got = C.quality(spark, both, str(SMALL))
    assert got.columns == C.COLUMNS
    assert set(texts(got)) <= set(texts(both)) and got.where("doc_id < 200").count() > 100


def test_lines_of_odd_rows(spark):
    got = C.lines(spark, odd(spark), str(SMALL))
    assert got.columns == C.COLUMNS and got.count() == len(ODD)
    by = {(str(r.doc_id), r.text) for r in got.collect()}
    assert ("900004", "a tie of two words") in by and ("900005", "") in by and ("None", None) in by and ("900001", "x" * 300_000) in by
    assert got.where("text is not null and n_chars <> length(text)").count() == 0


def test_near_of_odd_rows(spark):
    got = texts(C.near(spark, odd(spark), str(SMALL)))
    assert len(got) == len(set(got)) and ("1", "repeated id") in got and ("900004", "a tie of two words") in got and ("900005", "a tie of two words") not in got
    assert sum(t == "" or t.isspace() for _, t in got) == 1  # empty texts are one group
    assert ("None", PROSE.format(*[1] * 30)) in got


def test_decontamination_of_odd_rows(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("size(split(text, ' ')) >= 10").first().text
    hit = spark.createDataFrame([(None, item, None, None, None), (1, f"before {item} after", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    both = odd(spark).unionByName(hit, allowMissingColumns=True)
    got = C.decontaminate(spark, both, str(SMALL))
    assert got.columns == C.COLUMNS and texts(got) == texts(odd(spark))


def test_mix_of_odd_rows(spark):
    got = C.mixing(spark, odd(spark), str(SMALL)).collect()
    assert {(str(r.doc_id), r.text) for r in got} <= {(str(i), t) for i, t, *_ in ODD}
    assert all(r.copies in (1, 2) and r.taken == r.copies * r["size"] and r["size"] == len((r.text or "").split()) for r in got)
    again = C.mixing(spark, odd(spark).repartition(3), str(SMALL)).collect()
    shown = lambda rows: sorted((str(r.doc_id), r.text or "", r.copies) for r in rows)
    assert shown(again) == shown(got)
