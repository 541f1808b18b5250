"""Corpus pipeline: the stages through which documents go, each over all that its predecessor kept.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, mixing to source weights. Each stage is a
function of (spark, docs, sf_dir); all but the last return the columns of documents. Null ids, null
and empty texts and repeated rows go through as each operator states; clashing extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Tables
from tessera.llm.compression_quality import fit_quality, score_quality
from tessera.llm.decontaminate import contamination
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.mixing import mix
from tessera.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under 0.5."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(COLUMNS), model).where("score >= 0.5").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs; n_chars follows."""
    out = drop_repeated_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the smallest id's (rows without an id last), of rows that repeat it the one with the smallest fingerprint, then text hash."""
    src = docs.select(COLUMNS)
    # near_duplicates() is given a number for each distinct (id, text), so that rows that repeat an id, or have none, keep their own place
    tables = Tables(spark, "near")
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    # texts are grouped by their hashes: rows that share id and hash are one
    rows = src.groupBy("doc_id", text_hash.alias("__text")).agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r")).select("doc_id", "r.*")
    rows = tables.keep(rows.withColumn("__row", F.monotonically_increasing_id()))
    groups = near_duplicates(rows, id_col="__row").select(F.col("__row").alias("__r"), "fingerprint", "component_id")
    marked = rows.join(groups, F.col("__row") == F.col("__r")).withColumn("__key", F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint", text_hash))
    first = marked.groupBy("component_id").agg(F.min_by("__row", "__key").alias("kept"))
    return rows.join(first, F.col("__row") == F.col("kept"), "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    src = docs.select(COLUMNS)
    found = contamination(src, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("id2"), "h").distinct()
    same = src["doc_id"].eqNullSafe(F.col("id2")) & (F.xxhash64(F.coalesce(src["text"], F.lit(""))) == F.col("h"))
    return src.join(found, same, "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken."""
    src = docs.select(COLUMNS)
    turn = lambda *order: F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))  # noqa: E731  tells rows apart that repeat an id
    size = F.col("size")
    taken = mix(src).withColumn("__n", turn("source", size)).select(F.col("doc_id").alias("id2"), "size", "source_size", "target", "copies", "taken", "__n").where("copies > 0")
    word = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    mine = src.withColumn("__m", turn("source", word))
    return mine.join(taken, mine["doc_id"].eqNullSafe(F.col("id2")) & (F.col("__m") == F.col("__n"))).drop("id2", "__n", "__m")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", decontaminate), ("mix", mixing)]
#: A model fitted by Newton steps and seeded sampling aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's documents written to the shared folder and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = tables.keep(docs)
    return docs
