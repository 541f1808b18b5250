"""Incremental ingest and daily metrics with Structured Streaming (an extension: the batch system polls)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import read_if_there


def changed_files(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """New and changed files of a stream of (path, hash, modified): each (path, hash) once; state is kept for `late` only."""
    return stream.withWatermark("modified", late).dropDuplicatesWithinWatermark(["path", "hash"])


def ingest_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes all that is there and stops; the checkpoint remembers it. sink gets each batch (and its number) and must be idempotent."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_metrics(metrics: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """day, n, avg_ms, slow of a metrics stream (or table)."""
    src = metrics.withWatermark(time, late) if metrics.isStreaming else metrics
    out = src.groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("elapsed_ms").alias("avg_ms"), F.count_if(F.col("elapsed_ms") > 2000).alias("slow"))
    return out.select(F.to_date("w.start").alias("day"), "n", "avg_ms", "slow")


def read_parquet_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


RECORDS = "record_id long, text_sha256 string, category string, importance double, preview string, text string, batch long"


def record_batch(docs: DataFrame, earlier: DataFrame, number: int) -> DataFrame:
    """The records (RECORDS) of a batch of documents (doc_id, text): those that are new, or have another text than in `earlier`. Of rows that share an id the one with the largest text hash counts; rows without one are left out."""
    body = F.coalesce("text", F.lit(""))
    one = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("record_id")).agg(F.max(F.struct(F.sha2(body, 256).alias("text_sha256"), body.alias("text"))).alias("r")).select("record_id", "r.*")
    known = current_records(earlier).select("record_id", F.col("text_sha256").alias("known"))
    new = one.join(known, "record_id", "left").where("known is null or known <> text_sha256")
    out = new.withColumn("category", T.category(F.col("text")))
    return out.select("record_id", "text_sha256", "category", T.importance(F.col("category"), F.col("text")).alias("importance"), F.left("text", F.lit(2000)).alias("preview"), "text", F.lit(number).cast("long").alias("batch"))


def current_records(records: DataFrame) -> DataFrame:
    """Each record's latest version."""
    rest = [c for c in records.columns if c not in ("record_id", "batch")]
    return records.groupBy("record_id").agg(F.max_by(F.struct(*rest), "batch").alias("r"), F.max("batch").alias("batch")).select("record_id", "r.*", "batch")


def ingest_documents(stream: DataFrame, home: str, checkpoint: str) -> None:
    """Takes what is new in a stream of documents to the table at home, and ends.

    The table is partitioned by batch, and its partitions are the ledger: a batch compares with those of smaller numbers
    and overwrites its own, so that one repeated after a failure (after writing, before the checkpoint knows) leaves the table as it was."""

    def write(docs: DataFrame, number: int) -> None:
        earlier = read_if_there(docs.sparkSession, home, RECORDS).where(F.col("batch") < number)
        record_batch(docs, earlier, number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(home)

    ingest_once(stream, write, checkpoint)
