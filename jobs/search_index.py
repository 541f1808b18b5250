"""Keeps the stored search index up to date with a folder of documents (Parquet: doc_id, text, others ignored).

    python -m jobs.search_index --config jobs/search_index.json --documents PATH --home PATH

Incremental: a file stream takes the files that are new since the last run (checkpoint in HOME/checkpoint), processes them and ends. Each
micro-batch is one segment of the index (HOME/index, partitioned by segment and bucket): its documents that are new,
or have another text than before. A batch that is repeated after a failure overwrites its own segment's partitions with the same rows.
Index and checkpoint belong together: to build anew, give another HOME.

Files are never changed in place; a document's new version comes in a new file. Within a batch, of rows that share an id the one with the
largest text hash counts; a null text is an empty one; rows without an id are left out; an empty or absent folder leaves the index as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, main
from tessera.operators import search_index

DOCUMENTS = "doc_id long, text string"


def as_glob(path: str) -> str:
    """A file stream reads folders and globs: this one matches the path itself, be it a folder or a single file."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in name for c in "*?[{") else f"{parent}/{{{name}}}" if parent else f"{{{name}}}"


def run(spark: SparkSession, documents: str, home: str, *, buckets: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """Brings the index in `home` up to date with `documents` and returns its current rows (search_index.SCHEMA)."""
    index = f"{home.rstrip('/')}/index"

    def add(batch: DataFrame, number: int) -> None:
        earlier = search_index.stored(batch.sparkSession, index).where(F.col("segment") < number)
        read, wrote = Observation(), Observation()
        rows = search_index.segment_rows(batch.observe(read, F.count("*").alias("documents")), earlier, number, buckets)
        rows = rows.observe(wrote, F.count("*").alias("rows"), F.count_if(F.col("bucket") == search_index.DOCUMENTS).alias("documents"))
        search_index.write_segment(rows, index)
        LOG.info("batch %d: read %d documents of %s; wrote %d postings of %d new or changed documents to %s", number, read.get.get("documents", 0), documents, wrote.get.get("rows", 0) - wrote.get.get("documents", 0), wrote.get.get("documents", 0), index)

    source = spark.readStream.schema(DOCUMENTS)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.parquet(as_glob(documents)).writeStream.foreachBatch(add)
    query = stream.option("checkpointLocation", f"{home.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("%s is up to date with %s: %d rows were new to it", index, documents, sum(p.numInputRows for p in query.recentProgress))
    return search_index.current(search_index.stored(spark, index))


if __name__ == "__main__":
    main(run, None, __doc__, "search_index.json", ["documents", "home"])
