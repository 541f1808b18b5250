"""Builds the archive of records and chunks from documents, raw web pages and conversations.

    python -m jobs.archive --config jobs/archive.json --documents PATH --pages PATH --conversations PATH --home PATH

Three tables, each written before the next reads it, all partitioned by record_type (document, page, conversation):
HOME/texts (every record's normalised text and its hash), HOME/records (one record of each text, with category,
importance, title, tools, tasks, summary, keywords and the number of its copies) and HOME/chunks (documents and pages by the strategy that fits them,
conversations by turns). Inputs that aren't given are left as they are: the partitions of the types that are built are overwritten
(dynamically), so a run can be repeated, or follow a failed one, with the same result.

Cases: a null text counts as empty; records without an id can't be referred to and are left out; turns without text are left out, so is a conversation
without any; of records with one text the smallest id stays; of rows that share an id the one with the largest text does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, main
from tessera.functions import fixed_values as V
from tessera.functions import text as T
from tessera.operators import chunking

KEY = ["record_type", "record_id"]


def document_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.lit("document").alias("record_type"), F.col("doc_id").alias("record_id"), "source", "text")


def page_texts(pages: DataFrame) -> DataFrame:
    """The visible text; a page's source is its host."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)
    return pages.select(F.lit("page").alias("record_type"), F.col("page_id").alias("record_id"), host.alias("source"), T.html_to_text(F.col("html")).alias("text"))


def spoken(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the turns that say something."""
    return conversations.where(T.strip(F.col("text")) != "").select("conv_id", "turn", T.or_default(F.col("role"), "unknown").alias("role"), "text")


def conversation_texts(conversations: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    talks = spoken(conversations).groupBy("conv_id").agg(turns.alias("turns"))
    return talks.select(F.lit("conversation").alias("record_type"), F.col("conv_id").alias("record_id"), F.lit("conversations").alias("source"), F.array_join("turns.line", "\n\n").alias("text"))


def texts_of(raw: DataFrame) -> DataFrame:
    """Each record once, with its hash."""
    body = F.coalesce("text", F.lit(""))
    rows = raw.where("record_id is not null").select(*KEY, T.or_default(F.col("source"), "unknown").alias("source"), body.alias("text"), F.sha2(body, 256).alias("text_sha256"))
    return rows.groupBy(*KEY).agg(F.max(F.struct("text", "source", "text_sha256")).alias("r")).select(*KEY, "r.source", "r.text", "r.text_sha256")


def records_of(texts: DataFrame) -> DataFrame:
    """One record of each text, enriched. Which ones stay is found from ids and hashes alone; a text with many copies is summed up before it is shuffled."""
    first = texts.groupBy("record_type", "text_sha256").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n_copies")).drop("text_sha256")
    x, low = F.col("text"), F.col("low")  # lowered once, not for each of the words that are looked for
    form = F.when(F.col("record_type") == "page", T.category(x, "takeout", low)).when(F.col("record_type") == "conversation", T.category(x, "factory", low)).otherwise(T.category(x, low=low))
    kept = texts.join(first, KEY).withColumn("low", F.lower(x)).withColumn("category", form)
    return kept.select(
        *KEY, "source", "category", T.importance(F.col("category"), x).alias("importance"), T.or_default(T.fallback_title(x), "Untitled").alias("title"), F.length(x).cast("long").alias("n_chars"), "n_copies",
        T.labels_found(x, V.TOOLS, low).alias("tools"), T.labels_found(x, V.TASKS, low).alias("tasks"), T.summary(x).alias("summary"), T.keywords(x).alias("keywords"), "text_sha256", x,
    )


def chunks_of(records: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """record_type, record_id, chunk_index, chunk_text, strategy, chunk_hash of the records."""
    shown = [*KEY, "chunk_index", "chunk_text", "strategy", "chunk_hash"]
    texts = records.where("record_type <> 'conversation'").withColumn("key", F.struct(*KEY))
    out = chunking.auto_chunk(texts, "key").select("key.*", "chunk_index", "chunk_text", "strategy", "chunk_hash")
    if conversations is not None:
        kept = records.where("record_type = 'conversation'").select(F.col("record_id").alias("conv_id"))
        turns = chunking.chunk_conversation(spoken(conversations).join(kept, "conv_id", "left_semi"), "conv_id")
        out = out.unionByName(turns.select(F.lit("conversation").alias("record_type"), F.col("conv_id").alias("record_id"), "chunk_index", "chunk_text", F.lit("conversation").alias("strategy"), F.sha2("chunk_text", 256).alias("chunk_hash")))
    return out.select(shown)


def write(df: DataFrame, path: str) -> DataFrame:
    """Overwrites the partitions of the record types that df holds, and reads the table."""
    wrote = Observation()
    df.observe(wrote, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("record_type").parquet(path)
    LOG.info("wrote %d rows to %s", wrote.get.get("rows", 0), path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, home: str, documents: str | None = None, pages: str | None = None, conversations: str | None = None) -> DataFrame:
    """Builds what is given and returns the archive's records, with the number of their chunks."""
    home, given = home.rstrip("/"), {"document": documents, "page": pages, "conversation": conversations}
    types = [t for t, path in given.items() if path]
    if not types:
        raise ValueError("give at least one of documents, pages, conversations")
    read = {t: spark.read.parquet(given[t]) for t in types}
    form = {"document": document_texts, "page": page_texts, "conversation": conversation_texts}
    built = F.col("record_type").isin(types)
    seen = {t: Observation() for t in types}  # counted by the pass that writes the texts
    texts = write(texts_of(reduce(DataFrame.unionByName, [form[t](read[t]).observe(seen[t], F.count("*").alias("rows")) for t in types])), f"{home}/texts")
    for t in types:
        LOG.info("read %d %ss from %s", seen[t].get.get("rows", 0), t, given[t])
    records = write(records_of(texts.where(built)), f"{home}/records")
    chunks = write(chunks_of(records.where(built), read.get("conversation")), f"{home}/chunks")
    counts = chunks.groupBy(*KEY).agg(F.count("*").alias("n_chunks"))
    return records.join(counts, KEY, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


if __name__ == "__main__":
    main(run, None, __doc__, "archive.json", ["documents", "pages", "conversations", "home"])
