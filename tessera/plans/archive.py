"""The archive's batch jobs over a folder of Parquet tables: discover, classify, extract, chunk, embed, title, search, status.

Each job reads tables, builds one DataFrame and writes it; what is done is left out by anti-joins, so a job can be run again."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import chunking, lexical, quality, vector
from ..sources import archives, conversations, files

TABLES = ("source_files", "content_records", "content_chunks", "retrieval_metrics")
BATCHES = "batch_type string, started_at timestamp, completed_at timestamp, status string, files_processed long, files_skipped long, files_failed long, records_created long"


@dataclass
class Config:
    """root: where exports lie; sources: name -> glob pattern, or patterns, of file names; home: where tables lie."""

    root: str
    home: str
    sources: dict[str, str | list[str]] = field(default_factory=lambda: {"exports": "*"})
    chunk_size: int = 512
    least_chunk: int = 50

    def path(self, table: str) -> str:
        return f"{self.home}/{table}"

    def patterns(self) -> list[tuple[str, str]]:
        return [(name, p) for name, ps in self.sources.items() for p in ([ps] if isinstance(ps, str) else ps)]

    @classmethod
    def load(cls, path: str, environment: Mapping[str, str] = os.environ) -> Config:
        """From a JSON file; TESSERA_ROOT and TESSERA_HOME of the environment override its root and home."""
        given = json.loads(Path(path).read_text())
        return cls(**given | {k: environment[f"TESSERA_{k.upper()}"] for k in ("root", "home") if f"TESSERA_{k.upper()}" in environment})


def read(spark: SparkSession, config: Config, table: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(config.path(table))
    except AnalysisException:
        return None


def missing_tables(spark: SparkSession, config: Config) -> list[str]:
    return [t for t in TABLES if read(spark, config, t) is None]


def replace(df: DataFrame, config: Config, table: str) -> None:
    """Writes beside the old table, then takes its place, as df may read it. The old one stays aside until the new one is in place; read() finds it there."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(config.path(table) + "_new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new, aside = (hadoop(config.path(table) + end) for end in ("", "_new", "_old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):  # else a run that ended in between left only the one aside
        fs.delete(aside, True)
        fs.rename(old, aside)
    fs.rename(new, old)
    fs.delete(aside, True)


def run_discovery(spark: SparkSession, config: Config) -> DataFrame:
    """Files of every source; new and changed ones become pending. Returns counts by source_type and status."""
    found = None
    for name, pattern in config.patterns():
        part = files.discover(spark, config.root, pattern).withColumn("source_type", F.lit(name))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("path").agg(F.min_by(F.struct("size", "hash", "source_type"), "source_type").alias("f")).select("path", "f.*")
    old = read(spark, config, "source_files")
    if old is None:
        new = first.withColumn("status", F.lit("pending"))
    else:
        state = files.upsert(old, first)
        kept = first.unionByName(old.join(first.select("path"), "path", "left_anti").select("path", "size", "hash", "source_type"))
        new = kept.drop("hash").join(state, "path")
    replace(new.select("path", "size", "hash", "source_type", "status"), config, "source_files")
    read(spark, config, "source_files").write.mode("overwrite").json(config.path("manifest_json"))
    return read(spark, config, "source_files").groupBy("source_type", "status").agg(F.count("*").alias("n"))


def classification_report(manifest: DataFrame) -> DataFrame:
    """One row over the files that are pending or failed: how many, how many of them can be processed, and by which extractors."""
    f = files.classify(manifest.where(F.col("status").isin("pending", "failed")))
    return f.agg(F.count("*").alias("n_files"), F.count_if("processable").alias("n_processable"), F.count_if(~F.col("processable")).alias("n_others"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("processable"), F.col("extractor")))), "|").alias("extractors"))


def member_records(members: DataFrame) -> DataFrame:
    """Records of takeout archives' text members (archive, name, guess, content): JSON by its shape, pages as their text; JSON that can't be parsed as text, unless it was read as a guess."""
    m = members.where(~files.is_binary(F.col("content"))).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    is_json, path = F.lower("name").endswith(".json"), F.concat_ws("/", "archive", "name")
    parsed = F.try_parse_json("text").isNotNull()
    known = conversations.takeout_records(m.where(is_json & parsed).select(path.alias("path"), F.col("text").alias("line")))
    pages = m.where(~is_json | (~parsed & ~F.col("guess"))).select(path.alias("path"), path.alias("external_id"), F.lit("document").alias("record_type"), F.regexp_extract("name", r"([^/]+)$", 1).alias("title"), F.lit(None).cast("string").alias("created_at"), F.when(F.lower("name").endswith(".html"), T.html_to_text(F.col("text"))).otherwise(F.col("text")).alias("body"))
    document = F.array(F.struct(F.lit("document").alias("role"), F.col("body").alias("content"), F.lit(None).cast("string").alias("timestamp")))
    return known.unionByName(pages.withColumn("messages", document).withColumn("category", T.category(F.col("body"), "takeout")).drop("body"))


EXTRACTED = ["path", "external_id", "record_type", "title", "created_at", "category", "text"]
JSONL, NORMALIZED, FACTORY, QWEN, TEXT, TAKEOUT = "jsonl", "normalized", "factory", "qwen", "text", "takeout"


def file_of(path: Column) -> Column:
    """The file that a record's path lies in: an archive, for its members."""
    return F.when(path.contains(".zip/"), F.concat(F.substring_index(path, ".zip/", 1), F.lit(".zip"))).otherwise(path)


def form_of(path: Column, extractor: Column, source_type: Column) -> Column:
    """How a file is read: JSON lines of one of four forms, a text, a takeout archive; null: not at all."""
    low, source = F.lower(path), F.lower(F.coalesce(source_type, F.lit("")))
    jsonl = F.when(source.contains("factory") | low.contains("/.factory/"), FACTORY).when(source.contains("qwen") | low.rlike(r"/\.qwen/.*/chats/[^/]+$"), QWEN).when(low.contains("normalized") | low.contains("reap"), NORMALIZED).otherwise(JSONL)
    return F.when(extractor == "jsonl_extractor", jsonl).when(extractor == "text_extractor", TEXT).when(extractor == "takeout_extractor", TAKEOUT)


def extracted(spark: SparkSession, form: str, paths: list[str], root: str) -> DataFrame:
    """The records (EXTRACTED) of files of one form."""
    if form == TEXT:
        raw = spark.read.option("wholetext", "true").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        found = raw.withColumns({"external_id": F.col("path"), "record_type": F.lit("document"), "title": F.regexp_extract("path", r"([^/\\]+)$", 1), "created_at": F.lit(None).cast("string"), "category": F.lit("note")})
    elif form == TAKEOUT:
        names = archives.text_members(archives.zip_names(spark.createDataFrame([(p,) for p in paths], "path string")))
        content = archives.zip_contents(names).join(names.select("archive", "name", "guess"), ["archive", "name"])
        found = member_records(content).withColumn("text", conversations.joined(F.col("messages")))
    else:
        raw = conversations.lines(spark, paths)
        if form in (FACTORY, QWEN):
            sessions = conversations.event_sessions(raw, form, keep_session=True)
            if form == FACTORY:
                models = files.session_models(spark, root).withColumnRenamed("model", "set")
                sessions = sessions.join(models, F.regexp_replace(sessions["path"], r"\.jsonl$", "") == models["session"], "left").withColumn("model", F.coalesce("set", "model"))
            found = sessions.withColumns({"record_type": F.lit("conversation"), "created_at": F.get("messages", F.lit(0))["timestamp"], "text": F.col("content_text")})
        else:
            reader = conversations.normalized_records if form == NORMALIZED else conversations.jsonl_records
            found = reader(raw, "path").withColumn("text", conversations.joined(F.col("messages")))
    model = F.col("model") if "model" in found.columns else F.lit(None).cast("string")
    return found.select(*EXTRACTED, model.alias("model"), F.lit(form).alias("form"))


def run_extraction(spark: SparkSession, config: Config) -> DataFrame:
    """Pending and failed files to content_records, by the extractor that fits each; their files become ingested, skipped (nothing reads them) or failed (they have gone). Returns records by category.

    The list of due files comes to the driver once, as the readers' arguments. Records are counted by the pass that writes them (observe()), and
    the batch and its outcome are appended to ingestion_batches and put into workflow_state."""
    began = datetime.now(timezone.utc)
    there = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(config.root).select("path") for _, p in config.patterns()])
    manifest = read(spark, config, "source_files")
    for name, kind in (("metadata", "string"), ("record_count", "long"), ("chunk_count", "long")):
        manifest = manifest if name in manifest.columns else manifest.withColumn(name, F.lit(None).cast(kind))
    due = F.col("status").isin("pending", "failed")
    checked = files.classify_manifest(manifest, there)
    todo = files.classify(checked.where(due & F.col("error").isNull())).select("path", form_of(F.col("path"), F.col("extractor"), F.col("source_type")).alias("form"))
    rows = todo.collect()
    of = {f: sorted(r.path for r in rows if r.form == f) for f in sorted({r.form for r in rows if r.form})}
    created = 0
    if of:
        new = reduce(DataFrame.unionByName, [extracted(spark, form, paths, config.root) for form, paths in of.items()])
        seen = Observation()
        new = new.withColumn("record_id", F.xxhash64("path", "external_id")).withColumn("importance", T.importance(F.col("category"), F.col("text"))).withColumn("preview", F.left("text", F.lit(2000))).observe(seen, F.count("*").alias("records"))
        old = read(spark, config, "content_records")
        done = todo.where("form is not null").select("path")
        if old is not None:  # a file's own records, and those of an archive's members, which lie below its path
            new = old.withColumn("of", file_of(F.col("path"))).join(done.withColumnRenamed("path", "of"), "of", "left_anti").drop("of").unionByName(new, allowMissingColumns=True)
        replace(new, config, "content_records")
        created = seen.get.get("records", 0)
    records = read(spark, config, "content_records")
    now = F.when(due & F.col("error").isNull(), F.when(F.col("form").isNull(), "skipped").otherwise("ingested")).otherwise(F.col("status"))
    state = checked.join(todo, "path", "left").withColumn("status", now).drop("form")
    if records is not None:
        state = state.drop("record_count").join(records.groupBy(file_of(F.col("path")).alias("path")).agg(F.count("*").alias("record_count")), "path", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
    replace(state, config, "source_files")
    failed = read(spark, config, "source_files").where("error is not null and status = 'failed'").count()
    batch = spark.createDataFrame([("incremental", began, datetime.now(timezone.utc), "completed", sum(map(len, of.values())), sum(r.form is None for r in rows), failed, created)], BATCHES)
    batch.write.mode("append").parquet(config.path("ingestion_batches"))
    last = F.to_json(F.struct(F.col("completed_at").alias("timestamp"), "records_created"))
    batch.select(F.lit("last_ingestion").alias("key"), last.alias("value"), F.col("completed_at").alias("updated_at")).write.mode("overwrite").parquet(config.path("workflow_state"))
    return spark.createDataFrame([], "category string, n long") if records is None else records.groupBy("category").agg(F.count("*").alias("n"))


def run_chunking(spark: SparkSession, config: Config) -> DataFrame:
    """Records without chunks to content_chunks, by the strategy that fits each; source_files gets the number of each file's chunks. Returns chunks by strategy."""
    records, old = read(spark, config, "content_records"), read(spark, config, "content_chunks")
    todo = records if old is None else records.join(old.select("record_id"), "record_id", "left_anti")
    sources = read(spark, config, "source_files").select("path", "source_type")
    todo = todo.join(sources, "path", "left").select("record_id", "text", F.coalesce("source_type", F.lit("unknown")).alias("source"))
    new = chunking.chunk_records(todo, "record_id", size=config.chunk_size, least=config.least_chunk).where(F.length("chunk_text") > 20).withColumn("embedding_status", F.lit("pending"))
    new.write.mode("append").parquet(config.path("content_chunks"))
    chunks = read(spark, config, "content_chunks")
    counts = chunks.groupBy("record_id").agg(F.count("*").alias("n")).join(records.select("record_id", file_of(F.col("path")).alias("path")), "record_id").groupBy("path").agg(F.sum("n").alias("n"))
    manifest = read(spark, config, "source_files").drop("chunk_count")
    replace(manifest.join(counts, "path", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0))).drop("n"), config, "source_files")
    return chunks.groupBy("strategy").agg(F.count("*").alias("n"))


def run_embedding(spark: SparkSession, config: Config, model: Callable = vector.hash_model, name: str = "hash") -> DataFrame:
    """Chunks that are pending, or have failed, to chunk_embeddings (chunk, status, model, embedding, error, attempt). Returns one row: n embedded, n_failed."""
    chunks = read(spark, config, "content_chunks").select(F.concat_ws("/", "record_id", "chunk_index").alias("chunk"), "chunk_text")
    states = vector.embed_pending(chunks, config.path("chunk_embeddings"), "chunk", "chunk_text", model, name=name)
    return states.agg(F.count_if(F.col("status") == "embedded").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def titles(records: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, title of the records without a real one; of the first `limit` of them by id, if given."""
    todo = records.where("title is null or title = '' or title like '%Untitled%'")
    todo = todo if limit is None else todo.orderBy("doc_id").limit(limit)
    return todo.select("doc_id", T.title_heuristic(F.col("text"), F.col("category")).alias("title")).where("title is not null")


def enriched(records: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, tools, tasks, files, summary, keywords of records long enough."""
    t, low = F.col("text"), F.col("low")  # lowered once
    return records.where(F.length("text") >= least).withColumn("low", F.lower(t)).select("doc_id", T.labels_found(t, V.TOOLS, low).alias("tools"), T.labels_found(t, V.TASKS, low).alias("tasks"), T.files_named(t).alias("files"), T.summary(t).alias("summary"), T.keywords(t).alias("keywords"))


def enrich_pending(records: DataFrame, chunks: DataFrame, done: DataFrame, *, least: int = 50, first: int = 5) -> DataFrame:
    """enriched() of the records (doc_id, text) that are not among `done` (doc_id). A record of too little text goes by its first chunks (doc_id, chunk_index, chunk_text)."""
    todo = records.join(done.select("doc_id"), "doc_id", "left_anti")
    short = F.length(F.coalesce("text", F.lit(""))) < least
    parts = chunks.where(F.col("chunk_index") < first).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]), "\n").alias("parts"))
    return enriched(todo.join(parts, "doc_id", "left").withColumn("text", F.when(short, F.col("parts")).otherwise(F.col("text"))), least)


def find(records: DataFrame, as_of: Column, *, record_id: int | None = None, recent: int | None = None, category: str | None = None, query: str | None = None, source: str | None = None, days: int = 30, limit: int = 20) -> DataFrame:
    """doc_id, title, category, importance, created_at of what is asked for: one record, the recent ones, a category's, a query's, or those of the last week, in this precedence."""
    src = records.where(F.col("source") == source) if source else records
    since = lambda n: src.where(F.col("created_at") >= F.date_sub(as_of.cast("date"), n))
    shown = ["doc_id", "title", "category", "importance", "created_at"]
    if record_id is not None:
        return records.where(F.col("doc_id") == record_id).select(shown)
    if recent is None and category:
        return since(days).where(F.col("category") == category).orderBy(F.desc("importance"), F.desc("created_at"), "doc_id").limit(limit).select(shown)
    if recent is None and query:
        best = lexical.search_records(src, query, top_k=limit).select("doc_id", "rank")
        return src.join(F.broadcast(best), "doc_id").orderBy("rank").select(shown)  # at most `limit` rows
    return since(7 if recent is None else recent).orderBy(F.desc("created_at"), F.desc("importance"), "doc_id").limit(limit).select(shown)


def status(spark: SparkSession, config: Config, as_of: Column) -> dict[str, DataFrame | None]:
    """What the status pages show: counts, sources, recent records and quality, as DataFrames."""
    records, chunks, metrics = (read(spark, config, t) for t in ("content_records", "content_chunks", "retrieval_metrics"))
    return {
        "counts": records and records.agg(F.count("*").alias("n_records"), F.countDistinct("path").alias("n_files")),
        "chunks": chunks and chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("chunk_text")), 1).alias("avg_size")),
        "recent": records and records.select(F.left(T.or_default(F.col("title"), "Untitled"), F.lit(80)).alias("title"), T.or_default(F.col("category"), "unknown").alias("category"), T.display_date(F.col("created_at")).alias("created_at")).orderBy(F.desc("created_at")).limit(10),
        "quality": metrics and quality.report(metrics, as_of),
    }
