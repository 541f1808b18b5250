"""File discovery, hashing, classification and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V

SUFFIX = r"(\.[^./\\]+)$"


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, hash (SHA-256) of the files under root whose names match; whole files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))


def classify(df: DataFrame, path: str = "path") -> DataFrame:
    """df with suffix, file_type, extractor, processable."""
    suffix = F.lower(F.regexp_extract(F.col(path), SUFFIX, 1))
    types = F.create_map(*[x for s, t in V.FILE_TYPES.items() for x in (F.lit(s), F.struct(F.lit(t[0]).alias("t"), F.lit(t[1]).alias("e"), F.lit(t[2]).alias("p")))])
    hit = F.element_at(types, suffix)
    takeout = (suffix == ".zip") & F.lower(F.regexp_extract(F.col(path), r"([^/\\]+)$", 1)).contains("takeout")
    return df.withColumns({"suffix": suffix, "file_type": F.coalesce(hit["t"], F.lit("unknown")), "extractor": F.when(takeout, "takeout_extractor").otherwise(F.coalesce(hit["e"], F.lit("none"))), "processable": F.coalesce(hit["p"], F.lit(False))})


def merge_json(metadata: Column, key: str, value: Column) -> Column:
    """A JSON object (or nothing) with the key set to a value; its other keys stay."""
    old = F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(F.to_json(value)))))


def classify_manifest(manifest: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The manifest (path, status, metadata as JSON) with `classification` in the metadata of pending and failed files, and error. Of these, files that are not among `found` (path) have failed."""
    c = classify(manifest)
    due = F.col("status").isin("pending", "failed")
    if found is None:
        c = c.withColumn("there", F.lit(True))
    else:
        c = c.join(found.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    verdict = F.struct("file_type", "extractor", "processable")
    lost = due & ~F.col("there")
    return c.select(*[x for x in manifest.columns if x not in ("status", "metadata", "error")], F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(lost, "File not found").alias("error"), F.when(due & F.col("there"), merge_json(F.col("metadata"), "classification", verdict)).otherwise(F.col("metadata")).alias("metadata"))


def session_logs(spark: SparkSession, root: str, form: str) -> DataFrame:
    """path of the session logs under root: of form `qwen` those right in a folder named chats."""
    logs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("path")
    return logs.where(F.col("path").rlike(r"/chats/[^/]+$")) if form == "qwen" else logs


def session_models(spark: SparkSession, root: str) -> DataFrame:
    """session (a log's path without its suffix), model from the settings beside session logs."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.settings.json").text(root)
    model = F.try_variant_get(F.try_parse_json("value"), "$.model", "string")
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.settings\.json$", "").alias("session"), F.coalesce(model, F.lit("unknown")).alias("model"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest (path, hash, status) after a discovery: new and changed files are pending, others keep their status."""
    was = old.select("path", F.col("hash").alias("old_hash"), F.col("status").alias("old_status"))
    status = F.when(F.col("old_hash").isNull() | (F.coalesce("hash", "old_hash") != F.col("old_hash")), "pending").otherwise(F.col("old_status"))
    return new.select("path", "hash").join(was, "path", "full_outer").select("path", F.coalesce("hash", "old_hash").alias("hash"), status.alias("status"))


def is_takeout_text(name: Column) -> Column:
    low = F.lower(name)
    suffix = F.regexp_extract(low, SUFFIX, 1)
    chat = low.rlike("conversation|chat|dialogue|assistant|aplicaciones de gemini")
    return suffix.isin(".html", ".json", ".md", ".txt") & (chat | (low.contains("gemini") & suffix.isin(".html", ".json", ".txt")) | low.endswith("miactividad.html"))


def is_binary(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 2048))
    zeros = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length(head), F.lit(2)), lambda i: F.substring(head, i, F.lit(2))), lambda b: b == "00"))
    return F.when(F.length(content) == 0, False).otherwise((F.substring(content, 1, 4) == F.lit(b"%PDF")) | (zeros > 4))


def text_files(spark: SparkSession, root: str, pattern: str = "*.{txt,md,markdown,patch}") -> DataFrame:
    """path, text: each whole file is one document record of category note."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit("document").alias("record_type"), F.lit("note").alias("category"))
