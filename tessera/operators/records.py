"""The archive model over the tables at hand, and relational operators on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table

AS_OF = "2024-02-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as content records: doc_id, source, lang, text, title, category, importance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("category", T.category(F.col("text")))
    return docs.withColumns({"importance": T.importance(F.col("category"), F.col("text")), "title": T.title_heuristic(F.col("text"), F.col("category"))})


def dated(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """df with created_at (an event's time stands in)."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    return df.join(times, "doc_id")


# The metadata keys whose text belongs to a record's.
TEXT_KEYS = ("content", "text", "description", "summary", "body")


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def metadata_text(metadata: Column) -> Column:
    """array of the texts under the known keys of a JSON object: strings above 50 characters, and lists, their first ten items as lines."""
    m = F.try_parse_json(metadata)
    item = lambda x: F.coalesce(_string(x), F.try_variant_get(x, "$", "string"), F.to_json(x))
    items = lambda k: F.try_variant_get(m, f"$.{k}", "array<variant>")
    value = lambda k: _string(F.try_variant_get(m, f"$.{k}", "variant"))
    part = lambda k: F.when(F.length(value(k)) > 50, value(k)).when(F.size(items(k)) > 0, F.array_join(F.transform(F.slice(items(k), 1, 10), item), "\n"))
    return F.array_compact(F.array(*map(part, TEXT_KEYS)))


def line_texts(lines: DataFrame) -> DataFrame:
    """path, external_id, said of JSON lines (path, number, line): the messages of each id's first line in a file, as `role: content` lines. Lines without an id go by their number."""
    v = F.col("v")
    first_of = lambda m, *keys: F.coalesce(*[F.nullif(F.try_variant_get(m, f"$.{k}", "string"), F.lit("")) for k in keys])
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("messages", "turns")]
    messages = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))
    parts = lambda m: F.try_variant_get(m, "$.content", "array<variant>")
    content = lambda m: F.when(parts(m).isNotNull(), F.array_join(F.transform(parts(m), lambda x: F.coalesce(_string(x), F.to_json(x))), " ")).otherwise(first_of(m, "content", "text"))
    said = F.array_join(F.filter(F.transform(messages, lambda m: F.concat(F.coalesce(first_of(m, "role"), F.lit("unknown")), F.lit(": "), F.nullif(content(m), F.lit("")))), lambda x: x.isNotNull()), "\n")
    parsed = lines.withColumn("v", F.try_parse_json(F.trim("line"))).where(v.isNotNull())
    each = parsed.select("path", "number", F.coalesce(first_of(v, "id", "conversation_id"), F.concat(F.lit("line_"), F.col("number").cast("string"))).alias("external_id"), said.alias("said"))
    return each.groupBy("path", "external_id").agg(F.min_by("said", "number").alias("said"))


def with_text(records: DataFrame, lines: DataFrame | None = None, *, key: str = "record_id") -> DataFrame:
    """key, record_text of records (title, category, metadata as JSON; path and external_id where lines are given).

    A content_text above 20 characters is the text. Else it is made of the title, the category, the texts of the metadata, what the record's
    line in its file says (lines: path, number, line) and the preview, with blank lines between. Only lines of files that such records name are
    parsed, and only ids that they name are joined; Spark sends the wanted ones to the lines' scan where they are few, or a Bloom filter of them."""
    own = _string(F.try_variant_get(F.try_parse_json("metadata"), "$.content_text", "variant"))
    rows = records.withColumn("__own", F.when(F.length(own) > 20, own))
    if lines is None:
        rows = rows.withColumn("said", F.lit(None).cast("string"))
    else:
        wanted = rows.where("__own is null and path like '%jsonl%'").select("path", F.col("external_id").cast("string").alias("external_id"))
        found = line_texts(lines.join(wanted.select("path").distinct(), "path", "left_semi")).join(wanted.distinct(), ["path", "external_id"], "left_semi")
        rows = rows.withColumn("external_id", F.col("external_id").cast("string")).join(found, ["path", "external_id"], "left")
    preview = _string(F.try_variant_get(F.try_parse_json("metadata"), "$.content_preview", "variant"))
    head = lambda name, c: F.concat(F.lit(f"{name}: "), F.nullif(F.col(c), F.lit("")))
    parts = F.concat(F.array(head("Title", "title"), head("Category", "category")), F.coalesce(metadata_text(F.col("metadata")), F.array().cast("array<string>")), F.array(F.nullif(F.col("said"), F.lit("")), preview))
    return rows.select(key, F.coalesce("__own", F.array_join(F.array_compact(parts), "\n\n")).alias("record_text"))


def keep_first(df: DataFrame, signature: list[Column], order: list[Column]) -> DataFrame:
    """One row a signature, the first in order."""
    w = Window.partitionBy(*signature).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def among(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def recent(df: DataFrame, days: int, top: int, time: str = "created_at", key: str = "doc_id") -> DataFrame:
    return df.where(F.col(time) >= F.date_sub(F.lit(AS_OF[:10]).cast("date"), days)).orderBy(F.desc(time), key).limit(top)


def detail(recs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each record with its chunks in order."""
    parts = chunks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]).alias("chunks"))
    return recs.join(parts, key, "left")


def turn_offsets(conversations: DataFrame) -> DataFrame:
    """Running character offset of each turn's `role: text` line."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("role") + F.length("text") + 3
    return conversations.select("conv_id", "turn", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias("start"), size.cast("long").alias("n_chars"))


def answer_context(passages: DataFrame, most: int = 8, chars: int = 500) -> DataFrame:
    """query_id, context: the passages that a prompt would hold, in order of rank (query_id, rank, source, text)."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.or_default(F.col("source"), "unknown"), F.lit(": "), F.left("text", F.lit(chars)))
    rows = passages.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"))
    return rows.select("query_id", F.array_join(F.transform("ps", lambda p: p["p"]), "\n\n").alias("context"))


# What stands in a profile where nothing has been filled in, and the fields that are told, with their labels.
PLACEHOLDERS = ("your name", "your location", "your timezone", "your gpu", "your ram", "your sbc", "your project", "your project 1", "your project 2", "your ram_system", "your hardware")
PROFILE_FIELDS = {"name": "Name", "location": "Location", "timezone": "Timezone", "interests": "Interests", "hardware": "Hardware", "tools_used": "AI Tools Used", "projects": "Projects"}


def profile_text(profile: Column) -> Column:
    """What a profile (JSON: strings, lists of strings, an object of strings) tells: a line a field, without what is empty or still a placeholder; '' if nothing is."""
    p = F.try_parse_json(profile)
    real = lambda x: x.isNotNull() & (x != "") & ~F.lower(T.strip(x)).isin(*PLACEHOLDERS)
    told = lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"])

    def line(field: str, label: str) -> Column:
        whole = F.try_variant_get(p, f"$.{field}", "variant")
        items = F.array_join(F.filter(F.try_variant_get(p, f"$.{field}", "array<string>"), real), ", ")
        parts = F.array_join(F.transform(F.array_sort(F.filter(F.map_entries(F.try_variant_get(p, f"$.{field}", "map<string,string>")), lambda e: real(e["value"]))), told), "; ")
        kind = F.schema_of_variant(whole)
        text = F.when(kind == "STRING", F.when(real(_string(whole)), _string(whole))).when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), parts)
        return F.concat(F.lit(f"- {label}: "), F.nullif(text, F.lit("")))

    return F.array_join(F.array_compact(F.array(*[line(f, label) for f, label in PROFILE_FIELDS.items()])), "\n")


def passage_blocks(passages: DataFrame, chars: int = 420) -> DataFrame:
    """query_id, context: the passages (query_id, rank, source, title, created_at, text) in order of rank, each with its number and where it is from, as a local model is given them."""
    line = lambda label, c, default: F.concat(F.lit(f"{label}: "), T.or_default(F.col(c).cast("string"), default))
    block = F.concat_ws("\n", F.concat(F.lit("[Passage "), F.col("rank").cast("string"), F.lit("]")), line("Source", "source", "unknown"), line("Title", "title", "Untitled"), line("Created", "created_at", "unknown"), F.left(F.coalesce("text", F.lit("")), F.lit(chars)))
    rows = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("p")))).alias("ps"))  # a result list, bounded by its top_k
    return rows.select("query_id", F.array_join("ps.p", "\n\n").alias("context"))


def with_profile(contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """contexts (query_id, context) with the text of profiles (query_id, profile as JSON) before them, where there is one."""
    told = profiles.select("query_id", F.nullif(profile_text(F.col("profile")), F.lit("")).alias("told"))
    return contexts.join(told, "query_id", "left").select("query_id", F.concat_ws("\n\n", "told", "context").alias("context"))
