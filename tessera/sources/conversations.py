"""Tolerant readers of conversation exports: lines of JSON to records (external_id, title, created_at, updated_at, category, messages).

Lines are parsed to VARIANT, so any shape is read; what a key holds is decided per record. Malformed lines and
messages are dropped, not their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGES = "array<struct<role:string,content:string,timestamp:string>>"


def lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """line (text), path, number (from 1, within a file).

    Files are read in splits. A first pass counts the lines of each split; the splits before it in its file give where its own begin,
    and within a split lines are numbered as they are read. So a large file is numbered by all its tasks, and no line is shuffled."""
    raw = spark.read.options(**options).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.select("path", "start", "first", before.alias("before")), ["path", "start"]).select("line", "path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"))


def field(v: Column, *keys: str) -> Column:
    """The first non-empty of the keys, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys])


def time_field(v: Column, *keys: str) -> Column:
    """The first of the keys that holds a time: text, or a number of milliseconds."""
    return F.coalesce(*[T.iso_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in keys])


def flat_text(v: Column, key: str) -> Column:
    """Text under a key: a string, an object's text or content, or a list of these."""
    part = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(
        F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.try_variant_get(x, "$.description", "string").isNotNull() & F.try_variant_get(x, "$.subject", "string").isNotNull(), "").otherwise(F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit("")))))
    items = F.try_variant_get(v, f"$.{key}", "array<variant>")
    whole = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(items.isNotNull(), F.array_join(F.filter(F.transform(items, part), lambda x: x != ""), "\n")).when(whole.isNotNull(), part(whole))


def read_messages(v: Column, keys: tuple[str, ...], texts: tuple[str, ...]) -> Column:
    raw = F.coalesce(*[F.when(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")) > 0, F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in keys], F.array().cast("array<variant>"))
    text = lambda m: T.clean_message(F.coalesce(*[F.nullif(flat_text(m, k), F.lit("")) for k in texts], F.lit("")))
    one = lambda m: F.struct(F.coalesce(field(m, "role", "sender"), F.lit("unknown")).alias("role"), text(m).alias("content"), time_field(m, "timestamp", "createdAt").alias("timestamp"))
    return F.filter(F.transform(raw, one), lambda m: m["content"] != "")


def _records(parsed: DataFrame, ids: tuple[str, ...], prefix: str, titles: tuple[str, ...], created: tuple[str, ...], updated: tuple[str, ...], message_keys: tuple[str, ...], texts: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    v = F.col("v")
    out = parsed.where(v.isNotNull()).select(*keep, 
        F.coalesce(field(v, *ids), F.concat(F.lit(prefix), F.col("number").cast("string"))).alias("external_id"), F.lit("conversation").alias("record_type"), field(v, *titles).alias("title"),
        time_field(v, *created).alias("created_at"), time_field(v, *updated).alias("updated_at"), read_messages(v, message_keys, texts).alias("messages"), field(v, "source").alias("source"), field(v, "category").alias("given"),
    )
    return out.where(F.size("messages") > 0)


def parse(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.try_parse_json(F.trim("line")))


def joined(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), " ")


def jsonl_records(df: DataFrame, *keep: str) -> DataFrame:
    """Generic exports, from (line, number); columns to keep come along."""
    out = _records(parse(df), ("id", "conversation_id", "session_id"), "line_", ("title", "name", "session_title", "session_display_title"), ("created_at", "createdAt", "timestamp", "date"), ("updated_at", "updatedAt", "last_updated"), ("messages", "turns"), ("content", "text", "message"), keep)
    return out.withColumn("category", T.category(joined(F.col("messages")))).drop("given")


def normalized_records(df: DataFrame, *keep: str) -> DataFrame:
    """Normalised exports; a category given is kept."""
    out = _records(parse(df), ("conversation_id", "session_id", "id"), "norm_", ("title", "name"), ("timestamp", "created_at"), ("updated_at", "last_updated"), ("messages",), ("text",), keep)
    return out.withColumn("category", F.coalesce("given", T.category(joined(F.col("messages")), "normalized"))).drop("given")


def event_sessions(df: DataFrame, form: str, session: str = "path", *, keep_session: bool = False) -> DataFrame:
    """Event logs, one session a file, from (line, number, path): form `factory` or `qwen`. Events are grouped by session: a session is one user's. keep_session adds its path and model."""
    v = F.col("v")
    src = parse(df).where(v.isNotNull()).select(F.col(session).alias("session"), "number", "v", field(v, "type").alias("type"))
    if form == "factory":
        kept = (F.col("type") == "message") & ~((F.coalesce(field(v, "message.visibility"), F.lit("")) == "user_only") & (F.coalesce(field(v, "message.role"), F.lit("unknown")) != "user"))
        text = F.coalesce(flat_text(v, "message.content"), F.lit(""))
        text = F.when((F.length(text) > 500) & text.contains("</system-reminder>"), T.strip_reminder(text)).otherwise(text)
    else:
        kept = F.col("type").isin("user", "assistant")
        parts = F.coalesce(F.try_variant_get(v, "$.message.parts", "array<variant>"), F.array().cast("array<variant>"))
        one = lambda p: T.strip(T.strip_reminder(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))))
        text = F.array_join(F.filter(F.transform(parts, one), lambda t: t != ""), "\n")
    results = F.coalesce(F.size(F.try_variant_get(v, "$.message.toolResults", "array<variant>")), F.lit(0))
    said = src.withColumn("text", text).withColumn("role", F.coalesce(field(v, "message.role"), F.col("type") if form == "qwen" else F.lit("unknown")))
    message = F.when(kept & (T.strip(F.col("text")) != ""), F.struct("number", "role", F.col("text").alias("content"), field(v, "timestamp").alias("timestamp")))
    head = F.when(F.col("type") == "session_start", F.struct("number", field(v, "title", "sessionTitle").alias("title"), field(v, "cwd").alias("cwd")))
    talks = said.groupBy("session").agg(F.array_sort(F.collect_list(message)).alias("m"), F.max(head).alias("head"), F.sum(F.when(kept, F.greatest(results, F.lit(0))).otherwise(0)).alias("n_tool_results"), F.max(field(v, "model")).alias("model"))
    talks = talks.where(F.size("m") > 0)
    first = F.get(F.filter("m", lambda m: m["role"] == "user"), F.lit(0))["content"]
    name = F.regexp_extract("session", r"([^/\\]+?)(?:\.jsonl)?$", 1)
    body = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")
    category = T.category(F.array_join(F.transform("m", lambda m: m["content"]), " "), form)
    if form == "qwen":
        category = F.when((category == "chat") & (F.col("n_tool_results") > 0), "tool").otherwise(category)
    title = F.coalesce(F.col("head.title"), F.nullif(T.strip(F.left(first, F.lit(100 if form == "factory" else 120))), F.lit("")), name)
    more = [F.col("session").alias("path"), "model"] if keep_session else []
    return talks.select(*more, name.alias("external_id"), title.alias("title"), category.alias("category"), body.alias("content_text"), F.size("m").cast("long").alias("n_messages"), "n_tool_results", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp"))).alias("messages"))


def list_items(path: Column, document: Column, depth: int = 64) -> Column:
    """array of (at, v): what the lists of a VARIANT document hold, however they are nested (`depth` levels at most), each with its place, path[i][j]..."""
    inner = lambda x: F.try_variant_get(x["v"], "$", "array<variant>")
    member = lambda x: F.transform(inner(x), lambda v, i: F.struct(F.concat(x["at"], F.lit("["), i.cast("string"), F.lit("]")).alias("at"), v.alias("v")))
    opened = lambda items: F.flatten(F.transform(items, lambda x: F.when(_is(x["v"], "ARRAY"), member(x)).otherwise(F.array(x))))
    step = lambda items: F.when(F.exists(items, lambda x: _is(x["v"], "ARRAY")), opened(items)).otherwise(items)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.struct(path.alias("at"), document.alias("v"))), lambda items, _: step(items))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def long_strings(v: Column, least: int = 50) -> Column:
    """`key: value` of an object's strings above so many characters, its own and those of the objects right in it, by key."""
    entries = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    told = lambda e: F.concat(e["key"], F.lit(": "), F.try_variant_get(e["value"], "$", "string"))
    is_long = lambda e: _is(e["value"], "STRING") & (F.length(F.try_variant_get(e["value"], "$", "string")) > least)
    below = lambda e: F.transform(F.filter(F.coalesce(entries(e["value"]), F.array().cast("array<struct<key:string,value:variant>>")), is_long), told)
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(entries(v), lambda e: F.when(is_long(e), F.array(told(e))).when(_is(e["value"], "OBJECT"), below(e)).otherwise(none)))


def takeout_records(df: DataFrame) -> DataFrame:
    """Takeout JSON documents (line, path), of objects in lists nested in any way: conversations, one conversation, a search, or any long strings. What has no id of its own goes by its place."""
    v = F.col("v")
    items = parse(df).where(v.isNotNull()).select("path", F.explode(list_items(F.col("path"), v)).alias("x")).select("path", F.col("x.at").alias("at"), F.col("x.v").alias("v")).where(_is(v, "OBJECT"))
    talks = F.try_variant_get(v, "$.conversations", "array<variant>")
    items = items.select("path", "at", F.explode_outer(talks).alias("talk"), "v", talks.isNotNull().alias("listed")).select("path", "at", F.when(F.col("listed"), F.col("talk")).otherwise(v).alias("v"), "listed").where(_is(v, "OBJECT"))
    raw = F.coalesce(*[F.when(F.size(m) > 0, m) for m in (F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.turns", "array<variant>"))], F.array().cast("array<variant>"))
    text = lambda m: F.coalesce(F.nullif(flat_text(m, "content"), F.lit("")), F.nullif(flat_text(m, "text"), F.lit("")), F.try_variant_get(m, "$.parts[0].text", "string"), F.lit(""))
    messages = F.filter(F.transform(raw, lambda m: F.struct(F.coalesce(field(m, "role", "sender"), F.lit("user")).alias("role"), text(m).alias("content"), field(m, "timestamp").alias("timestamp"))), lambda m: m["content"] != "")
    has = lambda *keys: reduce(lambda a, b: a | b, (F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in keys))
    strings = long_strings(v)
    kind = F.when(F.col("listed") | has("messages", "turns"), "conversation").when(has("event", "query"), "search").when(F.size(strings) > 0, "document")
    search = F.try_variant_get(v, "$.query.text", "string")
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(None).cast("string").alias("timestamp")))
    ident = F.coalesce(F.when(kind != "document", field(v, "id")), F.when(kind == "conversation", field(v, "conversationId")), F.col("at"))
    title = F.when(kind == "conversation", F.coalesce(field(v, "name", "title"), F.concat(F.lit("Conversation "), F.left(ident, F.lit(8))))).when(kind == "search", F.coalesce(search, F.lit("Search"))).otherwise(F.regexp_extract("at", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))
    when = F.when(kind == "search", field(v, "time")).when(kind == "conversation", field(v, "createTime", "created_at", "timestamp"))
    out = items.select("path", ident.alias("external_id"), kind.alias("record_type"), title.alias("title"), when.alias("created_at"), F.when(kind == "conversation", messages).when(kind == "search", one("user", F.coalesce(search, F.lit("")))).otherwise(one("document", F.array_join(strings, "\n"))).alias("messages"))
    return out.where(F.col("record_type").isNotNull()).withColumn("category", F.when(F.col("record_type") == "conversation", T.category(joined(F.col("messages")), "takeout")).otherwise("chat"))


def export_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)
