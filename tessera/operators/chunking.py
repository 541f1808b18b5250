"""Chunking strategies: chunk_index, chunk_text, start_char, end_char, strategy, chunk_hash for each chunk.

Texts are chunked over Arrow batches where they are read; nothing is shuffled. (The same as folds over arrays in the
JVM took 32 s for structure-aware chunks of 25 MB, as strings are copied at each step; this takes 2.) Turns
of a conversation are gathered and folded in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import fixed_values as V
from ..functions.text import SPACES, strip

Piece = tuple[str, int, int]

# Who speaks in a text with turns. (?a): as Spark's regular expressions, these know ASCII letters and spaces only.
ROLE = r"(?ai)(user|assistant|human|ai):"
TURN_START = r"(?ai)\n(?=(?:user|assistant|human|ai):\s)"


ROWS = 200  # that are cut at once


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, as each text is held as a string, as its chunks and as their column: of Spark's 10,000 rows, that is hundreds of MB a task."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _chunked(df: DataFrame, keep: list[str], text: str, strategy: str, cut: Callable[[str], Iterable[Piece]]) -> DataFrame:
    src = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    n = len(keep)
    schema = StructType([*src.schema.fields[:n], StructField("chunk_index", LongType()), StructField("chunk_text", StringType()), StructField("start_char", LongType()), StructField("end_char", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = [(r, i, *c) for r, t in enumerate(b.column(n).to_pylist()) for i, c in enumerate(cut(t))]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(n)), *(pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds))], schema.names)

    return src.mapInArrow(run, schema).withColumn("strategy", F.lit(strategy)).withColumn("chunk_hash", F.sha2("chunk_text", 256))


def slices(text: str, size: int, least: int) -> Iterator[Piece]:
    for at in range(0, len(text), size):
        piece = text[at : at + size].strip(SPACES)
        if len(piece) >= least:
            yield piece, at, min(at + size, len(text))


def fixed(text: str, size: int, least: int) -> Iterator[Piece]:
    if len(text) <= size:
        if len(text.strip(SPACES)) >= least:
            yield text.strip(SPACES), 0, len(text)
    elif len(text.strip(SPACES)) >= least:
        yield from slices(text, size, least)


def packed(parts: list[str], joiner: str, size: int, least: int) -> Iterator[Piece]:
    """Greedy packing: parts joined while they fit; a part that is too long stays whole. Offsets count the joined text."""
    held: list[str] = []
    n = at = 0

    def flushed() -> Iterator[Piece]:
        text = joiner.join(held)
        if len(text.strip(SPACES)) >= least:
            yield text.strip(SPACES), at, at + n

    for part in parts:
        if not n:  # an empty beginning isn't joined to
            held, n = [part], len(part)
        elif n + len(joiner) + len(part) <= size:
            held.append(part)
            n += len(joiner) + len(part)
        else:
            yield from flushed()
            at, held, n = at + n + len(joiner), [part], len(part)
    yield from flushed()


def recursive(text: str, size: int, least: int) -> Iterator[Piece]:
    if len(text) <= size or len(text.strip(SPACES)) < least:
        yield from fixed(text, size, least)
        return
    joiner = next((s for s in V.SEPARATORS if s in text), None)
    yield from packed(text.split(joiner), joiner, size, least) if joiner else slices(text, size, least)


def semantic(text: str, size: int, least: int) -> Iterator[Piece]:
    if len(text.strip(SPACES)) >= least:
        yield from packed([p for p in (p.strip(SPACES) for p in re.split(r"\n\s*\n", text)) if p], "\n\n", size, least)


def chunk_fixed(df: DataFrame, keep: list[str], text: str = "text", size: int = 512, least: int = 50) -> DataFrame:
    return _chunked(df, keep, text, "fixed", lambda t: fixed(t, size, least))


def chunk_recursive(df: DataFrame, keep: list[str], text: str = "text", size: int = 512, least: int = 50) -> DataFrame:
    """Splits at the first separator that occurs and packs the parts; without any, cuts by size."""
    return _chunked(df, keep, text, "recursive", lambda t: recursive(t, size, least))


def chunk_semantic(df: DataFrame, keep: list[str], text: str = "text", size: int = 512, least: int = 50) -> DataFrame:
    """Packs paragraphs (set apart by blank lines)."""
    return _chunked(df, keep, text, "semantic", lambda t: semantic(t, size, least))


def chunk_conversation(df: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text", most: int = 2000) -> DataFrame:
    """key, chunk_index, chunk_text, turn_count, roles: whole turns as `role: text` lines, flushed before a chunk would grow beyond `most`."""
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.col(text).alias("text"))))
    talks = df.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key).agg(said.alias("said"))
    kind = "array<struct<text:string,roles:array<string>>>"
    empty = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("roles"))
    flushed = lambda a: F.concat(a["out"], F.array(F.struct(strip(a["cur"]).alias("text"), a["roles"].alias("roles"))))

    def add(a: Column, m: Column) -> Column:
        line = F.concat(m["role"], F.lit(": "), m["text"], F.lit("\n"))
        full = (F.length(a["cur"]) + F.length(line) > most) & (F.size(a["roles"]) > 0)
        return F.struct(F.when(full, flushed(a)).otherwise(a["out"]).alias("out"), F.when(full, line).otherwise(F.concat(a["cur"], line)).alias("cur"), F.when(full, F.array(m["role"])).otherwise(F.concat(a["roles"], F.array(m["role"]))).alias("roles"))

    out = talks.select(key, F.posexplode(F.aggregate("said", empty, add, flushed)).alias("i", "c"))
    return out.select(key, F.col("i").cast("long").alias("chunk_index"), F.col("c.text").alias("chunk_text"), F.size("c.roles").cast("long").alias("turn_count"), F.array_join(F.array_sort(F.array_distinct("c.roles")), "|").alias("roles"))


def slide(text: str, size: int, overlap: int, least: int) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of windows that end at the best break in their last fifth."""
    if len(text.strip(SPACES)) < least:
        return
    if len(text) <= size:
        yield text.strip(SPACES), 0, len(text)
        return
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            floor = start + int(size * 0.8)
            found = ((text.rfind(b, floor, end), b) for b in V.BREAK_POINTS)
            end = next((at + len(b) for at, b in found if at > floor), end)
        piece = text[start:end].strip(SPACES)
        if len(piece) >= least:
            yield piece, start, end
        start = max(end - overlap, start + 1) if end < n else end


def chunk_sliding(df: DataFrame, key: str, text: str = "text", size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    return _chunked(df, [key], text, "sliding", lambda t: slide(t, size, overlap, least))


def chunk_strategy(text: Column, source: Column) -> Column:
    """The strategy that auto chunking picks."""
    spoken = source.isin(V.CONVERSATIONAL_SOURCES) & F.left(text, F.lit(500)).rlike(r"(?i)(user|assistant|human|ai):\s") & (F.regexp_count(text, F.lit(r"(?i)(?:^|\n)(user|assistant|human|ai):\s")) >= 2)
    return F.when(spoken, "conversation").when(F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s")) >= 3, "semantic").when((F.regexp_count(text, F.lit("```")) >= 4) | (source == "code"), "fixed").otherwise("recursive")


def spoken(text: str, most: int) -> Iterator[tuple[str, int, int, list[str]]]:
    """Whole turns of a text with `role: ` lines, packed like chunk_conversation() packs them; offsets count the packed turns."""
    turns = []
    for line in re.split(TURN_START, text):
        if found := re.match(ROLE, line):
            said = line[found.end() + 1 :] if re.match(r"\s", line[found.end() :], re.ASCII) else line
            turns.append((found[1].lower(), said.strip(SPACES)))
    held, roles, at, n = "", [], 0, 0
    for role, said in turns:
        if not said:
            continue
        line = f"{role}: {said}\n"
        if roles and len(held) + len(line) > most:
            yield held.strip(SPACES), at, n, roles
            held, roles, at = "", [], n
        held, n = held + line, n + len(line)
        roles.append(role)
    if held.strip(SPACES):
        yield held.strip(SPACES), at, n, roles


def pieces_of(strategy: str, text: str, size: int, overlap: int, least: int) -> Iterator[tuple[str, int, int, dict]]:
    """(text, start, end, metadata) of one text's chunks; strategies without a name here slide."""
    if strategy == "conversation":
        yield from ((t, a, b, {"turn_count": len(roles), "roles": sorted(set(roles))}) for t, a, b, roles in spoken(text, size))
    elif strategy == "semantic":
        yield from ((t, a, b, {"paragraph_count": t.count("\n\n") + 1}) for t, a, b in semantic(text, size, least))
    elif strategy == "recursive":
        cut = {"fallback": "character_split"} if len(text) > size and not any(x in text for x in V.SEPARATORS) else {}
        yield from ((t, a, b, cut) for t, a, b in recursive(text, size, least))
    else:
        slid = {} if strategy == "fixed" else {"overlap": overlap}
        cuts = fixed(text, size, least) if strategy == "fixed" else slide(text, size, overlap, least)
        yield from ((t, a, b, {"size": len(t)} | slid if len(text) > size else {}) for t, a, b in cuts)


STRATEGIES = ("fixed", "sliding", "recursive", "semantic", "conversation")


def chunk_records(df: DataFrame, key: str, text: str = "text", source: str = "source", strategy: Column | str = "auto", *, size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """key, chunk_index, chunk_text, start_char, end_char, strategy, metadata (JSON), chunk_hash. The strategy is a name, or a column with each row's: `auto` picks by text and source, unknown names slide. All rows are cut in one pass, where they are read."""
    name = F.coalesce(F.lit(strategy) if isinstance(strategy, str) else strategy, F.lit("auto"))
    body = F.coalesce(F.col(text), F.lit(""))
    known = F.when(name.isin(*STRATEGIES), name).when(name == "auto", chunk_strategy(body, F.coalesce(F.col(source), F.lit("unknown")))).otherwise("sliding")
    src = df.select(F.col(key), body.alias("__text"), known.alias("__strategy"))
    schema = StructType([src.schema.fields[0], StructField("chunk_index", LongType()), StructField("chunk_text", StringType()), StructField("start_char", LongType()), StructField("end_char", LongType()), StructField("strategy", StringType()), StructField("metadata", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = [(r, i, t, x, y, s, json.dumps(m)) for r, (whole, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for i, (t, x, y, m) in enumerate(pieces_of(s, whole, size, overlap, least))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds))], schema.names)

    return src.mapInArrow(run, schema).withColumn("chunk_hash", F.sha2("chunk_text", 256))


def auto_chunk(df: DataFrame, key: str, text: str = "text", source: str = "source", size: int = 512, least: int = 50) -> DataFrame:
    """Each row by the strategy that fits it: key, chunk_index, chunk_text, strategy, chunk_hash."""
    return chunk_records(df, key, text, source, size=size, least=least).select(key, "chunk_index", "chunk_text", "strategy", "chunk_hash")


def top_chunks(chunks: DataFrame, key: str, n: int = 12) -> DataFrame:
    return chunks.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("chunk_index"))).where(F.col("__n") <= n).drop("__n")
