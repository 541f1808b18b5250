"""ZIP members and activity pages."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .files import is_takeout_text

# The date form and prefixes of activity entries.
ENTRY_DATE = r"\d{1,2}\s+\w{3,9}\s+\d{4},\s+\d{2}:\d{2}:\d{2}\s+\w+"
PROMPT_PREFIX = r"^(?:Buscaste|Hiciste la petici[oó]n|You made the query|You asked)\s*"
TITLE_PREFIX = r"^(?:Modo IA|Aplicaciones de Gemini)\s*"
ENTRY_MARK, ENTRY_END = "outer-cell", "</div></div></div>"


# Which archives and members hold activity pages.
ARCHIVE_PATTERNS = ("takeout-*.zip", "*gemini*.zip")
PAGE_NAMES = ("gemini", "modo ia")
PIECE, LARGEST_BLOCK = 65_536, 500_000


BROKEN = (zipfile.BadZipFile, OSError, ValueError, KeyError, zlib.error, EOFError)  # what reading a damaged archive raises; ValueError: Arrow's files, at a place before their beginning


def opened(path: str) -> zipfile.ZipFile:
    """An archive by its path as Spark shows it (unescaped), read where it is asked for (directory at its end, then the members wanted): never as a whole."""
    fs, at = FileSystem.from_uri(quote(path, safe="/:@") if re.match(r"[a-z0-9+.-]+:/", path) else path)
    return zipfile.ZipFile(fs.open_input_file(at))


def archive_paths(spark: SparkSession, root: str, patterns: Iterable[str] = ("*.zip",)) -> DataFrame:
    """path of the archives under root whose names match a pattern, each once."""
    every = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select("path") for p in patterns]
    return reduce(DataFrame.unionByName, every).distinct()


def zip_names(archives: DataFrame) -> DataFrame:
    """archive, name, size of the members of archives (path), from their directories alone; broken archives have none."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as z:
                        found = [(path, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                except BROKEN:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["archive", "name", "size"])

    return archives.select("path").mapInArrow(listed, "archive string, name string, size long")


def _read(members: DataFrame, schema: str, rows: Callable[[zipfile.ZipFile, str, str], Iterator[pa.RecordBatch]], parts: int | None) -> DataFrame:
    """rows(archive, path, name) of each member, dealt out member by member, so that a large archive is read by many tasks. Members that can't be read give none."""
    dealt = members.select("archive", "name").repartition(*([parts] if parts else []), "archive", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with opened(path) as z:
                        yield from rows(z, path, name)
                except BROKEN:
                    continue

    return dealt.mapInArrow(run, schema)


def zip_contents(members: DataFrame, parts: int | None = None) -> DataFrame:
    """archive, name, content of members (archive, name): one whole member in memory at a time."""

    def whole(z: zipfile.ZipFile, path: str, name: str) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.large_binary()).cast(pa.binary())], ["archive", "name", "content"])

    return _read(members, "archive string, name string, content binary", whole, parts)


def zip_members(spark: SparkSession, root: str) -> DataFrame:
    """archive, name, content of all members of the ZIP files under root."""
    return zip_contents(zip_names(archive_paths(spark, root)))


def text_members(members: DataFrame) -> DataFrame:
    """Of the members (archive, name) those that hold conversations by their names; of an archive without such ones, every .json, marked as a guess."""
    named = members.where(is_takeout_text(F.col("name")))
    others = members.where(F.col("name").endswith(".json")).join(named.select("archive").distinct(), "archive", "left_anti")
    return named.withColumn("guess", F.lit(False)).unionByName(others.withColumn("guess", F.lit(True)).select(*named.columns, "guess"))


def scan_blocks(pieces: Iterable[bytes], mark: bytes, end: bytes | None = None, most: int = LARGEST_BLOCK) -> Iterator[bytes]:
    """The parts of a stream that begin with a mark: up to the next mark, or through the end mark if that is nearer, cut at `most` bytes. Marks may lie across pieces; at most one block and one piece are held."""
    held, inside, reach = b"", False, max(len(mark), len(end or b""))
    for piece in pieces:
        at = max(0, len(held) - reach + 1)  # what was searched before holds no whole mark
        held += piece
        while True:
            if not inside:
                start = held.find(mark, at)
                if start < 0:
                    held = held[-(len(mark) - 1) :] if len(mark) > 1 else b""
                    break
                held, inside, at = held[start:], True, len(mark)
            following, closing = held.find(mark, max(at, len(mark))), held.find(end, at) if end else -1
            stops = [following] * (following >= 0) + [closing + len(end or b"")] * (closing >= 0)
            if stops or len(held) >= most:
                stop = min([*stops, most])
                yield held[:stop]
                held, inside, at = held[stop:], False, 0
            else:
                break
    if inside:
        yield held


def page_blocks(members: DataFrame, mark: str, end: str | None = None, most: int = LARGEST_BLOCK, parts: int | None = None) -> DataFrame:
    """archive, name, n, block: members (archive, name) as the blocks that begin with a mark, streamed in pieces of 64 KiB, however large a member is."""

    def cut(z: zipfile.ZipFile, path: str, name: str) -> Iterator[pa.RecordBatch]:
        with z.open(name) as f:
            for n, block in enumerate(scan_blocks(iter(lambda: f.read(PIECE), b""), mark.encode(), end and end.encode(), most)):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([n], pa.int64()), pa.array([block.decode("utf-8", "replace")])], ["archive", "name", "n", "block"])

    return _read(members, "archive string, name string, n long, block string", cut, parts)


def activity_records(spark: SparkSession, root: str) -> DataFrame:
    """archive, name, date, prompt, response of the activity pages in the archives under root."""
    pages = zip_names(archive_paths(spark, root, ARCHIVE_PATTERNS)).where(reduce(lambda a, b: a | b, (F.lower("name").contains(n) for n in PAGE_NAMES)) & F.col("name").endswith(".html"))
    return entries(page_blocks(pages, ENTRY_MARK, ENTRY_END).withColumnRenamed("block", "b"), ["archive", "name"])


def export_json_array(rows: DataFrame, path: str, files: int = 1) -> None:
    """Writes rows as JSON arrays, one a file; as many files as asked for."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            for line in b.column(1).to_pylist():
                if line is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + line])], ["value"])
                    first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    lines = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int").alias("file"), F.to_json(F.struct("*")).alias("value"))
    every = lines.unionByName(rows.sparkSession.range(files).select(F.col("id").cast("int").alias("file"), F.lit(None).cast("string").alias("value")))  # each file has a row, so that there is a file
    every.repartitionById(files, F.col("file")).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def blocks(html: Column, mark: str = ENTRY_MARK) -> Column:
    """The parts of a page that begin with a mark."""
    parts = F.split(html, rf"(?=\Q{mark}\E)")
    return F.filter(parts, lambda p: p.startswith(mark))


def activity_entries(df: DataFrame, html: str = "html") -> DataFrame:
    """date, prompt, response of each entry of an activity page."""
    return entries(df.select(F.explode(blocks(F.col(html))).alias("b")), [])


def entries(df: DataFrame, keep: list[str]) -> DataFrame:
    """date, prompt, response of blocks (b); too short prompts (5) and responses (10) don't count."""
    e = df.withColumn("date", F.regexp_extract("b", f"({ENTRY_DATE})", 1)).where("date <> ''")
    at = F.position(F.col("date"), F.col("b"))
    before, after = F.substring(F.col("b"), F.lit(1), at - 1), F.substring(F.col("b"), at + F.length("date"), F.length("b"))
    header = F.regexp_extract(before, r"(?s)^.*?<br>\s*</p>", 0)
    body = F.substring(before, F.length(header) + 1, F.length(before))
    prompt = T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"&\w+;", " "), r"\s+", " "))
    prompt = F.regexp_replace(F.regexp_replace(prompt, PROMPT_PREFIX, ""), TITLE_PREFIX, "")
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(after, r"^\s*<br[^>]*>", ""), r"<[^>]+>", "\n"), r"&\w+;", " "), "\n"), T.strip)
    response = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return e.select(*keep, "date", prompt.alias("prompt"), response.alias("response")).where((F.length("prompt") >= 5) & (F.length("response") >= 10))
