"""A stored inverted index: built once, searched often, updated by what has changed.

One Parquet table of positional postings, partitioned by segment (one update each) and by bucket (a hash of the term). A document has one
more row, in a bucket of its own kind, that gives its length and the hash of its text; where an update
replaces an earlier version of a document, the row names the segment that it replaces, and readers leave that version's postings out. An
update writes one segment, by overwriting the partitions of its own number: repeated after a failure it changes nothing else. A search reads the
buckets of its terms, no text. compact() writes what is current as one segment elsewhere.

Terms are index_tokens() of the text; positions count them. A term as frequent as the corpus is large fills its bucket's files, not a task: the
rows of a bucket are dealt out by size when written, and added up before they are shuffled when read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import new_folder, read_if_there
from . import lexical

SCHEMA = "term string, doc_id long, dl long, tf long, positions array<int>, hash string, replaces int, replaced_dl long, segment int, bucket int"
COLUMNS = ["term", "doc_id", "dl", "tf", "positions", "hash", "replaces", "replaced_dl", "segment", "bucket"]
DOCUMENTS = -1  # the bucket of the documents' own rows
BROADCAST = 1_000_000  # terms at most that are sent to where the postings are read


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, home: str) -> DataFrame:
    return read_if_there(spark, home, SCHEMA)


def versions(index: DataFrame) -> DataFrame:
    """doc_id, old_segment, old_hash, old_dl of each document's latest version."""
    last = index.where(F.col("bucket") == DOCUMENTS).groupBy("doc_id").agg(F.max(F.struct("segment", "hash", "dl")).alias("v"))
    return last.select("doc_id", F.col("v.segment").alias("old_segment"), F.col("v.hash").alias("old_hash"), F.col("v.dl").alias("old_dl"))


def segment_rows(docs: DataFrame, earlier: DataFrame, segment: int, buckets: int) -> DataFrame:
    """The rows of a segment: those of documents (doc_id, text) that `earlier`, the index so far, lacks or has with another text. A null text counts as empty; documents without an id are left out; of rows that share one, the one with the largest text hash counts."""
    text = F.coalesce("text", F.lit(""))
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.sha2(text, 256).alias("hash"), text.alias("text"))).alias("d")).select("doc_id", "d.*")
    new = one.join(versions(earlier), "doc_id", "left").where("old_hash is null or old_hash <> hash")
    tokens = new.select("doc_id", "hash", "old_segment", "old_dl", T.index_tokens(F.col("text")).alias("tokens"))
    # the empty term stands for the document itself
    own = F.struct(F.lit("").alias("term"), F.lit(None).cast("array<int>").alias("positions"))
    rows = tokens.select("doc_id", "hash", "old_segment", "old_dl", F.size("tokens").cast("long").alias("dl"), F.inline(F.concat(F.array(own), postings_of(F.col("tokens")))))
    own = F.col("term") == ""
    return rows.select(
        "term", "doc_id", "dl", occurrences().alias("tf"), "positions", F.when(own, F.col("hash")).alias("hash"), F.when(own, F.col("old_segment")).alias("replaces"), F.when(own, F.col("old_dl")).alias("replaced_dl"),
        F.lit(segment).alias("segment"), F.when(own, DOCUMENTS).otherwise(bucket_of(F.col("term"), buckets)).alias("bucket"),
    )


def postings_of(tokens: Column) -> Column:
    """array of (term, positions) of one document's tokens: sorted by term, and cut where the next term begins. A document's tokens are in its row, so that nothing is grouped or shuffled."""

    def cut(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)))
        each = lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at)["term"].alias("term"), F.transform(F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at), lambda x: x["at"]).alias("positions")))
        return T.let(begins, each)

    return T.let(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at")))), cut)


def occurrences() -> Column:
    """tf of a row: a document's own counts as 1."""
    return F.when(F.col("positions").isNull(), 1).otherwise(F.size("positions")).cast("long")


def write_segment(rows: DataFrame, home: str) -> None:
    """Spark splits large buckets over several files (rebalance) and sorts by term, so that row groups can be skipped. What follows from other columns, or belongs to documents' own rows alone, isn't shuffled as columns."""
    of_document = ["hash", "replaces", "replaced_dl"]
    slim = rows.select("term", "doc_id", F.col("dl").cast("int").alias("dl"), "positions", F.when(F.col("bucket") == DOCUMENTS, F.struct(of_document)).alias("own"), "segment", "bucket")
    whole = slim.hint("rebalance", "bucket").withColumns({"dl": F.col("dl").cast("long"), "tf": occurrences()} | {c: F.col("own")[c] for c in of_document}).select(COLUMNS)
    dealt = whole.sortWithinPartitions("segment", "bucket", "term", "doc_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "bucket").parquet(home)


def update(docs: DataFrame, home: str, segment: int, *, buckets: int = 64) -> None:
    """Adds new and changed documents as segment `segment`, which must be above all earlier ones (or a repetition of the last)."""
    earlier = stored(docs.sparkSession, home).where(F.col("segment") < segment)
    write_segment(segment_rows(docs, earlier, segment, buckets), home)


def replaced(index: DataFrame) -> DataFrame:
    """doc_id, segment of versions that are no longer current."""
    return index.where((F.col("bucket") == DOCUMENTS) & F.col("replaces").isNotNull()).select("doc_id", F.col("replaces").alias("segment"))


def current(index: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The rows (all of the index, unless given) that belong to current versions. What is replaced is written first: Spark estimates it by the whole index's size otherwise, and shuffles all postings to leave out a few."""
    path = new_folder(index.sparkSession, "replaced")
    gone = replaced(index).withColumn("bucket", F.lit(DOCUMENTS))
    gone.write.partitionBy("bucket").parquet(path)
    return (index if rows is None else rows).join(index.sparkSession.read.schema(gone.schema).parquet(path).drop("bucket"), ["doc_id", "segment"], "left_anti")


def compact(spark: SparkSession, home: str, to: str) -> None:
    """Writes what is current to a new folder, as segment 0."""
    rows = current(stored(spark, home)).withColumns({"replaces": F.lit(None).cast("int"), "replaced_dl": F.lit(None).cast("long"), "segment": F.lit(0)})
    write_segment(rows.select(COLUMNS), to)


def of_terms(index: DataFrame, terms: DataFrame, buckets: int) -> DataFrame:
    """Current postings of the terms (column term), from their buckets' files only: the list of buckets that prunes them is as long as there are buckets at most."""
    known = terms.select("term").distinct()
    found = known.groupBy(bucket_of(F.col("term"), buckets).alias("b")).agg(F.count("*").alias("n")).collect()
    known = F.broadcast(known) if sum(r.n for r in found) <= BROADCAST else known  # else Spark, which knows no size of them, shuffles the buckets' postings
    read = index.where(F.col("bucket").isin([r.b for r in found])).join(known, "term", "left_semi")
    return current(index, read)


def statistics(index: DataFrame) -> DataFrame:
    """One row, n (documents), avgdl, from the documents' own rows."""
    less = lambda c: F.coalesce(c, F.lit(0))
    n, total = F.count("*") - F.count("replaces"), F.sum("dl") - F.sum(less(F.col("replaced_dl")))
    return index.where(F.col("bucket") == DOCUMENTS).agg(n.alias("n"), (total / n).alias("avgdl"))


def search(index: DataFrame, queries: DataFrame, *, buckets: int = 64, top_k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score by BM25, as lexical.bm25() gives from the texts."""
    asked = lexical.query_terms(queries)
    wanted = of_terms(index, asked, buckets).select("term", "doc_id", "dl", "tf")
    known = wanted.groupBy("term").agg(F.count("*").alias("df"))
    return lexical.okapi(wanted, known, statistics(index), asked, key="doc_id", top_k=top_k)


def with_phrase(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id of documents that hold the terms one after the other."""
    places = F.create_map(*[x for t in dict.fromkeys(phrase) for x in (F.lit(t), F.array(*[F.lit(i) for i, p in enumerate(phrase) if p == t]))])
    starts = F.flatten(F.transform(F.element_at(places, F.col("term")), lambda i: F.transform("positions", lambda p: p - i)))
    found = postings.where(F.col("term").isin(phrase)).select("doc_id", F.explode(starts).alias("start"))
    return found.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(phrase)).select("doc_id").distinct()


def match(index: DataFrame, *, any_of: list[str] = (), all_of: list[str] = (), phrases: list[list[str]] = (), none_of: list[str] = (), buckets: int = 64) -> DataFrame:
    """doc_id of documents that hold any term of any_of, all of all_of, each phrase, and none of none_of. Conditions left out hold; with none but none_of, that is all documents but those."""
    spark = index.sparkSession
    words = list(dict.fromkeys([*any_of, *all_of, *none_of, *(t for p in phrases for t in p)]))
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("term")) if words else None
    postings = of_terms(index, asked, buckets) if words else None
    parts = []
    if any_of:
        parts.append(postings.where(F.col("term").isin(list(any_of))).select("doc_id").distinct())
    if all_of:
        parts.append(postings.where(F.col("term").isin(list(all_of))).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(all_of))).select("doc_id"))
    parts += [with_phrase(postings, list(p)) for p in phrases]
    if not parts:
        parts.append(current(index, index.where(F.col("bucket") == DOCUMENTS)).select("doc_id"))
    out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), parts)
    if none_of:
        out = out.join(postings.where(F.col("term").isin(list(none_of))), "doc_id", "left_anti")
    return out
