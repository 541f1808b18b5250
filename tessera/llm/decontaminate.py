"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

A window is `window` consecutive words of a test item (all words of a shorter item); windows that items share are one.
The corpus is read twice: to count the terms that the benchmark uses, and to write postings (term, document, position) of the two rarest
terms of each window, with one length posting a document; commoner terms have no postings. A window is looked up from its rarest
term: that term's list, adjusted by the term's offset, gives candidate places, which the list of the second rarest
term, adjusted likewise, confirms. Places that both lists agree on are compared word by word with the document (exact phrases): each
document's words are there once, however many places it has. Proximity matches use the lists alone.

Nothing is broadcast by hand: the vocabulary and window tables are written, so Spark knows their sizes
and joins them by shuffle when they are large.

Cases: null and empty texts have no words; items without words never occur; documents that repeat both id and
text have the same result each; a null item id can be hit but isn't among the items counted; ties in
rarity go to the earlier word; very long texts are read whole, and one word repeated has a place for each window and position only; other
columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, lower_ascii

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH = "\x00"  # stands for a document's length posting: no word holds it


def words(text) -> Column:
    """Runs of characters other than ASCII non-alphanumerics, in their own case."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def folded(word: Column) -> Column:
    """A-Z lower-cased, other letters left alone."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a row's key), item_id, words."""
    src = items.select(F.col(id_col).cast("string").alias("item_id"), F.transform(words(F.col(text_col)), folded).alias("words")).where(F.size("words") > 0).distinct()
    return src.select(F.sha2(F.to_json(F.struct("item_id", "words")), 256).alias("item"), "item_id", "words")


def build_index(docs: DataFrame, vocabulary: DataFrame, tables: Tables, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, id, h, pos) of the terms in vocabulary, which holds the length posting's (pos = number of words, one a row). A term is its word's 64-bit hash; h is the text's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.concat(words(text), F.array(F.lit(LENGTH))).alias("all"))  # below the explode, so once a document
    every = every.select("id", "h", F.posexplode("all").alias("pos", "w")).select(F.xxhash64(folded(F.col("w"))).alias("term"), "id", "h", "pos")
    return tables.keep(every.join(vocabulary, "term", "left_semi"))


def vocabulary_of(items: DataFrame) -> DataFrame:
    """term of all item words, and the length posting's: as many rows as the benchmark has different words."""
    return items.select(F.explode(F.concat("words", F.array(F.lit(LENGTH)))).alias("word")).select(F.xxhash64("word").alias("term")).union(items.sparkSession.range(1).select(F.xxhash64(F.lit(LENGTH)))).distinct()


def term_counts(docs: DataFrame, vocabulary: DataFrame, *, text_col: str = "text") -> DataFrame:
    """term, n: occurrences in all texts, counted before the shuffle."""
    every = docs.select(F.explode(words(F.col(text_col))).alias("w")).select(F.xxhash64(folded(F.col("w"))).alias("term"))
    return every.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, win (a hash), words of the windows of each item."""
    width = F.least(F.size("words"), F.lit(window))
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda s: F.slice("words", s, width)))
    return items.select("item_id", F.explode(each).alias("words")).distinct().withColumn("win", F.xxhash64("words"))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, width, pos0, term0, pos1, term1: the two rarest terms (one twice, if a window has one word) and their places, of each different window whose terms all occur."""
    each = windows.select("win", "words").distinct()
    at = each.select("win", F.size("words").alias("width"), F.posexplode("words").alias("pos", "word")).withColumn("term", F.xxhash64("word"))
    known = at.join(counts, "term", "left").groupBy("win", "width").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term"))).alias("terms")).where(F.col("terms")[0]["n"] > 0)
    pick = lambda i: [F.coalesce(F.get("terms", F.lit(i))[c], F.get("terms", F.lit(0))[c]).alias(f"{c}{i}") for c in ("pos", "term")]
    return known.select("win", "width", *pick(0), *pick(1))


def places(rarest: DataFrame, index: DataFrame) -> DataFrame:
    """win, width, id, h, at: where both rarest terms of a window stand as they would if it began at position `at`."""
    first = index.join(rarest.withColumnRenamed("term0", "term"), "term").select("win", "width", "id", "h", (F.col("pos") - F.col("pos0")).alias("at"), "pos1", "term1").where("at >= 0")
    wanted = first.withColumn("pos", F.col("at") + F.col("pos1"))
    there = wanted["id"].eqNullSafe(index["id"]) & (wanted["h"] == index["h"]) & (wanted["pos"] == index["pos"]) & (wanted["term1"] == index["term"])
    return wanted.join(index, there, "left_semi").select("win", "width", "id", "h", "at").distinct()


def phrase_matches(docs: DataFrame, windows: DataFrame, found: DataFrame, tables: Tables, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of each document with an occurrence: (id, h, spans = array of (at, end), n_hit words inside them); and (id, h, item_id) of the items."""
    grams = windows.select("win", F.array_join("words", " ").alias("gram")).distinct()
    per = found.join(grams, "win").groupBy("id", "h").agg(F.collect_list(F.struct("at", (F.col("at") + F.col("width")).alias("end"), "gram")).alias("tries"))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    both = src.join(per.withColumnsRenamed({"id": "id2", "h": "h2"}), src["id"].eqNullSafe(F.col("id2")) & (src["h"] == F.col("h2"))).select("id", "h", F.array(F.transform(words(F.col("text")), folded)).alias("once"), "tries")
    # the words are bound to a lambda variable, or they'd be cut anew for each try
    same = lambda w: F.filter("tries", lambda t: F.array_join(F.slice(w, t["at"] + 1, t["end"] - t["at"]), " ") == t["gram"])
    true = tables.keep(both.select("id", "h", F.transform("once", same)[0].alias("tries")).where(F.size("tries") > 0).dropDuplicates(["id", "h"]))
    spans = F.array_sort(F.transform("tries", lambda t: F.struct(t["at"].alias("at"), t["end"].alias("end"))))  # all different, as places are
    # each span in turn adds what reaches beyond the spans before it
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")), lambda a, s: F.struct(F.greatest(a["reach"], s["end"]).alias("reach"), (a["n"] + F.greatest(s["end"] - F.greatest(a["reach"], s["at"]), F.lit(0))).alias("n")))["n"]
    hits = true.select("id", "h", spans.alias("spans")).withColumn("n_hit", covered.cast("long"))
    theirs = true.select("id", "h", F.explode(F.array_distinct(F.transform("tries", lambda t: t["gram"]))).alias("gram"))
    items = theirs.join(windows.select("item_id", F.array_join("words", " ").alias("gram")), "gram").select("id", "h", "item_id").distinct()
    return hits, items


def proximity_matches(items: DataFrame, index: DataFrame, *, within: int) -> DataFrame:
    """item, id, h, pos: places of an item's rarest word at which all its other words occur within `within` positions."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = items.select("item", F.explode(F.array_distinct("words")).alias("word")).withColumn("term", F.xxhash64("word"))
    ranked = terms.join(counts, "term", "left").groupBy("item").agg(F.count("*").alias("size"), F.min(F.struct(F.coalesce("n", F.lit(0)), "term"))["term"].alias("rarest"), F.collect_list("term").alias("terms"))
    anchors = index.join(ranked, index["term"] == ranked["rarest"]).select("item", "size", "terms", "id", "h", "pos")
    wanted = anchors.select("item", "size", "id", "h", "pos", F.explode("terms").alias("term"))
    there = index.withColumnsRenamed({"term": "t2", "id": "id2", "h": "h2", "pos": "p2"})
    near = wanted.join(there, (F.col("term") == F.col("t2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.abs(F.col("pos") - F.col("p2")) <= within))
    return near.groupBy("item", "size", "id", "h", "pos").agg(F.countDistinct("term").alias("n")).where("n = size").select("item", "id", "h", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, h (text hash), n_words, n_hit, n_items, items_sha256, contaminated and spans (word positions) of each row."""
    tables = Tables(docs.sparkSession, "index")
    windows = tables.keep(windows_of(item_words(benchmark, item_id_col, item_text_col), window))
    counts = tables.keep(term_counts(docs, tables.keep(windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct()), text_col=text_col))
    rarest = tables.keep(rarest_terms(windows, counts))
    length = F.xxhash64(F.lit(LENGTH))
    vocabulary = tables.keep(rarest.select(F.explode(F.array("term0", "term1", length)).alias("term")).union(docs.sparkSession.range(1).select(length)).distinct())
    index = build_index(docs, vocabulary, tables, id_col=id_col, text_col=text_col)
    found = tables.keep(places(rarest, index.where(F.col("term") != length)))
    hits, theirs = phrase_matches(docs, windows, found, tables, id_col=id_col, text_col=text_col)
    ids = theirs.groupBy("id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ids = ids.select(F.col("id").alias("i2"), F.col("h").alias("h2"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    found = hits.join(ids, hits["id"].eqNullSafe(F.col("i2")) & (hits["h"] == F.col("h2"))).select(F.col("id").alias("id2"), F.col("h").alias("hh"), "spans", "n_hit", "n_items", "items_sha256")
    rows = index.where(F.col("term") == length).select("id", "h", F.col("pos").cast("long").alias("n_words"))
    found = tables.keep(found)
    tables.only(index, found)
    out = rows.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("hh")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "h", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"))
