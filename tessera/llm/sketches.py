"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the k smallest different hashes of a text's shingles (five consecutive words; a text of fewer words, but not none, is one
shingle), in ascending order. The k smallest of a union of sketches are the sketch of the union, so parts of a text, or of a corpus, can
be sketched apart and merged (merge() in a row, merge_groups() over rows). Of two sketches the k smallest of their
union are a sample of both texts' shingles: the share of it that is in both estimates resemblance. The k-th smallest hash tells how
dense they are, hence the number of different shingles, and both together containment. Sketches of fewer than k hashes hold
all of them, so what they give is exact (but for collisions of 64 bits).

Hashes are the first 16 hex digits of MD5, which every engine has, so sketches made elsewhere can be merged with these. In order, hex strings
compare as the numbers do.

compare_with_edits() needs each document's successor by id. Sampled ranges of (id, text hash) cut the table into pieces of even size; a
piece's first row is sent to the end of the piece before it as well, so one shuffle of texts by piece, and a window over each, gives every row its
successor. The head of a text that an edit leaves alone is sketched once and merged with either tail.

Cases: a null text counts as empty; texts without words have the fingerprint '', like each other (1.0) and nothing else (0.0);
a null id comes before all others; rows that share an id follow each other by text hash, copies in any order; the successor of the last row (the only one, in
a table of one) is the first; very long texts are read whole; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
K, WORDS = 256, 5
DIGITS = 16
SPACE = float(16**DIGITS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for all its uses."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def digest(shingle: Column) -> Column:
    return F.left(F.md5(shingle), F.lit(DIGITS))


def hashes(words: Column, size: int = WORDS) -> Column:
    """The hashes of all shingles of an array of words."""
    one = lambda w, i: digest(F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)]))
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: one(w, i))
    return let(words, lambda w: F.when(F.size(w) >= size, every(w)).when(F.size(w) > 0, F.array(digest(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>")))


def lowest(values: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def sketch(text: Column, k: int = K, size: int = WORDS) -> Column:
    return lowest(hashes(words_of(F.coalesce(text, F.lit(""))), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return lowest(F.concat(a, b), k)


def merge_groups(df: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """by, sketch: the sketches of each group merged. Repeated hashes go before the shuffle, and Spark ranks within a task first, so a large group sends k hashes a task at most."""
    each = df.select(*by, F.explode(sketch_col).alias("__hash")).groupBy(*by, "__hash").agg(F.lit(1).alias("__one"))
    first = each.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))).where(F.col("__n") <= k)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("__hash")).alias(sketch_col))  # k hashes a group


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two texts' shingles."""
    common = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles: exact below k, else from how far the k-th smallest hash reaches."""
    high, low = (F.conv(F.substring(F.element_at(a, -1), at, DIGITS // 2), 16, 10).cast("double") for at in (1, DIGITS // 2 + 1))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((high * 16.0 ** (DIGITS // 2) + low + 1) / SPACE))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def cuts_of(rows: DataFrame, parts: int) -> list:
    """The smallest (id, key) of each of about `parts` ranges of even size, ascending. Only ids and hashes are shuffled; what comes to the driver is one pair a range."""
    ranged = rows.select("id", "key").repartitionByRange(parts, F.col("id").asc_nulls_first(), "key")
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "key")).alias("cut"))
    found = {(r.cut.id, r.cut.key) for r in least.collect()}
    return sorted(found, key=lambda c: (c[0] is not None, c[0] if c[0] is not None else 0, c[1]))


def piece_of(at: Column, cuts: Column, n: int) -> Column:
    """How many of n ascending cuts are not above `at`, less one: by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    middle = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    step = lambda a, m: F.when(a["lo"] >= a["hi"], a).when(F.get(cuts, m) <= at, F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, lambda a, _: step(a, middle(a)), lambda a: a["lo"] - 1)


def with_successor(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WindowSpec]:
    """id, text, piece, guest of each row, dealt out by piece, and the window in which lead() is the row after it. Guests end a window and are no rows of their own."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("key"))
    cuts = cuts_of(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, kind = len(cuts), rows.schema["id"].dataType.simpleString()
    table = F.from_json(F.lit(json.dumps([{"id": i, "key": k} for i, k in cuts], default=str)), f"array<struct<id:{kind},key:string>>")
    at = F.struct("id", "key")
    own = rows.withColumn("piece", piece_of(at, table, n))
    seats = F.array(F.struct("piece", F.lit(False).alias("guest")), F.when(F.get(table, F.col("piece")) == at, F.struct(((F.col("piece") + n - 1) % n if n else F.lit(0)).cast("int").alias("piece"), F.lit(True).alias("guest"))))
    seated = own.select("id", "text", "key", F.explode(F.array_compact(seats)).alias("seat")).select("id", "text", "key", "seat.piece", "seat.guest")
    return seated.repartitionById(max(n, 1), F.col("piece")), Window.partitionBy("piece").orderBy("guest", F.col("id").asc_nulls_first(), "key")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = WORDS) -> DataFrame:
    """id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch: of each text, of it with its last quarter replaced by the beginning of the next text, and of the next text."""
    rows, after = with_successor(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("following", F.lead("text").over(after)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.select("*", F.left("text", F.col("n_chars").cast("int") - cut).alias("head"), cut.alias("cut"))
    rows = rows.withColumn("edited", F.concat("head", F.left(F.coalesce("following", F.lit("")), F.col("cut"))))
    # the last word of the head may go on differently; those before it, and the shingles that hold only them, are the same in both
    whole = F.greatest(F.regexp_count("head", F.lit(r"[^\x20\x09-\x0D]+")) - 1, F.lit(0)).cast("int")
    cutting = rows.select("id", "key", "piece", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), words_of(F.col("text")).alias("own"), words_of(F.col("edited")).alias("other"), F.when(whole >= size, whole).otherwise(0).alias("same"))
    tail = lambda w: F.when(F.col("same") > 0, F.slice(w, F.col("same") - (size - 2), F.size(w))).otherwise(w)  # noqa: E731  from its last size - 1 words on
    head = F.when(F.col("same") > 0, lowest(hashes(F.slice("own", F.lit(1), F.col("same")), size), k)).otherwise(F.array().cast("array<string>"))
    parts = cutting.select("id", "key", "piece", "guest", "n_chars", "edited_sha256", head.alias("head"), *[lowest(hashes(tail(F.col(c)), size), k).alias(c) for c in ("own", "other")])
    done = parts.select("id", "key", "piece", "guest", "n_chars", "edited_sha256", merge(F.col("head"), F.col("own"), k).alias("sketch"), merge(F.col("head"), F.col("other"), k).alias("edited_sketch"))
    out = done.withColumn("next_sketch", F.lead("sketch").over(after)).where(~F.col("guest"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = WORDS) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated), kept (share of the shingles that the edit leaves)."""
    own, edited, following = map(F.col, ("sketch", "edited_sketch", "next_sketch"))
    rows = compare_with_edits(docs, id_col=id_col, text_col=text_col, k=k, size=size)
    return rows.select(
        id_col, "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"), resemblance(own, edited, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
        F.round(distinct_shingles(own, k)).cast("long").alias("n_shingles"), F.round(containment(own, edited, k), 6).alias("kept"),
    )
