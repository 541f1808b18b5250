"""Filter interaction audit by lattice-edge aggregation.

A set of filters can be applied in any order; what one of them removes depends on which came before. The sets of filters already
applied form a lattice of 32 subsets, and each (subset, next filter) is one of its 80 edges. Documents are summed by
part and failure mask (which filters they fail), each such class contributes to all edges, and every one of the 600 steps of the
120 orders is then looked up by its edge: an order is a path from the empty subset to the full one.

Texts are read once. What is kept of a document is a narrow row (text hash, id, part, mask, labels), written
to the shared folder; rows that agree in all of these are one. Filter E (a smaller id has the same text) needs no join back: every row of a
text fails it but those of its smallest id, so the classes are all rows as failing, corrected for the first ones. Both are sums, which
Spark forms before it shuffles, so a text or part with a third of all rows is no burden. Result: 600 rows a part.

Cases: a null text counts as empty; no words: neither B nor C fails (nothing is compared with nothing), A does; a null source is the part
''; a null id can't be compared, so its row neither fails E nor makes others fail it; rows that repeat an id and a text don't fail E
through each other (no smaller id) and count separately; a document with several labels has quality 1 (toxic 1) if one of them says so, null labels say nothing;
very long texts are read whole; other columns, whatever their names, are ignored; an empty table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"
REPEATED = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # words; distinct words and capitals in per cent
COUNTS = ["n", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    # bound to a lambda variable, so that the words are cut once
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda failed, name: F.when(failed, 1 << FILTERS.index(name)).otherwise(0)
    short = lambda s: bit(s["all"] < LEAST_WORDS, "A") + bit(100 * s["distinct"].cast("long") < LEAST_DISTINCT * s["all"].cast("long"), "B")
    return F.transform(F.array(sizes), short)[0] + bit(100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), "C") + bit(text.rlike(SIGNS), "D")


def facts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """h (text hash), id, part, mask (A to D), n, good, toxic: rows that agree in the first four, with how many they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("h"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.groupBy("h", "id", "part", "mask").agg(F.count("*").alias("n"))
    marked = rows.join(marks, F.col("id") == F.col("labelled"), "left")
    return marked.select("h", "id", "part", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def mask_classes(rows: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic."""
    own = rows.where("id is not null").groupBy("h", "id", "mask").agg(F.collect_list(F.struct("part", *COUNTS)).alias("rows"))  # the parts that hold one id's copies
    first = own.groupBy("h").agg(F.min_by(F.struct("mask", "rows"), "id").alias("first")).select("first.mask", F.explode("first.rows").alias("r")).select("r.part", "mask", *[f"r.{c}" for c in COUNTS])
    as_repeated = F.when(F.col("id").isNull(), F.col("mask")).otherwise(F.col("mask") + REPEATED).alias("mask")
    out = rows.select("part", as_repeated, *COUNTS).unionByName(first)
    out = out.unionByName(first.select("part", (F.col("mask") + REPEATED).alias("mask"), *[(-F.col(c)).alias(c) for c in COUNTS]))
    return out.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def edge_counts(classes: DataFrame) -> DataFrame:
    """part, applied (subset), next (filter) and the counts of each edge; `orders` is how many orders go over it."""
    every = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("applied"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("next")).withColumn("bit", F.expr("1 << next")).where("applied & bit = 0")
    left, fails = F.expr("mask & applied = 0"), F.expr("mask & bit <> 0")
    total = lambda c, condition, name: F.sum(F.when(condition, F.col(c)).otherwise(0)).alias(name)
    out = every.groupBy("part", "applied", "next").agg(
        total("n", left & ~fails, "kept"), total("n", left & fails, "removed"), total("n", ~left & fails, "redundant"),
        total("n", F.expr("mask = bit"), "unique_fails"), total("good", left & fails, "good_lost"), total("toxic", left & fails, "toxic_lost"),
    )
    size = F.bit_count("applied")
    return out.withColumn("orders", (F.factorial(size) * F.factorial(len(FILTERS) - 1 - size)).cast("long"))


def paths(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied, next: the 600 steps of the 120 orders."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = spark.range(1).select(F.explode(orders).alias("filter_order")).select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda at: F.instr(F.lit(FILTERS), F.substring("filter_order", at, F.lit(1))) - 1
    bits = [F.when(F.col("step") > i, F.pow(F.lit(2), place(F.lit(i))).cast("int")).otherwise(0) for i in range(1, len(FILTERS))]
    return steps.select("filter_order", "step", sum(bits, F.lit(0)).alias("applied"), place(F.col("step")).alias("next"))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every step of every order."""
    spark = docs.sparkSession
    rows = Tables(spark, "audit").keep(facts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
    edges = edge_counts(mask_classes(rows))
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = F.broadcast(paths(spark))  # 600 rows
    out = edges.join(steps, ["applied", "next"]).join(shares, ["part", "next"])
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
