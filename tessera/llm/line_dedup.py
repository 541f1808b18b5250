"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Lines that occur once can't be in a repeated run, so only repeated lines get positions: consecutive ones of a
document form an island, and positions ascend in corpus order (id, then text hash, then line). All suffixes of islands are sorted by
their first four lines, then, round by round, by the ranks of the four parts of a prefix four times as long, until
no two equal prefixes go on. A round is one exchange to the islands, where the ranks further on are read off, and one to the new order,
by range and with the position as the last key, so that equal suffixes, however many, are spread over tasks.

Where a round parts two neighbours it bounds the length of their common prefix, and the first round gives it outright. The rest
are compared line by line within these bounds, only where the neighbour doesn't continue the previous position's neighbour, else it
is one less than there. An interval of the array over which common prefixes have at least m lines holds all copies of a run of m lines.

A run deletes its lines if it is a later copy (not the first position of its interval) and qualifies: at
least two lines, or one line of at least `min_words` words. The first copy stays. A longer run is repeated where its pairs of lines
are, so the intervals for two lines and for one tell what goes. The larger of the common prefixes with the two neighbours is the longest
repeated run that starts at a position.

Cases: lines are compared without white space at their ends; blank lines are no lines and stay; null texts
stay null; a text that loses all lines becomes empty; rows that repeat both id and text count as one and are
treated alike; null ids come first; very long texts are held one at a time, with all their lines; an empty table gives no rows. Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

BLANK = " \t\r\x0b\x0c"


ROWS_A_TASK = 50_000


def parts(df: DataFrame, rows: int) -> int:
    """As many range partitions as rows call for, as the session's number of shuffle partitions at most (the sort spills)."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_TASK + 1))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, h, k (number among the non-blank lines), ln (among all), two hashes of the line, enough."""
    many = F.col("line").rlike(r"^(?:\S++\s++){%d}\S" % (min_words - 1)) if min_words > 1 else F.lit(True)  # possessive, so that long words are read once
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("ln"), F.trim(x, F.lit(BLANK)).alias("line"))), lambda s: s["line"] != "")
    out = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), lines.alias("lines")).select("id", "h", F.posexplode("lines").alias("k", "s"))
    return out.select("id", "h", "k", F.col("s.ln").alias("ln"), F.col("s.line").alias("line")).select("id", "h", "k", "ln", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2"), many.alias("enough"))


def by_range(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return df.repartitionByRange(parts(df, rows), *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


KEYS = ["k0", "k1", "k2", "k3"]


def sort_round(keyed: DataFrame, rows: int, tables: Tables) -> tuple[DataFrame, bool]:
    """Rows (p, e, k0 .. k3) in the order of their keys, then p: index, p, e, rank (index of the first row with the same keys), q and qe (of the row before), split (the first key that differs from it, 4: none); and whether equal keys go on (k3 >= 0)."""
    src = by_range(keyed, [*KEYS, "p"], rows).select("part", "p", "e", *KEYS)
    names = ["part", "n", "p", "e", "q", "qe", "start", "split", "first", "last", "more"]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]

    def batch(columns: dict) -> pa.RecordBatch:
        size = len(columns["part"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each, and one that sums up the partition: n rows, its last p and e, the start of its last keys, its first and last keys."""
        n, start, last, first, more, part = 0, 0, None, None, False, 0
        for b in batches:
            if not len(b):
                continue
            part, p, e, *keys = (c.to_numpy() for c in b.columns)
            keys, part = np.stack(keys, 1), int(part[0])
            if last is None:
                first, last = keys[0], (keys[0] - 1, -1, -1)
            same = keys == np.vstack([last[0], keys[:-1]])
            split = np.where(same.all(1), 4, same.argmin(1))
            index = n + np.arange(len(p))
            starts = np.maximum(np.maximum.accumulate(np.where(split < 4, index, 0)), start)
            more |= bool(((split == 4) & (keys[:, 3] >= 0)).any())
            yield batch({"part": np.full(len(p), part), "n": index, "p": p, "e": e, "q": np.r_[last[1], p[:-1]], "qe": np.r_[last[2], e[:-1]], "start": starts, "split": split})
            n, start, last = n + len(p), int(starts[-1]), (keys[-1], p[-1], e[-1])
        if n:
            yield batch({"part": [part], "n": [n], "p": [last[1]], "e": [last[2]], "start": [start], "first": [first], "last": [last[0]], "more": [more]})

    found = tables.keep(src.mapInArrow(scan, "part int, n long, p long, e long, q long, qe long, start long, split int, first array<long>, last array<long>, more boolean"))
    offset, before, fixes, go_on = 0, None, [], False
    for r in sorted(found.where("first is not null").collect(), key=lambda r: r.part):  # one row a partition
        differ = next((j for j in range(4) if before is None or before[0][j] != r.first[j]), 4)
        carried = before[3] if differ == 4 else None
        fixes.append((r.part, offset, carried, before and before[1], before and before[2], differ))
        go_on |= r.more or (differ == 4 and r.first[3] >= 0)
        before = (r.last, r.p, r.e, carried if r.start == 0 and carried is not None else offset + r.start)
        offset += r.n
    fix = found.sparkSession.createDataFrame(fixes, "part int, offset long, carried long, q0 long, qe0 long, split0 int")
    begins = F.col("n") == 0
    rank = F.when((F.col("start") == 0) & F.col("carried").isNotNull(), F.col("carried")).otherwise(F.col("offset") + F.col("start"))
    out = found.where("first is null").join(F.broadcast(fix), "part")
    return out.select((F.col("offset") + F.col("n")).alias("index"), "p", "e", rank.alias("rank"), *[F.when(begins, F.col(f"{c}0")).otherwise(F.col(c)).alias(c) for c in ("q", "qe", "split")]), go_on


def suffix_array(spots: DataFrame, rows: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of spots (p, e = its island's last position, k0 .. k3 = its line and the next three, -1 beyond the island): the sorted suffixes as sort_round() gives them; and (rank, least, width): the suffix of that rank shares `least` lines with the one before, and under least + width."""
    array, go_on = sort_round(spots.select("p", "e", *KEYS), rows, tables)
    bounds, width = None, 1
    while True:
        new = array.where("split between 1 and 3").select("rank", (F.col("split") * width).cast("long").alias("least"), F.lit(width).cast("long").alias("width"))
        bounds = new if bounds is None else bounds.unionByName(new)
        if not go_on:
            return array, bounds
        width *= 4
        island = Window.partitionBy("e").orderBy("p")  # part of a document
        further = [F.coalesce(F.lead("rank", j * width).over(island), F.lit(-1)).alias(f"k{j}") for j in (1, 2, 3)]
        array, go_on = sort_round(array.select("p", "e", F.col("rank").alias("k0"), *further), rows, tables)


def line_slices(spots: DataFrame, requests: DataFrame) -> DataFrame:
    """key, side, lines: the lines that requests (e, at, width, key, side) ask for, cut where the island ends."""
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    both = spots.select("e", F.col("p").alias("at"), F.col("k0").alias("line"), null("width", "long"), null("key", "long"), null("side", "int"))
    both = both.unionByName(requests.withColumn("line", F.lit(None).cast("long")))
    n = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = both.repartition(n, "e").sortWithinPartitions("e", F.col("key").isNotNull(), "at").select("e", "at", "line", "width", "key", "side")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, base, held = None, 0, []
        for b in batches:
            keys, sides, out = [], [], []
            for e, at, line, width, key, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if e != island:
                    island, base, held = e, at, []
                if key is None:
                    held.append(line)
                else:
                    keys.append(key), sides.append(side), out.append(held[at - base : at - base + width])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["key", "side", "lines"])

    return src.mapInArrow(cut, "key long, side int, lines array<long>")


def common_prefixes(spots: DataFrame, array: DataFrame, bounds: DataFrame, tables: Tables) -> DataFrame:
    """index, p, prefix: how many lines the suffix shares with the one before it."""
    near = array.join(bounds.withColumnRenamed("rank", "at"), F.col("index") == F.col("at"), "left").drop("at")
    shares = (F.col("split") == 4) | (F.coalesce("least", F.lit(0)) > 0)
    value = F.when(F.col("split") == 4, F.col("e") - F.col("p") + 1).when(F.coalesce("width", F.lit(1)) == 1, F.coalesce("least", F.lit(0)))
    near = near.withColumn("shares", shares).withColumn("value", value)
    island = Window.partitionBy("e").orderBy("p")
    goes_on = F.col("shares") & F.coalesce(F.lag("shares").over(island) & (F.lag("q").over(island) == F.col("q") - 1) & (F.lag("qe").over(island) == F.col("qe")), F.lit(False))
    near = tables.keep(near.withColumn("goes_on", goes_on).select("index", "p", "e", "q", "qe", "least", "width", "shares", "value", "goes_on"))
    wanted = near.where("shares and not goes_on and value is null")
    ask = lambda e, p, side: F.struct(F.col(e).alias("e"), (F.col(p) + F.col("least")).alias("at"), "width", F.col("index").alias("key"), F.lit(side).alias("side"))
    slices = tables.keep(line_slices(spots, wanted.select(F.explode(F.array(ask("e", "p", 0), ask("qe", "q", 1))).alias("s")).select("s.*")))
    one = lambda side, name: slices.where(F.col("side") == side).select("key", F.col("lines").alias(name))
    differ = F.array_position(F.zip_with("mine", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1
    more = one(0, "mine").join(one(1, "theirs"), "key").select(F.col("key").alias("index"), F.when(differ < 0, F.least(F.size("mine"), F.size("theirs"))).otherwise(differ).alias("more"))
    known = near.join(more, "index", "left").withColumn("value", F.coalesce("value", F.col("least") + F.col("more")))
    last = F.last(F.col("value") + F.col("p"), ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, 0))
    return tables.keep(known.select("index", "p", F.when(F.col("shares"), last - F.col("p")).otherwise(0).cast("long").alias("prefix")))


def intervals(prefixes: DataFrame, rows: int, tables: Tables) -> DataFrame:
    """p, longest (lines shared with either neighbour), first1 and first2: the first position of the interval of prefixes of at least one, and two, lines around it. Intervals that go on over partitions are put together from one row a partition."""
    src = by_range(prefixes, ["index"], rows).select("part", "p", "prefix")
    names = ["part", "p", "longest", "first1", "edge1", "first2", "edge2", "prefix0"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each, with what its partition tells; edge 1: in its first interval, 2: in its last. And one row with p -1: the two edges' first positions and the partition's first prefix."""
        held = [b for b in batches if len(b)]
        if not held:
            return
        p, prefix = (np.concatenate([b.column(j).to_numpy() for b in held]) for j in (1, 2))
        part, n = held[0].column(0)[0].as_py(), len(p)
        columns, ends = {}, {}
        for d in (1, 2):
            starts = np.flatnonzero(np.r_[True, prefix[1:] < d])
            sizes = np.diff(np.r_[starts, n])
            least = np.minimum.reduceat(p, starts)
            edge = np.zeros(len(starts), np.int32)
            edge[0] += 1
            edge[-1] += 2
            columns |= {f"first{d}": np.repeat(least, sizes), f"edge{d}": np.repeat(edge, sizes)}
            ends |= {f"first{d}": [least[0], least[-1]], f"edge{d}": [edge[0], edge[-1]]}
        columns |= {"part": np.full(n, part), "p": p, "longest": np.maximum(prefix, np.r_[prefix[1:], 0]), "prefix0": np.r_[np.full(n - 1, -1), -2]}
        ends |= {"part": [part] * 2, "p": [-1] * 2, "longest": [0] * 2, "prefix0": [prefix[0]] * 2}
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for c in (columns, ends):
            yield pa.RecordBatch.from_arrays([pa.array(c[x], t) for x, t in zip(names, kinds, strict=True)], names)

    found = tables.keep(src.mapInArrow(scan, "part int, p long, longest long, first1 long, edge1 int, first2 long, edge2 int, prefix0 long"))
    edges: dict[int, list] = {}
    for r in found.where("p < 0").collect():  # two rows a partition
        edges.setdefault(r.part, []).append(r)
    fixes = {part: {"next": 0} for part in edges}
    order = sorted(edges)
    for part, after in zip(order, order[1:], strict=False):
        fixes[part]["next"] = edges[after][0].prefix0
    for d in (1, 2):
        chain: list[tuple[int, int]] = []
        least = None

        def close(chain=None, least=None, d=d) -> None:
            for part, side in chain or ():
                fixes[part][f"{side}{d}"] = least

        for part in order:
            rows_of = {r[f"edge{d}"]: r[f"first{d}"] for r in edges[part]}
            if edges[part][0].prefix0 < d:
                close(chain, least)
                chain, least = [], None
            head = rows_of.get(3, rows_of.get(1))
            chain, least = [*chain, (part, 1)], head if least is None else min(least, head)
            if 3 in rows_of:
                chain.append((part, 2))
            else:
                close(chain, least)
                chain, least = [(part, 2)], rows_of[2]
        close(chain, least)
    fix = found.sparkSession.createDataFrame([(part, f["next"], *(f[f"{side}{d}"] for d in (1, 2) for side in (1, 2))) for part, f in fixes.items()], "part int, next long, a1 long, b1 long, a2 long, b2 long")
    out = found.where("p >= 0").join(F.broadcast(fix), "part")
    first = lambda d: F.when(F.col(f"edge{d}") % 2 == 1, F.col(f"a{d}")).when(F.col(f"edge{d}") == 2, F.col(f"b{d}")).otherwise(F.col(f"first{d}")).alias(f"first{d}")
    longest = F.when(F.col("prefix0") == -2, F.greatest("longest", "next")).otherwise(F.col("longest"))  # -2: the partition's last row
    return out.select("p", longest.alias("longest"), first(1), first(2))


def placed_lines(shared: DataFrame, rows: int, tables: Tables) -> DataFrame:
    """shared (id, h, k, ln, enough, line) with p, e and k0 .. k3; rows that repeat id, h and k count once."""
    src = by_range(shared, ["id", "h"], rows).sortWithinPartitions("id", "h", "k").select("part", "id", "h", "k", "ln", "enough", "line")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions within a partition, with a gap after each island. Rows are held until their document is whole."""
        held, used = None, 0

        def numbered(b: pa.RecordBatch, doc: np.ndarray) -> pa.RecordBatch:
            nonlocal used
            k = b.column(3).to_numpy()
            stay = np.r_[True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])]
            b, doc, k = b.filter(pa.array(stay)), doc[stay], k[stay]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1] + 1)]
            p = used + np.cumsum(1 + new)
            used = int(p[-1])
            start = np.flatnonzero(new)
            sizes = np.diff(np.r_[start, len(p)])
            e = np.repeat(p[start + sizes - 1], sizes)
            line = b.column(6).to_numpy()
            further = [np.where(p + j <= e, np.r_[line[j:], np.zeros(min(j, len(line)), np.int64)][: len(line)], -1) for j in range(4)]
            return pa.RecordBatch.from_arrays([*(b.column(j) for j in (0, 1, 2, 4, 5)), pa.array(p), pa.array(e), *map(pa.array, further)], ["part", "id", "h", "ln", "enough", "p", "e", *KEYS])

        for b in batches:
            if not len(b):
                continue
            held = b if held is None else pa.concat_batches([held, b])
            ids, h = held.column(1).dictionary_encode().indices.fill_null(-1).to_numpy(), held.column(2).to_numpy()
            doc = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])])
            upto = int(np.searchsorted(doc, doc[-1]))  # the last document may go on
            if upto:
                yield numbered(held.slice(0, upto), doc[:upto])
                held = held.slice(upto)
        if held is not None and len(held):
            yield numbered(held, np.zeros(len(held), np.int64))

    kind = shared.schema["id"].dataType.simpleString()
    local = tables.keep(src.mapInArrow(place, f"part int, id {kind}, h long, ln int, enough boolean, p long, e long, k0 long, k1 long, k2 long, k3 long"))
    sizes = local.groupBy("part").agg(F.max("p").alias("size"))  # one row a partition
    starts = sizes.withColumn("start", F.coalesce(F.sum(F.col("size") + 2).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    moved = [(F.col(c) + F.col("start")).alias(c) for c in ("p", "e")]
    return tables.keep(local.join(F.broadcast(starts), "part").select("id", "h", "ln", "enough", *moved, *KEYS))


def repeated_lines(docs: DataFrame, *, min_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (text hash), longest_run, deleted (line numbers, from 0) of each document that has a repeated line."""
    tables = Tables(docs.sparkSession, "lines")
    lines = tables.keep(line_table(docs, id_col, text_col, min_words))
    ids = lines.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").withColumn("line", F.monotonically_increasing_id())
    ids = tables.keep(ids)  # a table of its own, so that Spark can split a hot line's rows in the join
    rows = ids.agg(F.sum("n")).first()[0] or 0
    spots = placed_lines(lines.join(ids, ["k1", "k2"]).select("id", "h", "k", "ln", "enough", "line"), rows, tables)
    array, bounds = suffix_array(spots, rows, tables)
    marks = tables.keep(intervals(common_prefixes(spots, array, bounds, tables), rows, tables))
    island = Window.partitionBy("e").orderBy("p")
    marked = spots.select("id", "h", "ln", "enough", "p", "e").join(marks, "p").withColumn("pair", F.col("p") > F.col("first2"))
    gone = F.col("pair") | F.coalesce(F.lag("pair").over(island), F.lit(False)) | (F.col("enough") & (F.col("p") > F.col("first1")))
    found = marked.withColumn("gone", gone).groupBy("id", "h").agg(F.collect_list(F.when(F.col("gone"), F.col("ln"))).alias("deleted"), F.max("longest").alias("longest_run"))
    return found.select(F.col("id").alias(id_col), "h", F.col("longest_run").cast("long").alias("longest_run"), "deleted")


def drop_repeated_lines(docs: DataFrame, *, min_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs cut from the text, and n_lines, n_deleted, longest_run appended."""
    found = repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col).withColumnsRenamed({id_col: "__id", "h": "__h", "deleted": "__deleted"})
    src = docs.drop("n_lines", "longest_run", "n_deleted")
    joined = src.join(found, src[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(src[text_col]) == F.col("__h")) & src[text_col].isNotNull(), "left").drop("__id", "__h")
    joined = joined.withColumn("n_lines", F.lit(0).cast("long")).withColumn("longest_run", F.coalesce("longest_run", F.lit(0)).cast("long")).withColumn("n_deleted", F.greatest(F.size("__deleted"), F.lit(0)).cast("long"))
    names = [c for c in joined.columns if c != "__deleted"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            texts, n_lines = columns[text_col].to_pylist(), []
            for i, gone in enumerate(columns["__deleted"].to_pylist()):
                lines = (texts[i] or "").split("\n")
                full = [bool(x.strip(BLANK)) for x in lines]
                n_lines.append(sum(full))
                if gone:
                    out = set(gone)
                    rest = [j for j in range(len(lines)) if j not in out]
                    texts[i] = "\n".join(lines[j] for j in rest) if any(full[j] for j in rest) else ""
            columns |= {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return joined.mapInArrow(cut, joined.drop("__deleted").schema)
