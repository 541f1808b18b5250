"""SimHash near-duplicates: 64-bit fingerprints, linked through vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Equal fingerprints are one
class from the start. The classes are divided by a vantage-point tree: each node holds a fingerprint
and a radius, and sends a fingerprint inwards or outwards by its Hamming distance to it. The top of the
tree is built on a sample (see SAMPLE) and cuts the classes into shards. By the triangle bound a fingerprint
whose distance is within `distance` of a node's radius may have a partner on the other side: it also
visits the shards over there (those of a higher number only, as the partner visits the others). Inside a
shard the tree goes on to small leaves, where every remaining pair is compared. Nothing is missed. A shard's visitors are dealt out
in pieces, each with the shard's own classes, so that no group grows with the number of shards.

A shard returns a spanning forest of its links, never all pairs of a group; components are found over
these by distributed label passing.

Cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other; very
long texts are hashed whole; ties in the majority give 0; repeated rows and copies share a class; null
ids get the component of their class (null if it has no id at all); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .components import connected_components

#: The sample has SAMPLE fingerprints, or PER_SHARD for each shard where that is more (one class in 4,096).
SAMPLE, PER_SHARD, SHARD, LEAF = 20_000, 4, 16_384, 256
#: Guests of a shard that one group holds, and points that are compared at once with LEAF others.
GUESTS, BLOCK = 65_536, 1024
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    parts = text.translate(FOLD).split()  # bytes split at space and U+0009 to U+000D
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.r_[0, ends[:-words]].tolist()
    h, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = (ends[words - 1 :] - 1).tolist()
    for i in range(0, n, 1 << 15):
        part = np.array([h(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 15)], stops[i : i + (1 << 15)], strict=True)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp (the 64 bits as a signed long)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return src.mapInArrow(hashed, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def hamming(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point and radius that cut points most evenly, of a few drawn from them."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = hamming(points, v)
        r = int(np.median(d))
        for radius in (r - 1, r):
            inside = int((d <= radius).sum())
            off = abs(2 * inside - len(points))
            if best is None or off < best[0]:
                best = (off, v, radius)
    return best[1], best[2]


def build_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator):
    """Nested (vantage point, radius, inner, outer); None is a leaf."""
    if leaves < 2 or len(sample) < 2:
        return None
    v, r = vantage(sample, rng)
    inside = hamming(sample, v) <= r
    if inside.all() or not inside.any():
        return None
    return v, r, build_tree(sample[inside], leaves // 2, rng), build_tree(sample[~inside], leaves - leaves // 2, rng)


def count_leaves(tree) -> int:
    return 1 if tree is None else count_leaves(tree[2]) + count_leaves(tree[3])


def route(tree, points: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices of points, whether it is their home) of every leaf that a point may have a partner in."""

    def down(node, at: np.ndarray, home: np.ndarray, first: int):
        if not len(at):
            return
        if node is None:
            yield first, at, home
            return
        v, r, inner, outer = node
        d = hamming(points[at], v).astype(np.int64)
        to = d <= r + distance
        yield from down(inner, at[to], home[to] & (d[to] <= r), first)
        to = d > r - distance
        yield from down(outer, at[to], home[to] & (d[to] > r), first + count_leaves(inner))

    yield from down(tree, np.arange(len(points)), np.ones(len(points), bool), 0)


class Forest:
    """Union-find over indices, joining arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            q = self.parent[p]
            if (q == p).all():
                return p
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link(points: np.ndarray, home: np.ndarray, guests: np.ndarray, distance: int, forest: Forest, rng: np.random.Generator, among: bool = True) -> None:
    """Joins all pairs within distance among home (unless that is done elsewhere), and between home and guests (indices into points), down a vantage-point tree."""
    if not len(home) or not (among or len(guests)):
        return
    v = None
    if len(home) > LEAF:
        v, r = vantage(points[home], rng)
        d, g = hamming(points[home], v).astype(np.int64), hamming(points[guests], v).astype(np.int64)
        inside = d <= r
        if inside.all() or not inside.any():
            v = None
    if v is None:
        everyone = np.r_[home, guests] if among else guests
        for i in range(0, len(everyone), BLOCK):  # in a tight group all of a block's pairs are links
            part = everyone[i : i + BLOCK]
            for j in range(0, len(home), LEAF):
                x, y = np.nonzero(hamming(points[home[j : j + LEAF]][:, None], points[part][None, :]) <= distance)
                forest.join(home[j : j + LEAF][x], part[y])
        return
    # an inner point near the boundary looks in the outer part as a guest; the reverse would find the same pairs
    near = home[inside & (d > r - distance)] if among else home[:0]
    link(points, home[inside], guests[g <= r + distance], distance, forest, rng, among)
    link(points, home[~inside], np.r_[guests[g > r - distance], near], distance, forest, rng, among)


def near_duplicates(docs: DataFrame, *, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id of its component)."""
    spark = docs.sparkSession
    tables = Tables(spark, "simhash")
    marked = tables.keep(fingerprints(docs, words, id_col, text_col))
    classes = tables.keep(marked.groupBy("fp").agg(F.min("id").alias("least")))
    shards = -(-classes.count() // SHARD)
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, PER_SHARD * shards)).toArrow()
    sample = sample.column("fp").to_numpy().view(np.uint64) if len(sample) else np.zeros(0, np.uint64)
    sent = spark.sparkContext.broadcast(build_tree(sample, min(shards, len(sample) // PER_SHARD), np.random.default_rng(42)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy().view(np.uint64)
            own = np.zeros(len(points), np.int64)
            stops = list(route(sent.value, points, distance))
            for leaf, at, home in stops:
                own[at[home]] = leaf
            for leaf, at, home in stops:
                keep = leaf >= own[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), leaf)), pa.array(points[at[keep]].view(np.int64)), pa.array(home[keep])], ["leaf", "fp", "home"])

    def linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp")
        points, home = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool)
        forest = Forest(len(points))
        link(points, np.flatnonzero(home), np.flatnonzero(~home), distance, forest, np.random.default_rng(42), key[1] == 0)
        at = np.flatnonzero(forest.parent != np.arange(len(points)))
        return pd.DataFrame({"a": points[at].view(np.int64), "b": points[forest.find(at)].view(np.int64)})

    visits = tables.keep(classes.select("fp").mapInArrow(routed, "leaf long, fp long, home boolean"))
    # guests needn't meet each other: a shard's are dealt out in pieces, each with all that are at home there
    pieces = visits.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("home")) / GUESTS)).cast("int").alias("pieces"))
    seat = F.when(F.col("home"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")))
    edges = tables.keep(visits.join(pieces, "leaf").select("leaf", "fp", "home", F.explode(seat).alias("piece")).groupBy("leaf", "piece").applyInPandas(linked, "a long, b long"))
    roots = connected_components(edges, tables).withColumnRenamed("node", "fp")
    group = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    group = tables.keep(group.join(least, "root").select("fp", "component_id"))
    tables.only(marked, group)
    return marked.join(group, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
