"""Mixing sources to target weights by balanced (cube-method) sampling.

A source's target in words is its share of the wanted total, at most `cap` times its size. Each of its
documents is then due target / size copies: the whole part is certain, the rest is an inclusion
probability. The flight phase moves these probabilities inside the null-space of the balancing
constraints (number of documents, number of words) until almost all are 0 or 1. It runs in shards of a
fixed number of documents, so a source of any size is spread out; the few probabilities each shard leaves
fractional, and a few documents of all sizes that it leaves out, go on to the next flight, until one shard is left for each source. There size octaves are
flown one after the other, from the largest documents down: landing rounds the last two or three of an octave so that the
words come nearest, and the next octave's probabilities make up for what it is off by.

Cases: very long texts are sizes like any other; null texts and texts without words have size 0 and are taken 0 times; a null source is a source of
its own, last in order; each repeated row is a document of its own; ties in size are ordered by id; an
empty table gives no rows. Moves are drawn from a generator seeded by the source and shard, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Tables

EDGE = 1e-9
#: Documents of all sizes that a shard leaves out of its flight, at least (else an eighth of the shard): the more are left for the landing, the nearer it comes.
RESERVE = 24


def numbered(per: DataFrame, tables: Tables) -> DataFrame:
    """per (one row a source) with `number`, from 0, in the order of sources, null last: counted within ranges, which one row each tells the start of."""
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("source").asc_nulls_last()
    local = tables.keep(per.repartitionByRange(n, key).withColumn("part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    starts = local.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return local.withColumn("within", within).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("within")).drop("part", "start", "within")


def targets(sizes: DataFrame, tables: Tables, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: one row a source. What sources above their cap have too much is shared by weight among the others, until none is above: a few sums over sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    per = tables.keep(numbered(per, tables).withColumn("weight", w).withColumn("most", cap * F.col("source_size")).drop("number"))
    level, wanted = 0.0, share * (per.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("most") <= level * F.col("weight")
        held, weight = per.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (wanted - (held or 0.0)) / weight if weight else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "source_size", "n_docs", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after moves that keep their sum and their size-weighted sum; at most two stay fractional (more only if no move is left)."""
    p = p.copy()
    draws = iter(rng.random(len(p) + 8).tolist())
    value, size = p.tolist(), sizes.tolist()
    held: list[int] = []
    for i in [*np.flatnonzero((p > EDGE) & (p < 1 - EDGE)).tolist(), -1, -1]:
        if i >= 0:
            held.append(i)
        while len(held) >= 3 or (i < 0 and len(held) == 2 and size[held[0]] == size[held[1]]):
            a, b = held[0], held[1]
            if size[a] == size[b]:
                move = {a: 1.0, b: -1.0}
            else:
                c = held[2]
                move = {a: float(size[c] - size[b]), b: float(size[a] - size[c]), c: float(size[b] - size[a])}
            up = min((1 - value[k]) / m if m > 0 else value[k] / -m for k, m in move.items() if m)
            down = min(value[k] / m if m > 0 else (1 - value[k]) / -m for k, m in move.items() if m)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for k, m in move.items():
                v = value[k] + step * m
                value[k] = 0.0 if v < EDGE else 1.0 if v > 1 - EDGE else v
            held = [k for k in held if 0.0 < value[k] < 1.0]
    return np.array(value)


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rounds the few fractional probabilities so that words, then documents, come nearest to what they add up to."""
    at = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    if not len(at):
        return np.round(p)
    words, number = float((p[at] * sizes[at]).sum()), float(p[at].sum())
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(int(sizes[k]) for j, k in enumerate(at) if m >> j & 1) - words), abs(bin(m).count("1") - number), m))
    out = np.round(p)
    for j, k in enumerate(at):
        out[k] = best >> j & 1
    return out


def settle(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All decisions of the last shard: size octaves are flown and landed from the largest down, each making up in its probabilities for the words that those above are off by."""
    out, off = np.zeros(len(p)), 0.0
    octave = np.array([int(s).bit_length() for s in sizes])
    for o in sorted(set(octave.tolist()), reverse=True):
        at = np.flatnonzero(octave == o)
        s = sizes[at]
        out[at] = landing(flight(np.clip(p[at] - off / s.sum(), 0.0, 1.0), s, rng), s)
        off += float((out[at] * s).sum() - (p[at] * s).sum())
    return refine(out, p, sizes)


def refine(out: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends the landing: takes up, drops or exchanges single documents while that brings the words nearer."""
    out = out.copy()
    for _ in range(100):
        off = float(((out - p) * sizes).sum())
        taken, free = np.flatnonzero(out > 0.5), np.flatnonzero(out < 0.5)
        moves = [(abs(off - sizes[i]), (i,)) for i in taken] if off > 0 else [(abs(off + sizes[j]), (j,)) for j in free]
        if len(taken) and len(free):
            order = free[np.argsort(sizes[free], kind="stable")]
            want = sizes[taken] - off  # the size that would make up for each one dropped
            for k in (0, 1):
                j = order[np.clip(np.searchsorted(sizes[order], want) - k, 0, len(order) - 1)]
                gap = np.abs(want - sizes[j])
                i = int(gap.argmin())
                moves.append((float(gap[i]), (taken[i], j[i])))
        best = min(moves, key=lambda m: m[0], default=(np.inf, ()))
        if best[0] >= abs(off) - EDGE:
            break
        for i in best[1]:
            out[i] = 1 - out[i]
    return out


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0, shard: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies, taken: one row a document (copies may be 0)."""
    spark, reserve = docs.sparkSession, max(RESERVE, shard // 8)
    tables = Tables(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = tables.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    goal = tables.keep(targets(sizes, tables, weights=weights, share=share, cap=cap).withColumnRenamed("source", "of"))
    largest = goal.agg(F.max("n_docs")).first()[0] or 0
    due = sizes.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    due = due.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor(F.col("rate") + EDGE))
    due = due.withColumn("p", F.when((F.col("size") > 0) & (F.col("rate") - F.col("whole") > EDGE), F.col("rate") - F.col("whole")).otherwise(0.0))
    schema = "id {}, source string, size long, source_size long, n_docs long, target double, whole long, p double, salt long".format(sizes.schema["id"].dataType.simpleString())

    def flown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        s = rows["size"].to_numpy()
        rng = np.random.default_rng(zlib.crc32(repr((seed, *map(str, key))).encode()))
        p = rows["p"].to_numpy(float, copy=True)
        if key[1] < 0:  # all that is left of a source
            p = settle(p, s, rng)
        elif len(p) > reserve:
            fly = np.ones(len(p), bool)
            fly[np.linspace(0, len(p) - 1, reserve).astype(int)] = False
            p[fly] = flight(p[fly], s[fly], rng)
        rows["p"] = p
        return rows

    # how a source is dealt to shards follows from its own number of documents alone: `left` of them may be undecided
    done = due.where("p = 0").drop("rate").withColumn("salt", F.lit(0).cast("long"))
    left, turn, most = due.where("p > 0").drop("rate").withColumn("left", F.col("n_docs")), 0, largest
    while True:
        turn += 1
        shards = F.ceil(F.col("left") / shard)
        salt = F.when(F.col("left") <= shard, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "size", F.lit(turn)), F.greatest(shards, F.lit(1)).cast("long"))).cast("long")
        rows = left.withColumn("salt", salt).select("id", "source", "size", "source_size", "n_docs", "target", "whole", "p", "salt", "left")
        flying = tables.keep(rows.groupBy("source", "salt").applyInPandas(flown, schema + ", left long"))
        settled = (F.col("p") < EDGE) | (F.col("p") > 1 - EDGE) | (F.col("salt") < 0)
        done = done.unionByName(flying.where(settled).drop("left"))
        if most <= shard:
            break
        left = flying.where(~settled).drop("salt").withColumn("left", (F.ceil(F.col("left") / shard) * (reserve + 2)).cast("long"))
        most = -(-most // shard) * (reserve + 2)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
