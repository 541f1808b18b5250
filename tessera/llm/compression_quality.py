"""Quality classifier by compression: one zstandard dictionary built from good text, one from bad.

A text is compressed whole with each dictionary. The difference of the two sizes, normalised by their sum and by the text's
length, is calibrated to a probability by a logistic curve along the size level (with the good dictionary, a byte) and the
length: a difference means more in a long text, and as much in a text that both dictionaries shrink to nothing.

Fitting uses a bounded sample: up to `per_class` labelled rows of each label, the first in the order of a
hash of the id, and of these no more than `sample_bytes` of text. Every second one builds the dictionaries, the others calibrate, weighed to the label
shares among all labelled rows. The curve's Newton steps are halved until the penalised likelihood, which has one maximum, rises; if they
don't settle, fitting raises an error. Reruns fit the same model.

Cases: null and empty texts are scored as texts of no bytes; repeated rows are scored alike; null labels
don't count, and an id labelled twice counts with its higher label; with no labels of one kind all scores
are the other label's share (0.5 with no labels at all); very long texts are compressed whole; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import held_out, worker_model

LEVEL, DICTIONARY_BYTES = 3, 112 << 10


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, in_training, per_class: int, sample_bytes: int, id_col: str, text_col: str) -> tuple[list[tuple], dict[int, int]]:
    """(text, label) of up to per_class rows of each label and sample_bytes of text in all, and the number of labelled rows of each."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").where(in_training(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size")).where("id is not null").groupBy("id").agg(F.max("size").alias("size"))
    ids = known.join(sizes, "id")
    shares = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    rows = []
    for y in sorted(shares):
        rows += ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()  # ids and sizes only
    chosen, room = [], {y: sample_bytes // 2 for y in shares}
    for r in rows:
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            chosen.append((r["id"], r["y"]))
    if not chosen:
        return [], shares
    chosen = docs.sparkSession.createDataFrame(chosen, StructType([StructField("id", docs.schema[id_col].dataType), StructField("y", IntegerType())]))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sorted((r["id"], r["text"], r["y"]) for r in found.collect())
    return [(t, y) for _, t, y in sample], shares


class Model:
    def __init__(self, sample: list[tuple[str, int]], shares: dict[int, int]) -> None:
        self.key = uuid.uuid4().hex
        self.constant = None
        total = sum(shares.values())
        if any(not shares.get(y) for y in (0, 1)):
            self.constant = shares.get(1, 0) / total if total else 0.5
            return
        texts = {y: [t.encode() for t, z in sample if z == y] for y in (0, 1)}
        self.dictionaries = [self.dictionary(texts[y][::2]) for y in (1, 0)]
        rows = [(t, y) for y in (0, 1) for t in (texts[y][1::2] or texts[y])]
        if len({y for _, y in rows}) < 2:  # no text of one label fits the sample
            self.constant = shares[1] / total
            return
        x, y = np.array([self.features(t) for t, _ in rows]), np.array([y for _, y in rows], float)
        weights = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum()) * len(y) / total
        self.low, self.high = x.min(0), x.max(0)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        self.coefficients = self.fit(self.design(x), y, weights)

    @staticmethod
    def dictionary(texts: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, [t for t in texts if t]).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text: it serves as it is
            return b"\n".join(texts)[-DICTIONARY_BYTES:] or b"\n" * 8

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        def build():
            out = []
            for d in self.dictionaries:
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z))
            return out

        return worker_model(self.key, build)

    def features(self, text: bytes) -> list[float]:
        good, bad = (len(c.compress(text)) for c in self.compressors())
        n = len(text) + 1
        return [(good - bad) / (good + bad), (good - bad) / n, good / n, np.log(n)]

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (np.clip(x, self.low, self.high) - self.mean) / self.spread
        by_sum, by_length, level, length = z.T
        return np.c_[z, z * z, by_sum * level, by_sum * length, by_length * length, level * length, np.ones(len(z))]

    @staticmethod
    def fit(a: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.1) -> np.ndarray:
        """A ridge logistic regression by damped Newton steps."""
        w = np.zeros(a.shape[1])

        def likelihood(w: np.ndarray) -> float:
            z = a @ w
            return float((weights * (y * z - np.logaddexp(0, z))).sum() - ridge / 2 * w @ w)

        now = likelihood(w)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            slope = a.T @ (weights * (y - p)) - ridge * w
            step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
            if slope @ step < 1e-9 * len(y):
                return w
            size = 1.0
            while (new := likelihood(w + size * step)) <= now and size > 1e-12:
                size /= 2
            if new <= now:  # as near as doubles get
                break
            w, now = w + size * step, new
        if slope @ step > 1e-5 * len(y):
            raise ArithmeticError("the calibration doesn't settle")
        return w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        a = self.design(np.array([self.features(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(a @ self.coefficients, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, remainder: int = 1, per_class: int = 1600, sample_bytes: int = 64 << 20) -> Model:
    sample, shares = labelled_sample(docs, labels, label_col, lambda c: ~held_out(c, modulus, remainder), per_class, sample_bytes, id_col, text_col)
    return Model(sample, shares)


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score in 0..1 appended (replacing a column of that name). The model is two dictionaries of fixed size."""
    src = docs.drop(score_col)
    names, at = src.columns, src.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            s = np.concatenate([m.scores([x.as_py() or b"" for x in texts[i : i + 512]]) for i in range(0, len(texts), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, score_col])

    schema = StructType([*src.schema.fields, StructField(score_col, DoubleType())])
    return src.mapInArrow(scored, schema)


def quality_report(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = fit_quality(docs, labels, modulus=modulus, remainder=remainder)
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
