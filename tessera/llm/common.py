"""Shared helpers: tables written to the cluster's shared folder, and model hand-over to workers.

Executors need this package on their Python path.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of this machine's in local mode; a cluster must name one."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local_dir:
        d = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(d.cleanup)
        _local_dir.append(d.name)
    return _local_dir[0]


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one operator call, in the shared folder: each cuts the lineage, so a lost executor costs one stage. only() drops those that the result doesn't need; the rest go when the driver's Python ends."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0, set()
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        conf, clean = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = conf.get(clean, "false")
        conf.set(clean, "true")  # the table replaces the shuffles that it was made with
        try:
            df.write.option("compression", "snappy").parquet(path)
        finally:
            conf.set(clean, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        self.paths.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        self.paths.discard(df._tessera_path)
        drop_table(self.spark, df._tessera_path)

    def only(self, *needed: DataFrame) -> None:
        """Drops all tables but these."""
        for path in self.paths - {df._tessera_path for df in needed}:
            self.paths.discard(path)
            drop_table(self.spark, path)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            drop_table(self.spark, self.root)


_models: dict[str, object] = {}


def worker_model(key: str, build):
    """One model for each Python worker and key."""
    if key not in _models:
        if len(_models) > 8:
            _models.clear()
        _models[key] = build()
    return _models[key]


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def held_out(id_col, modulus: int, remainder: int):
    """crc32 of the id as text; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
