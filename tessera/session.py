"""Sessions and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import wraps
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def on_workers(f):
    """f(spark, ...), with this package on the Python path of the workers that it starts (where they find it under the same path as the driver)."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kw):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = ":".join([ROOT, *paths])
        return f(spark, *args, **kw)

    return run


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the deployment's own session is used."""
    settings = {"spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"} | conf
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dir: list[tempfile.TemporaryDirectory] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a new folder under spark.checkpoint.dir, which all executors share. Only in local mode may that be unset: then it's one of this machine's, for this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local_dir:
            _local_dir.append(tempfile.TemporaryDirectory(prefix="spark-"))
            atexit.register(_local_dir[0].cleanup)
        root = _local_dir[0].name
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; an empty one, if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
