"""What both jobs' command lines share: a JSON config file, options that override it, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.session import on_workers

LOG = logging.getLogger("tessera.jobs")


def settings(argv: list[str] | None, about: str, default_config: str, paths: list[str]) -> dict:
    """The config file's settings; those of `paths` can be given as options as well."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", default=str(Path(__file__).with_name(default_config)), help="JSON file with the job's settings")
    for name in paths:
        p.add_argument(f"--{name}", help=f"overrides the config file's {name}")
    given = vars(p.parse_args(argv))
    return json.loads(Path(given.pop("config")).read_text()) | {k: v for k, v in given.items() if v is not None}


def main(job: Callable[..., DataFrame], argv: list[str] | None, about: str, default_config: str, paths: list[str]) -> None:
    """Runs a job in a session of its own, which spark-submit or the environment configures."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = settings(argv, about, default_config, paths)
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        on_workers(job)(spark, **chosen)
    finally:
        spark.stop()
