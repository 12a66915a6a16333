"""What the jobs share: their command line, their configuration and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str) -> dict:
    """A JSON object of one file, read by Spark, so that it may lie wherever the tables do."""
    return json.loads(spark.read.option("wholetext", "true").text(path).first().value)


def command(name: str, about: str, paths: list[str], job: Callable[..., DataFrame], argv: list[str] | None = None) -> int:
    """Runs ``job(spark, *paths, **config)`` in a session of its own; paths are plain arguments, options come from the file."""
    from corpusloom.session import session

    parser = argparse.ArgumentParser(prog=name, description=about)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", help="JSON file of options")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(name)
    try:
        options = configured(spark, args.config) if args.config else {}
        log.info("%s: options %s", name, json.dumps(options, sort_keys=True))
        rows = job(spark, *(getattr(args, p) for p in paths), **options)
        log.info("%s: the output holds %d rows", name, rows.count())
        return 0
    finally:
        spark.stop()
