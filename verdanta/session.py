"""Session settings that every query of the engine relies on."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: UTC times, key-wise overwrite of partitions, run-time re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str = "local[*]", app: str = "verdanta", **conf: str) -> SparkSession:
    """A session with the engine's settings; names in ``conf`` have ``__`` for a dot."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def timed(name: str) -> Iterator[dict[str, float]]:
    """Log how long a block takes; the dictionary has the seconds once it ended."""
    took: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield took
    finally:
        took["seconds"] = time.perf_counter() - began
        logging.getLogger("verdanta").info("%s took %.2f s", name, took["seconds"])
