"""Makes the package importable on executors that have no copy of it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


@functools.cache
def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="shardloom-"), "shardloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f.relative_to(ROOT.parent))
    return path


def shipped(query):
    """query(spark, sf_dir), with this package sent to the executors first, once a session."""

    def run(spark: SparkSession, sf_dir: str):
        if not any(x.endswith("/shardloom.zip") for x in spark.sparkContext.listFiles):
            spark.sparkContext.addPyFile(_archive())
        return query(spark, sf_dir)

    return run
