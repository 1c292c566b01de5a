"""Give executors the package when it isn't installed there.

The package is zipped once per session and handed to Spark with
``addPyFile`` (``addArtifacts`` on sessions without a SparkContext), so Python
workers can import it whatever folder the driver was started from.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
_SENT: set[str] = set()


@functools.cache
def code_digest() -> str:
    """Digest of the package's own modules: part of the names of stored views,
    so that a view is never read by code that would make another one."""
    found = hashlib.md5()
    for folder, _, names in sorted(os.walk(ROOT)):
        if os.path.basename(folder) in ("operators", "sources", "functions"):
            for name in sorted(n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name), "rb") as f:
                    found.update(name.encode() + f.read())
    return found.hexdigest()[:12]


def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="pathsift-"), "pathsift.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a SparkContext
        if "remote" not in _SENT:
            spark.addArtifacts(_archive(), pyfile=True)
            _SENT.add("remote")
        return
    if sc.applicationId not in _SENT:
        sc.addPyFile(_archive())
        _SENT.add(sc.applicationId)


def on_executors(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    return run
