"""What executors need of the driver: this package, and a folder that all share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers can import the package afterwards, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docketmill-")) / "docketmill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = Path(folder, name)
                    archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset and all runs in one process
    on this machine, as in tests, one of our own; on a cluster there is no folder to be guessed, which is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own(spark.sparkContext.applicationId)


@cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="docketmill-")
