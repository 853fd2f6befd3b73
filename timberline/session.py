"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests, a local temporary folder is used, and set for checkpoints; on
    several machines that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="timberline-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = _LOCAL[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables that were written whole under a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [f.getPath() for f in fs.listStatus(folder)]
    return sorted(f.getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


_SHIPPED = "timberline.zip"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run; once per Spark context."""
    sc = spark.sparkContext
    if any(str(f).endswith(_SHIPPED) for f in sc._python_includes):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="timberline-")
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, _SHIPPED)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
