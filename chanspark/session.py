"""Session helpers: sending the package to Python workers, and the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: nothing to do where PYTHONPATH has it, else as a zip file.

    Spark's file server hands the zip to executors, so no shared folder is needed. Done once a session.
    """
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == _ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or getattr(context, "_chanspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="chanspark-")) / "chanspark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "chanspark").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT).as_posix())
    context.addPyFile(str(archive))
    context._chanspark_shipped = True


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a local folder if all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
    return tempfile.gettempdir()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below shared_base()."""
    return f"{shared_base(spark)}/chanspark-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
