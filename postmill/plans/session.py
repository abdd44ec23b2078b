"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine with the settings that the engine expects."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that Python functions can import it there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, path.relative_to(top.parent).as_posix())
        target = os.path.join(tempfile.mkdtemp(prefix="postmill-"), f"{top.name}.zip")
        Path(target).write_bytes(packed.getvalue())
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share, below ``spark.checkpoint.dir``; a local session without that setting gets a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="postmill-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: nothing more can be done from here
        return
