"""Helpers that the operators share: words, shared files, stored tables, bounded Arrow slices."""

from __future__ import annotations

import atexit
import gc
import mmap
import os
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 pattern of a white-space separated word.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a worker handles at a time, and bytes that it is sent at a time.
SLICE_BYTES, SENT_BYTES = 4 << 20, 4 << 20

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: A-Z lower-cased; all ASCII but digits and letters becomes a space.
ALNUM = bytes(LOWER[i] if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; any other session is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/postmill-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended: nothing more can be done from here
        return


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str, home: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder, or in ``home`` below it, and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{home}/{name}-{uuid.uuid4().hex}" if home else new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` in one, so that none of their names meets an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_row")[c].alias(c) for c in names]


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage.

    Twice, as the scheduler may still hold the job that has just ended.
    """
    for pause in (0.2, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_file(uri: str, *parts: bytes) -> None:
    """Writes a file of the shared folder; a repeated task replaces it with the same bytes."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(path) as out:
            for part in parts:
                out.write(part)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for part in parts:
            out.write(part)
    os.replace(own, path)


def map_file(uri: str) -> memoryview:
    """A file of the shared folder, memory-mapped where the folder is mounted."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        return memoryview(system.open_input_file(path).read_buffer())
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return memoryview(b"")
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes: 10,000 rows of text, Spark's own bound, are many MB on either side."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_BYTES))
    return df.mapInArrow(run, schema)


class Held:
    """Parsed files of the shared folder. The least recently used are let go beyond ``limit`` bytes read into memory, or ``files`` mapped ones, whose pages the system may drop."""

    def __init__(self, limit: int = 256 << 20, files: int = 1 << 12):
        self.limit, self.files, self.own, self.bytes = limit, files, OrderedDict(), 0

    def get(self, uri: str, parse: Callable[[memoryview], object], optional: bool = False):
        """The parsed file; where there is none, an error, or for an ``optional`` one what ``parse`` makes of no bytes."""
        if uri in self.own:
            self.own.move_to_end(uri)
            return self.own[uri][0]
        try:
            data = map_file(uri)
        except FileNotFoundError:
            if not optional:
                raise
            data = memoryview(b"")
        size = 0 if local_path(uri) else len(data)
        self.own[uri] = parse(data), size
        self.bytes += size
        while len(self.own) > 1 and (self.bytes > self.limit or len(self.own) > self.files):
            self.bytes -= self.own.popitem(last=False)[1][1]
        return self.own[uri][0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
