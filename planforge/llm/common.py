"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_ids(df: DataFrame, key: str) -> None:
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} has to be an integer column, not {df.schema[key].dataType.simpleString()}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Only a local master (tests) gets a folder of this machine where neither is set; a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(shared_dir, "own", None)
        if not path:
            path = shared_dir.own = tempfile.mkdtemp(prefix="planforge-shared-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.rstrip("/")


#: Rows and bytes of an Arrow batch while a table is written, as a row here is a whole text; a longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ARROW_ROWS rows and about ARROW_BYTES for the actions inside; the session's own settings come back after them."""
    prefix = "spark.sql.execution.arrow."
    before = {prefix + name: (spark.conf.get(prefix + name), most) for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES))}
    for name, (own, most) in before.items():
        plain = own.removesuffix("b")
        if not plain.isdigit() or not 0 < int(plain) <= most:
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, (own, _) in before.items():
            spark.conf.set(name, own)


def saved(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage.

    Before that, with `release`, the shuffle files of earlier tables go: Spark deletes them only when the driver
    collects the garbage of their plans. The first round lets go of Python's handles, the second of the plans.
    """
    spark = df.sparkSession
    for _ in range(2 * release):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that saved() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What a worker keeps from batch to batch, by the name of its owner; one owner at a time.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """An object that lives in the worker until another owner wants one, so that a worker never holds two of them."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def begin_task(owner: str | None) -> None:
    if owner not in _kept:
        _kept.clear()


def end_task() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str | None = None) -> DataFrame:
    """mapInArrow; a task drops what another owner has kept in the worker, and gives memory back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a slice stays near `most` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def bounded_sample(rows: DataFrame, text: str, most: int, most_bytes: int = 32 << 20) -> list:
    """At most `most` rows whose texts have `most_bytes` together: those with the smallest hashes of all their columns.

    Texts of more than a 32nd of `most_bytes` aren't sampled. Only about as many rows reach the driver. A row's
    hash covers its text, so a repeated key neither empties nor fills the sample; if fewer rows than expected
    lie below the bound on the hash, it is raised until enough do.
    """
    rows = rows.where(F.octet_length(text) <= most_bytes // 32)
    h = F.xxhash64(*rows.columns)
    share = 1.2 * most / max(1, rows.count())
    while True:
        whole = share >= 0.6
        part = rows if whole else rows.where(h < F.lit(int(-(2**63) + share * 2**64)))
        sizes = part.select(h.alias("h"), F.octet_length(text).alias("size")).orderBy("h").limit(most).collect()
        if whole or len(sizes) == most:
            break
        share *= 2
    n = total = 0
    for r in sizes:
        total += r["size"]
        if total > most_bytes:
            break
        n += 1
    return part.orderBy(h).limit(n).collect() if n else []
