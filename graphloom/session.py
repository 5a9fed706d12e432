"""What every job needs from its session: the shared folder and the package on the workers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that Spark sends to Python, to the end of a row, unless the session says otherwise. Spark's own bound is 10,000 rows of whatever size, which
#: the JVM holds outside of its heap and the worker beside its work. Less than the 8 MB that are worked on at once, or the last row would often be a piece of its own.
BATCH_BYTES, _BATCH_CONF = 7 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not the GNU C library
    _trim = None

_SHIPPED: set[str] = set()
#: Tables of each application that no scope holds, and those of the scope that is open here.
_TABLES: dict[str, list[str]] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Put this package on the Python workers' path, once for each context, and bound the batches that they get."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        tmp = tempfile.mkdtemp(prefix="graphloom-")  # the driver's own; Spark sends the file to the executors
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        with zipfile.ZipFile(at := f"{tmp}/{root.name}.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


def give_back() -> None:
    """Free memory to the system, not to the next task: the worker lives on, beside others and the JVM, and the C library would keep what
    arrays below its own threshold took, which grows with use."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost executor costs
    only the tasks that it ran; what is written stays."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    held = _SCOPE.get()
    (_TABLES.setdefault(spark.sparkContext.applicationId, []) if held is None else held).append(at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, tables: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What written() leaves within is deleted at the end; no other table is. Store results that are made from it before."""
    held: list[str] = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _delete(spark, held)


def release(spark: SparkSession) -> None:
    """Delete the tables that written() left in this application outside of scopes; call it when all results made from them are stored."""
    _delete(spark, _TABLES.get(spark.sparkContext.applicationId, []))
