"""The folder that the driver and all executors can read and write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As named by ``spark.checkpoint.dir``. Where it is unset, a session on one machine (master
    ``local``) gets a temporary folder; a cluster gets an error, as its executors could not see one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes for plans of this session that run from now on.

    Spark's own bound for a batch is 10,000 rows, and a far larger number of bytes: two tasks of an
    executor would hold it several times over, in the JVM and in their workers. A smaller bound that
    the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= most:
        spark.conf.set(name, str(most))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system.

    Workers outlive their tasks, and both Arrow's pool and the C library keep freed memory, which
    would add up over the stages of a job to more than any one of them needs.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
