"""Paths and intermediate tables shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"  # the white space that separates words: [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local folder is made if
    Spark runs on this machine alone; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="twinframe-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` other than those an operator is about to add (case does not count, as in Spark)."""
    added = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in added]


def train_rows(df: DataFrame) -> DataFrame:
    """Rows a model may learn from: crc32 of doc_id as text, modulo 3, is not 1."""
    return df.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) != 1)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20  # bytes of an Arrow batch


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """While this holds, Arrow batches have few rows, and BATCH bytes at most: for steps whose rows are large."""
    before = {name: spark.conf.get(name, None) for name in (ROWS, BYTES)}
    spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, str(BATCH))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches to `rows` rows and BATCH bytes, for jobs over whole texts: the JVM holds a batch
    outside its heap, the worker another, and the size is read only when a job runs. A lower setting stays."""
    if not 0 < int(spark.conf.get(ROWS)) <= rows:
        spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, str(BATCH))


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage and return what their heaps no longer need: a heap that has grown keeps
    its size otherwise, beside the Python workers of the next stage. One task for each core, so that idle executors each
    get theirs; whether one is left out changes no result."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def slices(sizes: list[int], most: int):
    """(from, to) runs of rows with about `most` bytes or entries each, so that few Python objects live at once."""
    start = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column, most: int = 1 << 19):
    """(from, to) runs of the rows of an Arrow column of texts, of about `most` bytes each."""
    import pyarrow.compute as pc

    return slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def give_back() -> None:
    """Returns freed memory of a Python process to the system: workers stay alive between tasks, the driver between jobs."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
