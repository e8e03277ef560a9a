"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One separator of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]"
NOT_SEPARATOR = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) a local folder is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"


class Job:
    """Owns the tables stored while it is active; in each thread the innermost active job takes them."""

    _active: ContextVar[Job | None] = ContextVar("job", default=None)

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def active(self) -> Iterator[Job]:
        token = Job._active.set(self)
        try:
            yield self
        finally:
            Job._active.reset(token)

    def discard(self, spark: SparkSession, reader: DataFrame | None = None) -> None:
        """Empty the job's tables, but for those that ``reader`` reads; for a job whose own result is written."""
        files = reader.inputFiles() if reader is not None else []
        held = [p for p in self.paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
        for path in self.paths:
            if path not in held:
                spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
        self.paths = held


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without repeating what came before.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if job := Job._active.get():
        job.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, content: bytes, name: str) -> str:
    """Write a file of bounded size to the shared folder and send it to every executor, those started later included.

    Gives the name by which ``SparkFiles.get`` finds it.
    """
    path = shared_path(spark, name)
    # as "string" the bytes are written as they are, with a line feed behind them
    one = spark.createDataFrame([(bytearray(content),)], "value binary").select(F.col("value").cast("string").alias("value"))
    one.coalesce(1).write.text(path)
    (file,) = spark.read.text(path).inputFiles()
    spark.sparkContext.addFile(file)
    return file.rsplit("/", 1)[1]


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, stored stages.

    The cleaner follows the driver's garbage collector, which by default runs
    every half hour only; long jobs would keep every stage's files until then.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
