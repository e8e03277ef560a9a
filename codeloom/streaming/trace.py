"""Event logs as streams: windows, sessions and brackets with state.

``settled`` runs a stream over all that is there now and returns the last result;
a service starts the same DataFrames with its own trigger and sink.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import shared


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Parquet files of a path as a stream, with the schema of those that are there.

    The stream takes folders and patterns; the pattern makes a single file one too.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def replayed(table: DataFrame, time: str, rows: int = 3_000_000) -> DataFrame:
    """A table at rest as a stream that comes in the order of its times, about ``rows`` rows a batch.

    Ranges of time are written one after the other, one file each, and are read in
    the order of their writing, one a batch: no batch, and so no key's state, is
    as large as the table, and no row comes behind the watermark.
    """
    spark, at = table.sparkSession, F.unix_micros(F.col(time).cast("timestamp"))
    n, where = max(1, -(-table.count() // rows)), shared.path(spark, "replay")
    bounds = table.select(at.cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    nth = sum(((at > F.lit(b)).cast("int") for b in sorted(set(bounds))), F.lit(0))
    for i in range(len(set(bounds)) + 1):
        table.filter(F.coalesce(nth, F.lit(0)) == i).repartition(1).write.parquet(f"{where}/{i:06d}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/*")


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need instants: local times count as of the session's time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, size: str, late: str, *key: str) -> DataFrame:
    """Rows a window and key; with a watermark the state of closed windows goes (in append mode)."""
    some = _timed(stream, time, late).groupBy(F.window(time, size).alias("w"), *key).agg(F.count("*").alias("n"))
    return some.select(F.col("w.start").alias("start"), *key, "n")


def sliding(stream: DataFrame, time: str, size: str, step: str, late: str) -> DataFrame:
    some = _timed(stream, time, late).groupBy(F.window(time, size, step).alias("w")).agg(F.count("*").alias("n"))
    return some.select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *key: str) -> DataFrame:
    """Rows a session: events of a key less than ``gap`` apart."""
    some = _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), *key).agg(F.count("*").alias("n"))
    return some.select(F.col("w.start").alias("start"), *key, "n")


def open_brackets(stream: DataFrame, part: str, order: str, up: Column, down: Column) -> DataFrame:
    """(order, depth): brackets open after each event, kept as one number a key between batches.

    Batches come in the log's order; within a batch a key's events are sorted.
    """
    steps = stream.select(part, order, F.when(up, 1).when(down, -1).otherwise(0).alias("step"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        depth = rows["step"].cumsum() + (state.get[0] if state.exists else 0)
        state.update((int(depth.iloc[-1]),))
        yield pd.DataFrame({order: rows[order], "depth": depth})

    return steps.groupBy(part).applyInPandasWithState(run, f"{order} long, depth long", "depth long", "append", GroupStateTimeout.NoTimeout)


def settled(stream: DataFrame, mode: str = "complete", store: str | None = None) -> DataFrame:
    """Run to the end of what is there; the rows of the last batch (complete) or of all (append).

    ``store``: the state store's provider, where the default one will not do.
    """
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if store:
        spark.conf.set(setting, store)
    try:
        return _settled(stream, mode)
    finally:
        if store:
            spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def _settled(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    out = shared.path(spark, "stream")
    last: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        last.append(n)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/rows/batch={n}" for n in (last[-1:] if mode == "complete" else sorted(set(last)))]
    return spark.read.schema(stream.schema).parquet(*paths)
