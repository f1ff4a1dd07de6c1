"""Structured Streaming over event tables: windows with late data, deduplication, ledger upserts per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.feedback import merged_ledger
from tracewright.sources.scratch import path_exists, shared_folder


def read_events(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """A folder of parquet files (or one file) as a stream."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Counts per window and type; events later than the watermark no longer change a window."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def all_windowed_counts(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Counts per window and type of all that a stream yields from what is there now, however late an event comes.

    Each micro-batch writes its own counts, named by the batch, and a window's count is their sum: a late event
    adds to its window, the last windows count too, and no state is kept. Events without a time have a window of their own.
    """
    spark = events.sparkSession
    out = shared_folder(spark, "window-counts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.timestamp_micros(at - F.pmod(at, F.lit(seconds * 1_000_000)))
    rows = events.select(start.alias("start"), "event_type")

    def keep(batch: DataFrame, no: int) -> None:
        batch.groupBy("start", "event_type").agg(F.count("*").alias("events")).write.mode("overwrite").parquet(f"{out}/batch={no}")

    rows.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    schema = rows.withColumn("events", F.lit(0).cast("long")).schema
    parts = spark.read.schema(schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], schema)
    return parts.groupBy("start", "event_type").agg(F.sum("events").alias("events"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark; state is dropped after it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields from what is there now, written as parquet and read back."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    stream.writeStream.option("checkpointLocation", f"{out}-state").outputMode(mode).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def ledger_versions(spark: SparkSession, folder: str) -> list[int]:
    """The batch ids of a ledger's complete versions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def read_ledger_versions(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The last complete version of a ledger, or the last before a batch; empty without one."""
    there = [v for v in ledger_versions(spark, folder) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{folder}/version={there[-1]}") if there else spark.createDataFrame([], schema)


def upserted_ledger(stream: DataFrame, schema: str, key: str, folder: str | None = None, order: str | None = None) -> DataFrame:
    """Feedback across runs: every micro-batch is merged into a ledger keyed by `key`, as a version named by the batch.

    A version is made from the last one before its batch and overwrites what an earlier try at it left, so a
    batch that is replayed, after a failure or a restart, gives the same version again. With a `folder` of one's own the ledger and
    the stream's checkpoint live on, and the next run goes on from both. Of a batch's rows of one key the last by
    `order` counts, or without one the largest by all columns.
    """
    spark = stream.sparkSession
    out = (folder or shared_folder(spark, "ledger")).rstrip("/")
    columns = spark.createDataFrame([], schema).columns
    rest = [c for c in columns if c != key]

    def merge(batch: DataFrame, no: int) -> None:
        at = F.struct(*([order] if order else []), *rest)
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")
        merged_ledger(read_ledger_versions(spark, out, schema, no), last, key).select(*columns).write.mode("overwrite").parquet(f"{out}/version={no}")

    stream.writeStream.option("checkpointLocation", f"{out}/_checkpoint").foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    return read_ledger_versions(spark, out, schema)
