"""Postings as a stream: deduplication, first and last sight, weekly counts, and a batch check against all history.

Each function takes a streaming DataFrame and returns one; `settle` runs a stream over what is there and gives the
result as a table in the shared checkpoint folder. Late rows past the watermark are dropped where a watermark is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.operators import stores
from postlode.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def first_of_key(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of each key, the key remembered for `delay` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sightings(stream: DataFrame, key: str, time: str) -> DataFrame:
    """First and last sight and number of each key so far."""
    return stream.groupBy(key).agg(F.min(time).alias("first_seen_at"), F.max(time).alias("last_seen_at"), F.count(F.lit(1)).alias("times_seen"))


def weekly(stream: DataFrame, key: str, time: str, delay: str | None = None) -> DataFrame:
    """Rows a key and Monday week; with a delay, weeks close and late rows are dropped."""
    s = stream.withWatermark(time, delay) if delay else stream
    w = F.window(time, "7 days", "7 days", "4 days")
    return s.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("week"), "n")


def settle(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all data available and return its result table."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{base}/table").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/table")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table")


def sliding(stream: DataFrame, key: str, time: str, days: int, every: int = 1, delay: str | None = None) -> DataFrame:
    """Rows a key in look-backs of `days` days that end every `every` days."""
    s = stream.withWatermark(time, delay) if delay else stream
    return s.groupBy(key, F.window(time, f"{days} days", f"{every} days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.end").alias("until"), "n")


def against_seen(stream: DataFrame, seen: DataFrame, key: str, out_path: str, checkpoint: str) -> None:
    """Write the rows whose key neither the seen table nor an earlier batch has, batch by batch, under out_path/batch=N:
    unbounded history in tables, not in state. The rows written are themselves the record of what is seen since, so there
    is one write a batch; a batch that is run again after a failure ignores its own part and overwrites it whole."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = stores.unseen(batch.dropDuplicates([key]), seen, key)
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_path)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            earlier = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, batch bigint").parquet(out_path).where(F.col("batch") < number)
            fresh = stores.unseen(fresh, earlier, key)
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
