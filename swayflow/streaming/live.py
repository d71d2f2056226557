"""Streaming forms (an extension: band-limited speed can't be streamed, its filters look ahead)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_bins(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """id, ts, v: mean and count per id and time bin; rows later than the watermark are left out by Spark."""
    return stream.withWatermark("ts", late).groupBy("id", F.window("ts", width)).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def live_segments(stream: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Parts of each id's clock without a step over the gap."""
    return stream.withWatermark("ts", late).groupBy("id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def without_repeats(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "ts"])


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir, or under the warehouse where that is unset; it is deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/live-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def drained(live: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a live form over what its source holds now, and gives the result as it then stands (mode complete) or all rows it put out (append)."""
    spark = live.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    run = live.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{folder}/out")
