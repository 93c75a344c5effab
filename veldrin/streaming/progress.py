"""Streaming twins: answers arrive in files, and counts grow as they come; late and repeated deliveries are settled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import shared_dir


def answer_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """The files of a table as a stream; ``path`` is a folder of files or one file."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    if [f.rpartition("/")[2] for f in there.inputFiles()] == [name]:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def first_deliveries(answers: DataFrame, delay: str = "60 days") -> DataFrame:
    """Each run once, however often it is delivered, as long as the deliveries are no further apart than ``delay``."""
    stamped = answers.withColumn("received", F.col("received_at").cast("timestamp"))
    return stamped.withWatermark("received", delay).dropDuplicatesWithinWatermark(["run_no"])


def daily_progress(answers: DataFrame) -> DataFrame:
    """Counts per engine and day on which a run started, however late its file comes: there is no watermark, and the
    state is one row for each day and engine."""
    stamped = answers.withColumn("started", F.col("started_at").cast("timestamp"))
    grouped = stamped.groupBy(F.window("started", "1 day").alias("w"), "engine")
    right = F.count_if(F.coalesce("valid", F.lit(False)) & F.coalesce("correct", F.lit(False)))
    return grouped.agg(F.count("*").alias("n"), right.alias("correct")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "engine", "n", "correct")


def drained(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all that is there now and give the last state of each key."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    out = spark.read.schema(schema).parquet(f"{base}/out")
    return out.groupBy(*keys).agg(F.max(F.struct("epoch", *rest)).alias("t")).select(*keys, *(f"t.{c}" for c in rest))
