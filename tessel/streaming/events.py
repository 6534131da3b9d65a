"""Event streams: response events of conversations, and windowed counts that work on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery


def conversation_events(turns: DataFrame) -> DataFrame:
    """A row per event: meta at the first turn, done at the last, tokens between, in order, with its JSON line."""
    w = W.partitionBy("conv_id")
    kind = F.when(F.col("turn") == F.min("turn").over(w), "meta").when(F.col("turn") == F.max("turn").over(w), "done").otherwise("token")
    out = turns.select("conv_id", F.col("turn").alias("seq"), kind.alias("kind"), "text")
    return out.withColumn("line", F.to_json(F.struct("kind", "text")))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals by window and type; on a stream, windows close ``late`` after their end."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def log_rows(answers: DataFrame) -> DataFrame:
    """Rows of the query log: ``answers`` with the ids they gave, an array, as a JSON list in their order; none is []."""
    ids = F.coalesce("result_ids", F.array().cast(answers.schema["result_ids"].dataType))
    return answers.withColumn("result_ids", F.to_json(F.transform(ids, lambda i: i.cast("string"))))


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet log, once per available input; a restart resumes from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def incremental_index(docs: DataFrame, out: str, checkpoint: str, build) -> StreamingQuery:
    """Index documents as they arrive: ``build`` maps a batch of rows to index rows, written to a folder of its batch.

    A batch that is repeated after a fault overwrites its own folder, so that nothing is indexed twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
