"""Structured Streaming: ingest of files as they come, and windows over events.

The windows over events extend what document retrieval needs; ingest is the background upload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunk, embed
from lectern.sources import files
from lectern.sources.store import ChunkStore


def ingest_stream(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, make=None, strategy: str = "recursive", status: str | None = None, events: str | None = None):
    """A started query that parses, cleans, chunks, embeds and upserts every new file of a folder; documents are known by their whole path.

    status: a folder to which (doc_id, state, error, epoch) of every file is added, `done` or `failed`. events: a folder to which what happens
    to files is added as it does, for `status.follow`; a batch that is run again tells it again.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def tell(rows: DataFrame, event, error) -> None:
        if events is not None:
            rows.select("doc_id", event.alias("event"), error.cast("string").alias("error"), F.current_timestamp().alias("at")).write.mode("append").parquet(events)

    def write(batch: DataFrame, epoch: int) -> None:
        tell(batch.select(F.col("path").alias("doc_id")), F.lit("started"), F.lit(None))
        named = batch.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), files.kind(F.col("path")).alias("file_type"), "content")
        loaded = files.load(named.withColumn("file_name", F.col("path"))).persist()  # files are parsed once, for their status and their chunks
        told = loaded.groupBy(F.col("file_name").alias("doc_id")).agg(F.max("error").alias("error"))
        if status is not None:
            told.select("doc_id", F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("state"), "error", F.lit(epoch).alias("epoch")).write.mode("overwrite").parquet(f"{status}/epoch={epoch}")
        docs = loaded.where("error is null").groupBy(F.col("file_name").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_num", "text")))["text"], "\n\n").alias("text"))
        rows = chunk.process(docs, strategy)
        store.upsert(embed.usable(embed.vectorise(rows, make)) if make else rows)
        tell(told, F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")), F.col("error"))
        loaded.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) per window; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events with smaller gaps."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
