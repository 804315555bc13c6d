"""Streaming ingest: what comes again within a short time is dropped, the rest goes to the index in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.text import content_hash


def deduplicated(stream: DataFrame, within: str = "2 minutes") -> DataFrame:
    """Rows of a stream (doc_id, title, source_type, source_path, text, ts), each (doc_id, content) once within the watermark. A change of title, type or path is a change."""
    whole = F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in ("title", "source_type", "source_path", "text")])
    return stream.withColumn("content_hash", content_hash(whole)).withWatermark("ts", within).dropDuplicatesWithinWatermark(["doc_id", "content_hash"])


def ingest(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, within: str = "2 minutes", after: Callable[[DataFrame], None] | None = None, once: bool = False) -> StreamingQuery:
    """Starts the query: upsert(batch, number) for each batch, then after(its documents' ids (doc_id)), a hook for synchronising elsewhere; it must bear being called again for a batch. once: what is there now, and then it ends."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        upsert(batch, number)
        if after is not None:
            after(batch.select("doc_id").distinct())
        batch.unpersist()

    writer = deduplicated(stream, within).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
