"""Index maintenance from Structured Streaming.

Assigning a row to its nearest centre needs no state, so each micro-batch is
assigned and stored on its own. A micro-batch writes the part named by its stream
and its number, so one that is run again after a failure replaces what it wrote
before. The stream's id is the one that its checkpoint holds: it outlives a
restart, and another stream, with a checkpoint of its own, has another.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.plans.ivf import IvfIndex


def insert_stream(index: IvfIndex, stream: DataFrame, checkpoint: str, name: str = "stream",
                  available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Insert the rows of a stream into an inverted-list index; centres never move."""

    def store(batch: DataFrame, number: int) -> None:
        index.insert(batch, part=f"{name}-{stream_id(batch, checkpoint)}-{number:012d}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def stream_id(df: DataFrame, checkpoint: str) -> str:
    """The id of the stream a checkpoint belongs to."""
    return json.loads(df.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
