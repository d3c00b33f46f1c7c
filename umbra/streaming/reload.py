"""Streams whose dimension is a file that may change between micro-batches.

Each micro-batch asks ``sources.files.Reloaded`` for the file's content once, on the driver, and
works with that version alone.  While the file cannot be parsed, the last good version stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.files import Reloaded


def with_versions(stream: DataFrame, held: Reloaded, apply: Callable[[DataFrame, object], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that writes ``apply(rows, content)`` of each micro-batch below ``path``, with the batch and the content's version.

    A batch that is done again after a failure overwrites what it had written, in its own folder
    ``batch=n``.  ``once`` handles what is there and ends.
    """

    def step(rows: DataFrame, batch: int) -> None:
        content = held.get()
        done = apply(rows, content).withColumn("version", F.lit(held.version))
        done.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
