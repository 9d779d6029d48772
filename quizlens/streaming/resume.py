"""A control sink fed by a file stream: a restart takes up only files that no finished batch has seen.

The checkpoint remembers files, and a batch's rows that the sink already holds (written just before a kill) are left
out by id, so each item is written once. Stopping between batches loses nothing.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.control import pending
from ..sources.files import append_control, read_done

ITEMS = "item_no long, item_id string, domain string, question string, options array<string>, answer string"


def control_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], files_per_batch: int = 100, schema: str = ITEMS) -> StreamingQuery:
    """Start the stream over the Parquet files there are now; ``build`` makes control rows of pending items."""

    def write(batch: DataFrame, _: int) -> None:
        append_control(build(pending(batch, read_done(spark, sink))), sink)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_stopped(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGTERM, signal.SIGINT), poll: float = 0.2) -> int:
    """Wait for the stream's end. On one of the signals the batch at hand is finished, then the stream is stopped.

    Returns an exit code: 0 when all is done, 1 when stopped early, so that a scheduler starts the job again. A batch that
    begins while the stream is being stopped is not committed, and its rows are written by the next run.
    """
    asked = threading.Event()
    before = {s: signal.signal(s, lambda *_: asked.set()) for s in signals}
    try:
        while not asked.is_set():
            if query.awaitTermination(poll):
                return 0
        done = len(query.recentProgress)
        while query.isActive and query.status["isTriggerActive"] and len(query.recentProgress) == done:
            if query.awaitTermination(poll):
                return 0
        query.stop()
        return 1
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
