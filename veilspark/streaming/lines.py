"""Streams of lines: redacted rows out, running counts beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report as R
from ..plans.sanitizer import Sanitizer


def write_redacted(sanitizer: Sanitizer, stream: DataFrame, path: str, checkpoint: str, column: str = "line", **trigger) -> StreamingQuery:
    """Redacted lines as text files, exactly once a checkpoint."""
    out = sanitizer.sanitize_stream(stream, column).select(F.col(column).alias("value"))
    writer = out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_counts(sanitizer: Sanitizer, stream: DataFrame, column: str = "line") -> DataFrame:
    """Counts by rule over all that came; Spark keeps the sums as state."""
    rows = sanitizer.transform(stream, column).select(F.explode("redacted.matches").alias("m"))
    return R.counts(rows.select("m.rule_id"))


def with_batches(sanitizer: Sanitizer, stream: DataFrame, each, checkpoint: str, column: str = "line", **trigger) -> StreamingQuery:
    """Calls each(redacted rows, batch number) for every batch: for sinks of one's own and reports to merge."""
    writer = sanitizer.transform(stream, column).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
