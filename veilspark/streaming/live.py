"""The report of a stream while it runs: counts, first distinct values, preview, as of the last batch.

Each batch is scanned once and summed up by Spark before it meets what is kept, so a rule
that very many lines match sends distinct values to no single task but those that a limit
keeps. What is kept is a folder a batch, written whole before the stream's checkpoint moves
on: a batch that runs again after a failure starts from the folder before it and gives the
same one. A keyed state would have to hold all of a batch's distinct values of a rule in
one task, as rows come to it in no order and the first ones are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import INVALID_OPTION, SanitizerError
from ..operators import report as R
from ..plans.sanitizer import Sanitizer
from ..sources.shared import cut

#: Folders of a snapshot; the last one is written when the others are whole.
VALUES, PREVIEW, COUNTS = "values", "preview", "counts"


class LiveReport:
    """Reports over all lines that came, in the order of batches and, within one, of the order columns.

    folder: where snapshots are kept, shared by driver and executors. most_per_rule: distinct
    values of a rule, as in Sanitizer.report(); counts of those kept stay whole. A value that
    has not come for live_batches batches leaves and makes room; none leave if it is None.
    """

    def __init__(self, sanitizer: Sanitizer, folder: str, order: list[str], column: str = "line", most_per_rule: int = 1000, preview_chars: int = 0, live_batches: int | None = None):
        if most_per_rule < 0 or preview_chars < 0 or (live_batches is not None and live_batches < 1):
            raise SanitizerError(INVALID_OPTION, "most_per_rule and preview_chars are 0 at least, live_batches is 1 at least")
        self.sanitizer, self.folder, self.order, self.column = sanitizer, folder.rstrip("/"), list(order), column
        self.most_per_rule, self.preview_chars, self.live_batches = most_per_rule, preview_chars, live_batches

    def start(self, stream: DataFrame, checkpoint: str, each=None, **trigger) -> StreamingQuery:
        """Runs over a stream with the order columns. each(redacted rows, batch number) gets every batch too, for a sink."""

        def merge(batch: DataFrame, number: int) -> None:
            kept = cut(self.sanitizer.transform(batch, self.column))
            if each is not None:
                each(kept, number)
            self.add(kept, number)

        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # ------------------------------------------------ snapshots

    def _batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the whole snapshots, newest first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        whole = [n for n in names if n.startswith("batch-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/{COUNTS}/_SUCCESS"))]
        return sorted((int(n.removeprefix("batch-")) for n in whole), reverse=True)

    def _read(self, spark: SparkSession, number: int, what: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/batch-{number}/{what}")

    def add(self, kept: DataFrame, number: int) -> None:
        """Adds a batch of redacted rows, which are stored, and writes the snapshot of that number."""
        spark = kept.sparkSession
        before = next((n for n in self._batches(spark) if n < number), None)
        prior = (lambda what: None) if before is None else (lambda what: self._read(spark, before, what))

        seen = R.matches_of(kept, self.order)
        rows = seen.select("rule_id", "original", F.struct("replacement", "context_before", "context_after").alias("shown"), F.lit(1).cast("long").alias("n"), F.struct(F.lit(number).cast("long").alias("batch"), "ord").alias("first"), F.lit(number).cast("long").alias("last"))
        counts = rows.groupBy("rule_id").agg(F.sum("n").alias("n"))
        if (values := prior(VALUES)) is not None:
            rows = rows.unionByName(values)
        rows = rows.groupBy("rule_id", "original").agg(F.min_by("shown", "first").alias("shown"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        if self.live_batches is not None:
            rows = rows.where(F.col("last") > number - self.live_batches)
        rows = cut(rows)
        full = rows.groupBy("rule_id").count().where(F.col("count") > self.most_per_rule).select("rule_id", F.lit(True).alias("truncated"))
        R.first_of_each_rule(rows, self.most_per_rule).write.mode("overwrite").parquet(self._at(number, VALUES))

        shown, used = prior(PREVIEW), 0
        if shown is not None:
            used = shown.agg(F.coalesce(F.sum(F.length("after") + 1), F.lit(0))).first()[0]
        left = max(0, self.preview_chars - used)
        lines = R.preview(kept, self.column, self.order, left).select(F.struct(F.lit(number).cast("long").alias("batch"), F.struct(*self.order).alias("ord")).alias("first"), "before", "after", "changed")
        (lines if shown is None else shown.unionByName(lines)).write.mode("overwrite").parquet(self._at(number, PREVIEW))

        totals = kept.agg(F.count("*").alias("n")).select(F.lit("").alias("rule_id"), "n", F.lit(False).alias("truncated"))
        counts = counts.join(full, "rule_id", "full_outer").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("truncated", F.lit(False)).alias("truncated")).unionByName(totals)
        if (told := prior(COUNTS)) is not None:
            counts = counts.unionByName(told)
        counts.groupBy("rule_id").agg(F.sum("n").alias("n"), F.max("truncated").alias("truncated")).coalesce(1).write.mode("overwrite").parquet(self._at(number, COUNTS))
        self._forget(spark, before)

    def _at(self, number: int, what: str) -> str:
        return f"{self.folder}/batch-{number}/{what}"

    def _forget(self, spark: SparkSession, before: int | None) -> None:
        """Snapshots older than the one that the last batch started from are not asked for again."""
        for n in self._batches(spark):
            if before is not None and n < before:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{n}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def replacements(self, spark: SparkSession) -> DataFrame:
        """Kept values as a table: rule_id, original, replacement, n, contexts, first, last batch."""
        return self._read(spark, self._batches(spark)[0], VALUES).select("rule_id", "original", "shown.*", "n", "first", "last")

    def snapshot(self, spark: SparkSession, with_values: bool = True) -> dict:
        """The report as of the last whole batch, as Sanitizer.report() gives it; values are left out where only counts are wanted."""
        numbers = self._batches(spark)
        if not numbers:
            return {"counts": {}, "total_matches": 0, "line_count": 0, "replacements": [], "replacements_truncated": False, "preview": []}
        told = {r.rule_id: r for r in self._read(spark, numbers[0], COUNTS).collect()}
        lines = told.pop("").n
        shown = [{"before": r.before, "after": r.after, "changed": r.changed} for r in self._read(spark, numbers[0], PREVIEW).orderBy("first").collect()]
        return {
            "counts": {rule: r.n for rule, r in told.items() if r.n}, "total_matches": sum(r.n for r in told.values()), "line_count": lines,
            "replacements": [r.asDict() for r in self.replacements(spark).orderBy("first").collect()] if with_values else [],
            "replacements_truncated": with_values and any(r.truncated for r in told.values()), "preview": shown,
        }
