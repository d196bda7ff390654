"""The folder that the driver and all executors share, and what is cut off there."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..errors import INVALID_OPTION, SanitizerError


#: Spark's setting by which the shuffle files of an execution go as it ends (4.1; earlier ones keep them until the driver collects its garbage).
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only where the master is local, as in tests."""
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (kept.get() if kept.isDefined() else None)
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise SanitizerError(INVALID_OPTION, "set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    if not kept.isDefined():
        context.setCheckpointDir(at)
    return at


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """For executions that write their whole result: what they have shuffled is not read again, and need not wait for the driver's garbage collection.

    The setting is the session's; an execution of another thread that ends within makes its
    shuffles again if it is asked twice. Who finds it on leaves it on.
    """
    if spark.conf.get(_FREED, "false") == "true":
        yield
        return
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, "false")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark's cleaner removes it when nothing refers to it."""
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting as it is made
