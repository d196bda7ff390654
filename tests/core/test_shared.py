import pytest

from veilspark.errors import SanitizerError
from veilspark.sources.shared import shared_dir


class Off:
    """A session on a cluster, with nothing set."""

    def __init__(self, at=None, master="spark://x:7077"):
        self.at, self.master, self.put = at, master, []

    conf = property(lambda self: type("Conf", (), {"get": lambda _, key, default=None: self.at})())
    sparkContext = property(lambda self: type("Context", (), {"master": self.master, "_jsc": self, "setCheckpointDir": lambda _, x: self.put.append(x)})())

    def sc(self):
        return type("Jsc", (), {"getCheckpointDir": lambda _: type("Option", (), {"isDefined": lambda _: False})()})()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(SanitizerError):
        shared_dir(Off())
    with pytest.raises(SanitizerError):
        shared_dir(Off(master="local-cluster[2,1,1024]"))
    at = Off("s3://bucket/x")
    assert shared_dir(at) == "s3://bucket/x" and at.put == ["s3://bucket/x"]
    assert shared_dir(Off(master="local[2]")).startswith("file://")


def test_shuffle_files_go_when_their_result_is_written(spark):
    """They do not wait for the driver's garbage collection, as on a table of many small steps they filled the disk."""
    import time

    from veilspark.llm._common import stored
    from veilspark.sources.shared import cut

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    kept = []
    for write in (cut, stored):
        df = spark.range(1000).groupBy("id").count().repartition(7)
        before = files()
        kept += [df, out := write(df)]  # so that nothing of it is garbage
        end = time.time() + 20
        while files() - before and time.time() < end:
            time.sleep(0.2)
        assert not files() - before
        assert out.count() == 1000 and df.count() == 1000  # asked again, it shuffles again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
