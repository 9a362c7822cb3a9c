"""Tables of iterative operators, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, a local master gets a
    temporary one (tests); a cluster is refused, for executors do not see each other's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_written: dict[str, SparkSession] = {}


@atexit.register
def _tidy() -> None:
    """What results still read goes when the driver ends."""
    for home, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, home)


class Rounds:
    """Written tables of a loop or an operator.

    A table read back has its lineage cut and the size of its files as its estimated size.
    A checkpointed one keeps the estimate of the plan it came from: joined with itself
    round after round, that number doubles its digits until the planner drowns in them.
    It has no partitioning either: a join shuffles it by its own key, where AQE can split.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.home = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.n = 0
        self.live: list[tuple[str, DataFrame]] = []
        _written[self.home] = spark

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        self.n += 1
        path = f"{self.home}/{self.n}"
        df.write.parquet(path)
        self.live.append((path, self.spark.read.schema(df.schema).parquet(path)))
        return self.live[-1][1]

    def add(self, name: str, df: DataFrame) -> None:
        """Append ``df`` to the table of that name, which ``read`` gives."""
        path = f"{self.home}/{name}"
        df.write.mode("append").parquet(path)
        self.live = [x for x in self.live if x[0] != path] + [(path, self.spark.read.schema(df.schema).parquet(path))]

    def read(self, name: str) -> DataFrame:
        return next(t for path, t in self.live if path == f"{self.home}/{name}")

    def forget(self, keep: int) -> None:
        """Delete all tables but the last ``keep`` ones."""
        self.drop(*(t for _, t in self.live[: len(self.live) - keep]))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path, table in [x for x in self.live if any(x[1] is t for t in tables)]:
            self.live = [x for x in self.live if x[0] != path]
            _delete(self.spark, path)
