"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of
    our own stands in only where that is unset and Spark runs in this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="quernstone-")
        atexit.register(folder.cleanup)
        _LOCAL.append("file://" + folder.name)
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Work:
    """Tables of one run, written to the shared folder and read again. A lost executor
    costs only the tasks since the last table. What is left goes when the process ends, as
    results that are still to be read may need it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
        self._last: dict[str, str] = {}
        atexit.register(self._forget)

    def table(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        """Write df, read it again; an older table of that name is deleted after. With tidy,
        what was shuffled for it goes as soon as it is written, not when the driver happens
        to collect its garbage."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(TIDY, None)
        if tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            if tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.drop(name)
        self._last[name] = path
        return out

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read any more."""
        if name in self._last:
            _delete(self.spark, self._last.pop(name))

    def _forget(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session is over: the folder goes with it
            pass
