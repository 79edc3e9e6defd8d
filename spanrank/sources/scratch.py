"""Tables written once where several branches of a plan read them: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for this application's scratch tables.

    It lies below ``spark.checkpoint.dir``, as the cluster names it.  Where that
    is unset a temporary folder does on a local master, as in tests; any other
    master has executors that can't see such a folder, so that is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
            context.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/scratch-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Numbered tables below one folder of the scratch root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete saved tables that no later plan reads."""
        for t in tables:
            if getattr(t, "_scratch_path", None):
                delete_path(self.spark, t._scratch_path)


def saved(df: DataFrame) -> DataFrame:
    """df from a table of its own on shared storage; it goes with the application."""
    return Scratch(df.sparkSession, "table").save(df)
