"""Stage tables in the folder that driver and executors share.

A long chain of stages, each used several times by later ones, is planned anew for every use; a written table cuts
that, and a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset, in local runs."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="breakweave-stages-"))
    return _fallback[0]


class StageTables:
    """Tables of one run; those of an operator that needs them for itself go when the process ends."""

    def __init__(self, spark: SparkSession, temporary: bool = False):
        self.spark, self.at = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex[:12]}"
        if temporary:
            atexit.register(self.drop)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
