"""A local session for tests, benches and small runs (on a cluster the caller brings its own), and tables between jobs."""

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session of one
    process (as in tests) takes a folder of its own; a cluster has no such folder, so there it is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        root = _local[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df, written once to the shared folder and read again: later plans start there and survive lost executors. by: columns
    that cut it into folders, of which a filter on them reads its own only."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
