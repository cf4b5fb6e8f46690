"""Tables written to the cluster's shared folder, and bundles of tables kept on disk."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping
from importlib.metadata import version
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed where they run."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="themeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, width: int, limit: int = 16 << 20) -> DataFrame:
    """df, which is a settled table, with a broadcast hint if its counted rows of that width stay under limit bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * width <= limit else df


def save(path: str, spark: SparkSession, tables: Mapping[str, DataFrame], params: Mapping | None = None) -> None:
    """A model or topic data: a Parquet folder a table, and a manifest with parameters and versions."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    told = {"tables": sorted(tables), "params": dict(params or {}), "versions": {"pyspark": pyspark.__version__, "numpy": version("numpy")}}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(path: str, spark: SparkSession) -> tuple[dict[str, DataFrame], dict]:
    """What save() wrote; warns if it was written with another version of Spark."""
    told = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if told["versions"]["pyspark"] != pyspark.__version__:
        import warnings

        warnings.warn(f"written with pyspark {told['versions']['pyspark']}, read with {pyspark.__version__}", stacklevel=2)
    return {name: spark.read.parquet(f"{path}/{name}") for name in told["tables"]}, told["params"]
