"""Session helpers shared by every operator: reading tables and cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(package))
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage.

    The folder comes from `spark.checkpoint.dir`; only a local session without one gets a temporary folder, for on a
    cluster that would be another folder on every machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def first_by(df: DataFrame, keys: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per key: the earliest delivered. Repeated deliveries hold the same content, so no
    window is needed; the aggregation combines map-side. Each column is folded by itself, so that Spark reads and folds only the
    columns that are used later."""
    first = F.coalesce(F.col(order), F.lit("9999-12-31").cast("timestamp_ntz"))
    return df.groupBy(*keys).agg(*[F.min_by(F.col(f"`{c}`"), first).alias(c) for c in df.columns if c not in keys])
