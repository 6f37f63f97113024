"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers find this package wherever the program was started.

    Local masters, whose workers see this disk, get its folder; on a cluster the package is sent along once per application.
    """
    context = spark.sparkContext
    if context.master.startswith("local"):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(ROOT) not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    elif context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="spark-")
        with zipfile.ZipFile(f"{folder}/gleanery.zip", "w") as archive:
            for file in sorted([*ROOT.glob("gleanery/**/*.py"), *ROOT.glob("*.py")]):
                archive.write(file, file.relative_to(ROOT))
        context.addPyFile(f"{folder}/gleanery.zip")
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Where the cluster names none, a local master gets a temporary folder; anything else is refused, since executors
    would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as a table and read again: lineage is cut and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of a table's files that one task of a costly query takes: of tables of whole texts, and of tables of short rows.
TEXT_PIECE, ROW_PIECE = 4_000_000, 1_000_000


def spread(df: DataFrame, key: str, piece: int = TEXT_PIECE) -> DataFrame:
    """Distribute a costly input that arrives in fewer pieces than half of those it should have.

    A file is split by its size and the cores, however much work its rows cause.  Here a table has as many pieces as cores, and more
    as it grows, so the longest task and what its Python worker holds stay as they are.
    """
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // piece))
    return df.repartition(wanted, key) if plan.toRdd().getNumPartitions() * 2 <= wanted else df
