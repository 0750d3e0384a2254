"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from functools import cache, wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folder of the run under way, see ``own_tables``.
_run_folder: ContextVar[str | None] = ContextVar("skyweft_run_folder", default=None)


def build_session(app_name: str = "skyweft", master: str | None = None, **conf: object) -> SparkSession:
    """Session with the adaptive settings the plans count on.

    Shuffle partitions are left to the cluster's own setting unless given:
    adaptive execution coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Arrays per grid cell stay in the hash aggregate instead of turning to sorting after 128 cells.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{name: str(value) for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@cache
def _own_folder(purpose: str) -> tempfile.TemporaryDirectory:
    """Temporary folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix=f"skyweft-{purpose}-", ignore_cleanup_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a temporary folder, which
    goes when its process ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(_own_folder("tables").name)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Later stages neither repeat the work nor depend on any executor, read only
    the columns they need, and know the real size of the table.
    """
    spark = df.sparkSession
    path = f"{_run_folder.get() or shared_folder(spark)}/skyweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_tables(run: Callable) -> Callable:
    """Decorator for a complete run, whose first argument is the session and whose results are written or collected.

    Its intermediate tables lie in a folder of their own, which is removed when the run ends.
    """

    @wraps(run)
    def tidy(spark: SparkSession, *args, **kwargs):
        folder = f"{shared_folder(spark)}/skyweft-run-{uuid.uuid4().hex}"
        outer = _run_folder.set(folder)
        try:
            return run(spark, *args, **kwargs)
        finally:
            _run_folder.reset(outer)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return tidy


def ship_code(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run and whatever their working folder is."""
    context = spark.sparkContext
    name = f"skyweft-{context.applicationId}.zip"
    if any(os.path.basename(path) == name for path in context.listFiles):
        return
    package = Path(__file__).resolve().parent
    archive = Path(_own_folder("code").name) / name
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
