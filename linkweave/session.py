"""Session defaults used by the tests, the bench and stand-alone scripts.

A cluster brings its own session; nothing in the library depends on these
settings except the UTC session time zone.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "linkweave") -> SparkSession:
    """A local session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LINKWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs milliseconds per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written working tables.

    The cluster names it in ``spark.checkpoint.dir``, a folder that driver and executors
    share. Only a local master, as in tests, may leave that unset: it gets a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share"
        )
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark):
    """Queries run inside remove their shuffle files when they are done."""
    kept = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, kept)


def stored(df, before=None):
    """The rows written as a working table and read back.

    Cuts the lineage like ``cut_lineage``, in columns and compressed, and the shuffle files
    behind the rows go with the write. ``before``, an earlier such table that only this one
    was made from, is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    if before is not None:
        context = spark.sparkContext
        old = context._jvm.org.apache.hadoop.fs.Path(before._working_path)
        old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._working_path = path
    return out


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="linkweave-code-")
    package = os.path.dirname(os.path.abspath(__file__))
    base = shutil.make_archive(
        os.path.join(folder, "linkweave"), "zip", os.path.dirname(package), "linkweave"
    )
    context.addPyFile(base)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
