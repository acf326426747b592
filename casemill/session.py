"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(master: str | None = None, app: str = "casemill", **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; a cluster's own settings win when no master is given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites of every column call cost more than the calls themselves in plans as wide as these.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder shared by the executors")
    path = tempfile.mkdtemp(prefix="casemill-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has whole texts handed to Python a thousand at a time unless the session says otherwise: at the usual ten thousand,
    a batch of long texts would fill the memory beside an executor's heap."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def ship_package(spark: SparkSession) -> None:
    """Give executors the package, once per application, so that its functions load there whatever their path is.

    A few hundred kB of source; Spark itself sends the archive to every executor, late ones included.
    """
    context = spark.sparkContext
    if getattr(context, "_casemill_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="casemill-"), "casemill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._casemill_shipped = True
