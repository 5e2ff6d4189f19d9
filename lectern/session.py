"""Session settings shared by the command line, the bench and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lectern", master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for local use; on a cluster the submitted settings win."""
    b = SparkSession.builder.appName(app)
    if master or cpus:
        b = b.master(master or f"local[{cpus}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir.

    Only where that is unset (tests, a laptop) a folder of our own is made.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = os.environ.get("LECTERN_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="lectern-checkpoint-")
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """For maps that cost much per row: rows dealt out over the cores where the files make fewer tasks than there are cores.

    Large tables have more tasks than cores and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which on a cluster don't share our files."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._lectern_shipped = True
