"""Session defaults and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def session(app: str = "cairn", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster, submit with the cluster's own settings instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or the one set on the context.

    Where both are unset, a local session (tests) gets a temporary folder of its own; a cluster has no folder that
    all executors share, so that is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return context.getCheckpointDir()


@lru_cache(maxsize=None)
def _run_folder(root: str, application: str) -> str:
    """The folder of this application's tables below ``root``; removed when the process ends."""
    folder = f"{root.rstrip('/')}/cairn-{application}"
    atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the JVM may be gone already; what is left lies in the checkpoint folder
            return


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared checkpoint folder."""
    return _run_folder(checkpoint_dir(spark), spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and go on from its files.

    That survives the loss of executors, ends the lineage, and gives the planner the true size of what follows:
    unlike a checkpoint, whose size estimates multiply from join to join, it lets small sides be broadcast. Columns are
    numbered in the files, so names that clash or that a file format refuses don't matter; a column without a type is
    null again.
    """
    spark, names = df.sparkSession, df.columns
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    void = [f.name for f in plain.schema if isinstance(f.dataType, NullType)]
    stored = plain.withColumns({c: F.lit(None).cast("int") for c in void}) if void else plain
    stored.write.parquet(folder)
    back = spark.read.schema(stored.schema).parquet(folder)
    return (back.withColumns({c: F.lit(None) for c in void}) if void else back).toDF(*names)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def small_side(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is looked up; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, so working columns never clash with extra input columns."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}{n}"
    return name
