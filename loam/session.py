"""Spark session and the few helpers every operator shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "loam", **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the session's ``spark.checkpoint.dir``, which a cluster must share.

    Only where neither the setting nor a folder is given (a local session, as in tests) is a temporary one made.
    """
    context = spark.sparkContext
    if (now := context.getCheckpointDir()) is not None:
        return now
    given = context.getConf().get("spark.checkpoint.dir")
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="loam-checkpoint-")
    context.setCheckpointDir(given)
    return given


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a Python stage as many tasks as there are cores where the input has fewer splits than that.

    Inputs of many files are left as they are, so at scale this adds no shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
