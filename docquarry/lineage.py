"""Cutting lineage in loops, in a folder that every executor sees, and clearing up behind it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: No join becomes a broadcast for the size of its files or shuffles, which may be a small part of that of its rows.
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docquarry-checkpoints-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df as read back from the shared checkpoint folder; later plans start there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(*cuts: DataFrame) -> None:
    """Deletes the checkpoints of what cut() returned; nothing that is still to run may read them."""
    for df in cuts:
        place = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if place.isDefined():
            remove(df.sparkSession, place.get())


def stored(df: DataFrame) -> DataFrame:
    """df as read back from a table in the shared checkpoint folder; unlike those of cut(), its size estimates are those of
    the files, so that they don't multiply over the rounds of a loop."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    found = spark.read.schema(df.schema).parquet(place)
    found._place = place
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote; nothing that is still to run may read it."""
    for df in tables:
        remove(df.sparkSession, df._place)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings; those that were there come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidied(operator):
    """An operator of a DataFrame whose jobs leave no shuffle files behind."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        with settings(df.sparkSession, {CLEANUP: "true"}):
            return operator(df, *args, **kwargs)

    return run
