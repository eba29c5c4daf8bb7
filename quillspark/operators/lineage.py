"""Tables that outlive their plan, and numbering of rows over a whole table."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: str | Column, within: str | None = None) -> DataFrame:
    """``df`` with a column that counts its rows from 1 in an order, as one sort over all tasks.

    Rows are dealt to tasks by ranges of the order and kept there by a checkpoint; each
    task counts its own, and the counts of the tasks before it (a row a task) are added.
    ``within`` counts from 1 for each value of a column, nulls together, that leads the
    order; only values that go on from task to task need counts, one at each border.
    """
    task, own, ahead = (f"{name}__{c}" for c in ("task", "own", "ahead"))
    by = [task] if within is None else [task, within]
    rows = cut(df.repartitionByRange(*([] if within is None else [within]), *order).withColumn(task, F.spark_partition_id()))
    before = Window.partitionBy(*by[1:]).orderBy(task)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(own)).select(*by, F.coalesce(F.sum(own).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    counts = counts.where(F.col(ahead) > 0).select(F.col(task).alias(f"{task}_"), *(F.col(c).alias(f"{name}__within") for c in by[1:]), ahead)
    same = F.col(task) == F.col(f"{task}_")
    same = same if within is None else same & F.col(within).eqNullSafe(F.col(f"{name}__within"))
    counted = rows.withColumn(own, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).join(F.broadcast(counts), same, "left")
    return counted.withColumn(name, F.coalesce(ahead, F.lit(0)) + F.col(own)).select(*(F.col(f"`{c}`") for c in df.columns if c != name), name)
