"""Orders over all rows, by ranges: no task holds them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own_folder: str | None = None


def scratch(spark: SparkSession) -> str:
    """A path of its own below spark.checkpoint.dir; where that is unset and all runs on one machine, in a folder of this process."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="webloom-")
        base = f"file://{_own_folder}"
    return f"{base.rstrip('/')}/webloom/step-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir (see scratch()), so that its plan is cut and lost executors cost retries only.

    A table, unlike DataFrame.checkpoint(), computes df once and keeps no constraints of its plan, which in a loop grow beyond
    what a planner can handle.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by merging, never by broadcast: it can have as many rows as the level or the frontier.

    A few columns of a wide, well compressed table are estimated at a fraction of their size; a broadcast planned by that is kept
    when the rows turn out to be millions, as merging would take more shuffles, and they all go through the driver.
    """
    return df.hint("merge")


def running_count(df: DataFrame, flag: Column, *order: str) -> DataFrame:
    """df with running: rows up to and with this one, in an order without ties, whose flag holds.

    Rows are dealt by ranges of the order as it is distributed and counted there; a row a range says how many come before it.
    """
    dealt = checkpointed(df.withColumn("__flag", flag.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum("__flag").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.sum("__flag").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # a row a range, of which there are as many as shuffle partitions
    counted = dealt.withColumn("__own", own).join(F.broadcast(offset), F.col("__part") == F.col("__at"))
    return counted.withColumn("running", F.coalesce("__own", F.lit(0)) + F.col("__before")).drop("__part", "__own", "__before", "__flag", "__at")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column that numbers its rows from 0, in an order without ties."""
    return running_count(df, F.lit(True), *order).withColumn(name, F.col("running") - 1).drop("running")
