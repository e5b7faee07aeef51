"""Shared folder, files and small expressions for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and all runs on one machine (a
    local master, as in tests) a temporary folder of this process takes its place.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="webloom-")
        base = f"file://{_own_folder}"
    return f"{base.rstrip('/')}/webloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of a folder that tasks write files to: file://, hdfs://, s3:// and so on."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of these that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the running sum of each of sums, in an order without ties, its own row's included.

    Rows are dealt by ranges, summed in each, and the sums of earlier ranges (one row a range) are added.
    """
    part, *names = unused(df, "range", *sums)
    dealt = df.select("*", *[c.alias(n) for n, c in zip(names, sums.values(), strict=True)]).repartitionByRange(*order)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(part).agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(part).alias("at"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{k}") for k, n in enumerate(names)])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.select(*df.columns, part, *[F.sum(n).over(within).alias(f"within_{k}") for k, n in enumerate(names)])
    # a row a range: as many as there are shuffle partitions
    return rows.join(F.broadcast(totals), F.col(part) == F.col("at")).select(*df.columns, *[(F.col(f"within_{k}") + F.col(f"before_{k}")).alias(name) for k, name in enumerate(sums)])


def n_words(text: Column) -> Column:
    """Number of WORDs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
