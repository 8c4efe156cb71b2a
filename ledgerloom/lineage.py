"""Cutting lineage where a plan would work out the same rows many times over."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a kept table up to which Spark may broadcast it.
BROADCAST_ROWS = 100_000


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder that executors share (spark.checkpoint.dir) and read from there.

    Where that is unset, a folder is made on a local master alone, as in tests; on a cluster it would not be shared, so
    it is refused.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; see `written`."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt as `kept_by` keeps it: what is worked out by the key from here on needs no exchange, nor does keeping it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept_by(df: DataFrame, key: str = "case_id") -> DataFrame:
    """`df` written once as a Parquet table bucketed by `key` below the shared folder, and read from there.

    Joins, windows and aggregations by the key (alone or with other columns) between such tables need no exchange. A table of
    more than BROADCAST_ROWS rows is merged in joins: Spark knows the sizes of its files alone, and millions of rows in order
    of a key take few bytes there but hundreds of MB in a broadcast that the driver builds. For tables of a case's statements, months, positions and the like; rows of a ledger are aggregated by
    case before they move instead, so that a case with most of the rows stays spread out. The number of buckets is that of
    shuffle partitions, one file each.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"kept_{uuid.uuid4().hex}"
    seen = Observation(name)
    rows = df.observe(seen, F.count("*").alias("n")).repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/tables/{name}")
    rows.saveAsTable(name)
    kept = spark.table(name)
    return kept.hint("merge") if seen.get["n"] > BROADCAST_ROWS else kept
