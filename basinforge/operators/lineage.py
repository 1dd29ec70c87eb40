"""Cutting lineage in the shared checkpoint folder, and numbering rows without one task for a large group."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KEPT_AT = "_basinforge_table"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session on one machine that names none gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder.

    A table, unlike a checkpoint, takes along nothing of the plan that made it, which would grow from round to round of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__[_KEPT_AT] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``checkpointed`` has kept, once nothing reads it any more."""
    for df in tables:
        if path := df.__dict__.pop(_KEPT_AT, None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """A table of few bytes whose rows each become many or cost much, dealt by ``keys`` to as many tasks as a shuffle has, which its size would not ask for.

    With ``rows``, for a kept table, to more tasks if they would have more rows than that.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(usual if rows is None else max(usual, -(-df.count() // rows)), *keys)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a sort: a kept table's files, by whose size the planner chooses, are many times smaller than its rows on the driver."""
    return df.hint("merge")


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place from 0 in its group, in that order.

    Rows are dealt by range of group and order, so a large group spans partitions; each counts its
    own rows and takes one number for each group from the partitions before it.
    """
    keys = [f"__order{k}" for k in range(len(order))]
    dealt = checkpointed(df.withColumns(dict(zip(keys, order))).repartitionByRange(group, *keys).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    here = dealt.withColumn("__here", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*keys)))
    return here.join(before, [group, "__part"]).withColumn(name, F.col("__before") + F.col("__here") - 1).drop(*keys, "__part", "__here", "__before")


def with_previous(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its group, by distinct ``order``; null for a group's first.

    Rows are dealt by range of group and order; the last value of each range goes to the next one that has rows of the group.
    """
    dealt = checkpointed(df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    lasts = dealt.groupBy(group, "__part").agg(F.max_by(value, order).alias("__last"))
    carried = lasts.select(group, "__part", F.lag("__last").over(Window.partitionBy(group).orderBy("__part")).alias("__carried"))
    here = F.lag(value).over(Window.partitionBy(group, "__part").orderBy(order))
    first = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order)) == 1
    within = dealt.withColumn("__here", here).withColumn("__first", first)
    return within.join(carried, [group, "__part"]).withColumn(name, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__here"))).drop("__part", "__here", "__first", "__carried")
