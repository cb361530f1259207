"""Helpers of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_folder(spark: SparkSession) -> str:
    """The folder for written tables of this application: below spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a temporary folder on one machine, and an error on a cluster, whose machines don't share one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = os.path.join(tempfile.gettempdir(), "seqloom")
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in table_folder(), its lineage cut."""
    path = f"{table_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Deletes this application's written tables; no DataFrame that reads one may be used after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, order: str, value: Column, name: str, *, parts: int = 64) -> DataFrame:
    """`df` with `name`: the sum of `value` over all rows before this one by `order`, a numeric column without ties.

    Two levels: rows fall into ranges of `order`, summed each; a window runs inside a range only.
    """
    from pyspark.sql import Window

    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = df.withColumns({"__part": part, "__value": value})
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    earlier = sums.alias("a").join(sums.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.__sum"), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum("__value").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(F.broadcast(earlier), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__value", "__own", "__before")


def row_numbers(df: DataFrame, order: list[str], size: Column | None = None, *, parts: int | None = None) -> DataFrame:
    """`df`, whose rows differ in `order`, with before: how many rows (or how much of `size`) come before it.

    Rows are sorted into ranges and written, with their numbers inside the range; sums of a size run in a window inside one range. The
    ranges' offsets come from a table of one row for each.
    """
    from pyspark.sql import Window

    value = F.lit(1) if size is None else size
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    if size is None:
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = written(ranged.sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__inside": inside}))
        sums = rows.groupBy("__part").agg(F.count("*").alias("__sum"))
        return _from_offsets(rows, sums)
    rows = written(ranged.withColumns({"__part": F.spark_partition_id(), "__value": value.cast("long")}))
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _from_offsets(rows.withColumn("__inside", inside).drop("__value"), sums)


def _from_offsets(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """`rows` with before: __inside and the sums of all parts before theirs."""
    from pyspark.sql import Window

    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    return rows.join(F.broadcast(offsets), "__part").withColumn("before", F.col("__offset") + F.col("__inside")).drop("__part", "__inside", "__offset")
