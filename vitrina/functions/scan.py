"""Ordered work per key that does not put a hot key into one task.

Rows are range-partitioned by (key, order) with Spark's sampled boundaries, so a
partition holds a stretch of the order and a key of any size, also one whose
rows share a day, is spread over as many partitions as its rows fill. Each
boundary splits at most one key: what has to be carried from one partition to
the next is one value per partition, a table of at most as many rows as there
are partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import ensure_checkpoint_dir


def ordered_parts(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_part``, the number of its range partition by (key, order);
    every partition is sorted. The rows are checkpointed to the shared folder:
    all passes over them see the same partitions, also after a lost executor."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = list(dict.fromkeys([*key, *order]))
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return placed.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)


def running_sum(df: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``key`` up to and
    including this row, in ``order``. NULL values add nothing; NULL keys are one
    key. Rows that agree in the whole order share nothing but their places."""
    d = ordered_parts(df, key, order)
    totals = d.groupBy(*key, "_part").agg(F.sum(value).alias("_pt"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition at most
    carried = totals.select(*[F.col(c).alias("_o_" + c) for c in [*key, "_part"]], F.sum("_pt").over(before).alias("_off"))
    carried = carried.where("_off is not null")  # the keys split by a boundary: at most one row a partition
    inside = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [d[c].eqNullSafe(carried["_o_" + c]) for c in [*key, "_part"]]
    j = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(carried), same, "left")
    return j.withColumn(out, F.coalesce("_off", F.lit(0)) + F.col("_in")).select(*df.columns, out)
