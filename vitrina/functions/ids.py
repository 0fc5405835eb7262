"""New surrogate ids: ``max(existing id) + rank by a unique key``.

A plain ``row_number().over(Window.orderBy(key))`` moves every row into one
task. Here the rows are range-partitioned by the key (Spark samples the
boundaries), sorted and numbered by their place inside each range partition
(one shuffle in all), and shifted by the row counts of the partitions before
them. The offsets table has one row per
partition, so broadcasting it is bounded by ``spark.sql.shuffle.partitions``.
The numbered rows are checkpointed to the shared checkpoint folder, so the
count pass and the join pass read identical data even if a task is re-run.

The result equals ``base + row_number() over (order by key)`` exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import ensure_checkpoint_dir


def dense_ids(df: DataFrame, order_cols: list[str], base: Column | int, id_col: str) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # partition number above 33 bits of the row's place in it
    numbered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn("_m", place)
    numbered = numbered.select(*df.columns, F.shiftright("_m", 33).cast("int").alias("_pid"),
                               (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_rn")).checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    out = numbered.join(F.broadcast(offsets), "_pid", "inner")  # <= n rows
    out = out.withColumn(id_col, (base_col + F.col("_off") + F.col("_rn")).cast("long"))
    return out.drop("_pid", "_rn", "_off")


def next_id_base(existing: DataFrame, id_col: str) -> Column:
    """Scalar subquery: current maximum id (0 if the table is empty)."""
    return existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
