"""Small helpers the corpus operators share: table paths, shared scratch tables
and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.session import ensure_checkpoint_dir

#: Stands for a NULL id inside the operators: such rows come after all others.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``, which the driver
    and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` to a new scratch table and read it back. The lineage ends
    there, so a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_or_last(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (u, v; long) with the smallest node of its
    component: rows (node, label), the smallest node itself included.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, until the edges are stars; every round is written to the shared
    folder. A hub's rows are combined before the shuffle, and its join is one
    that adaptive execution can split.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while True:
        parents = e.select(F.col("v").alias("u")).distinct()
        total, sources = e.agg(F.count("*"), F.count_distinct("u")).first()
        if total == sources and e.join(parents, "u", "left_semi").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "cc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
