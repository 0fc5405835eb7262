"""Line deduplication over levelled sorted runs of line hashes (DataFrame only).

The index is a set of runs. A run is a bucketed, sorted table of
(h1, h2, first_id): the 128-bit hash of a line key and the smallest document id
that holds it. Documents arrive in batches of ascending id. A batch reduces its
lines to one row per key, sorted and bucketed like the runs, so that the merge
anti-join with every run needs no shuffle; the keys no run knows become a run of
level 0. When a level has ``fanout`` runs they are merged into one run of the
next level. Only hashes are shuffled for this, never text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm.shared import NULL_ID, id_or_last, scratch_path, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_KEY_CHARS = 10
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


class LineRuns:
    """The levelled index. ``levels[i]`` lists the run tables of level i."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.count = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _sorted(self, rows: DataFrame) -> str:
        """Write rows as one bucketed and sorted table; its name."""
        self.count += 1
        name = f"{self.name}_{self.count}"
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        return name

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, id) whose ids follow all earlier batches.

        Returns (h1, h2, keeper) of the batch's keys that occur in at least two
        documents so far; their lines go in every document after ``keeper``.
        """
        keys = self.spark.table(self._sorted(lines.groupBy(*KEY).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))))
        new, known = keys, []
        for run in self.runs():
            known.append(keys.select(*KEY).join(run, KEY).select(*KEY, F.col("first_id").alias("keeper")))
            new = new.join(run.select(*KEY), KEY, "left_anti")
        fresh = self._sorted(new)
        repeated = self.spark.table(fresh).where("last_id > first_id").select(*KEY, F.col("first_id").alias("keeper"))
        for part in known:
            repeated = repeated.union(part)
        repeated = written(repeated, "repeated")
        self._push(0, fresh)
        return repeated

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for t in self.levels[level]:
                part = self.spark.table(t)
                merged = part if merged is None else merged.union(part)
            self.levels[level] = []
            self._push(level + 1, self._sorted(merged))

    def forget(self) -> None:
        """Take the run tables out of the session catalogue."""
        for i in range(1, self.count + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """Drop lines whose key an earlier document holds.

    Returns the rows of ``docs`` as struct ``row`` with ``n_lines``,
    ``n_dropped`` (long) and ``kept_text``. Keys of fewer than 10 code points
    are never dropped. NULL or empty text is one empty line. Rows that repeat an
    id count as one document and keep each other's lines. Rows without id count
    as one document after all others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.struct("*").alias("row"), id_or_last(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # quantiles are doubles: 2^63 - 1, a missing id, comes back as 2^63
    cuts = sorted({min(int(x), NULL_ID) for x in docs.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)})
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("id") > F.lit(c)).cast("int")
    lines = (docs.select("id", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
             .select("id", "th", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= MIN_KEY_CHARS)
             .select("id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), batch.alias("batch")))
    lines = written(lines, "lines", ("batch",))
    index = LineRuns(spark)
    repeated = None
    for b in range(len(cuts) + 1):
        part = index.ingest(lines.where(F.col("batch") == b).select(*KEY, "id"))
        repeated = part if repeated is None else repeated.union(part)
    index.forget()
    drops = (lines.join(repeated.distinct(), KEY).where("id > keeper")
             .groupBy("id", "th").agg(F.collect_set("pos").alias("drop")))
    parts = F.split("t", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drop"), lambda i: F.get(parts, i))
    return (docs.withColumn("th", F.xxhash64("t")).join(drops, ["id", "th"], "left")
            .select("row", F.size(parts).cast("long").alias("n_lines"),
                    F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
                    F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept_text")))
