"""Training-data pipeline over ``documents``: five stages, each of which works
on everything its predecessor kept.

toxicity (rejected documents go), line dedup (repeated lines go, and documents
that it leaves blank), n-gram Jaccard join (one document of each near-duplicate
class stays), benchmark
decontamination (documents that hold a benchmark item go), packing (token pieces
and their places in sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import decontam, line_dedup, near_dup, packing, toxicity
from vitrina.llm.queries import THRESHOLD, tokenizer_path
from vitrina.llm.shared import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, unchanged. NULL and empty texts
    have the score of a text without terms; rows are judged one by one."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).where(F.col("score") < THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the text changes, and ``n_chars`` with it, where lines are dropped. A
    document that loses lines and keeps nothing but white space holds nothing of
    its own and goes; one that was blank before stays. Rows without id are one
    document."""
    rows = line_dedup.line_dedup(docs)
    changed = F.col("n_dropped") > 0
    rows = rows.where(~changed | F.col("kept_text").rlike(r"\S"))
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.char_length("kept_text")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row")[f.name].alias(f.name) for f in docs.schema])


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near copies; texts without words stay."""
    return near_dup.keep_one_of_each(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark keeps all."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places; an empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_near_duplicate),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The learned stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written before the next reads it.
    Empty tables, repeated rows and extra columns pass through as each stage states."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
