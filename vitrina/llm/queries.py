"""The thirteen operators as registered queries with production parameters, over
whole tables, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import (bpe_index, class_lm, decontam, hilbert_ann, line_dedup, main_text, near_dup, packing, periodic_runs, pii,
                         substring_dedup, token_align, toxicity)
from vitrina.llm.shared import id_or_last, table

THRESHOLD = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "coverage", "n_windows", "n_slots", "n_changed").distinct()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["s"], s["e"])), ",")

    def of_kind(spans, kind):  # a lambda of two parameters would get the span's place as the second
        return F.filter(spans, lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(of_kind(base, k)).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(pii.BASE)]
    return rows.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return rows.select("row.doc_id", (~toxicity.training_row("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text.main_text(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "start", "length", "n_chunks", "first_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.near_dup_classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "n_links", "class_size")


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def with_periodic_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the crc32 of the id fixes the rows whose words
    repeat: each word i >= a becomes original word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h / 10).cast("long").alias("g"), (h % 10 == 0).alias("planted"))
    words = F.when(F.col("planted"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.coalesce(F.when(F.col("planted"), F.size("w")), F.lit(0)).cast("long"))
    a = F.try_mod(F.col("g"), F.col("n"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    picked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))


def sha256(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.find_periodic_runs(with_periodic_texts(table(spark, sf_dir, "documents")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return (rows.withColumn("m", best)
            .select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("m.start").alias("start"), (-F.col("m.neg")).alias("length"),
                    F.col("m.period").alias("period"), F.expr("-1000 * m.neg div m.period").alias("exponent_milli"),
                    sha256(listed).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256")))


def op12_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    rows = bpe_index.bpe_encode(table(spark, sf_dir, "documents"), path)
    return rows.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       sha256(bpe_index.bpe_decode(F.col("ids"), path)).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = token_align.align_tokens(table(spark, sf_dir, "documents"), path_a, path_b)
    rows = token_align.link_scores(aligned, len(bpe_index.token_bytes(path_a)), token_align.pieces_at(path_b).size)
    return rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.when(F.col("groups") == "", "").otherwise(sha256(F.col("groups"))).alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_benchmark_decontamination, op2_line_dedup, op3_pii, op4_class_lm, op5_toxicity, op6_packing, op7_main_text,
        op8_substring_dedup, op9_ngram_jaccard_join, op10_hilbert_neighbours, op11_periodic_runs, op12_pair_index_bpe,
        op13_token_alignment, pipeline)}


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
keeper AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN keeper USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL}
