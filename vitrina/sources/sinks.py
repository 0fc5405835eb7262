"""Sinks: report CSV, top-products sheet, order JSON documents, snapshots
(O07, O08, O09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.money import invoice_number

# CSV header and texts of the report and the sheet.
REPORT_HEADER = ["N° Factura", "Cliente", "Fecha", "Items", "Total"]
UNKNOWN = "Desconocido"
GRAND_TOTAL = "Total General"
SHEET_TOTAL = "Ganancias Totales"


def sales_report_rows(report: DataFrame) -> DataFrame:
    """O07 rows: one line per invoice of a report (O34) plus the grand total,
    as text columns in file order (``orden`` 0 = detail, 1 = total).

    The total row of the reference has a sixth field under a five-column
    header; here it uses the five columns (total text in 'Items')."""
    detail = report.select(
        F.lit(0).alias("orden"), F.col("id").alias("id"),
        invoice_number("id").alias("factura"),
        F.coalesce(F.nullif(F.col("cliente"), F.lit("")), F.lit(UNKNOWN)).alias("cliente"),
        F.date_format("fecha", "d/M/yyyy").alias("fecha_txt"), F.col("fecha").alias("fecha_orden"),
        F.concat(F.col("items").cast("string"), F.lit(" producto(s)")).alias("items_txt"),
        F.format_number(F.coalesce(F.col("total"), F.lit(0.0)).cast("decimal(18,2)"), 2).alias("total_txt"))
    total = report.agg(F.sum(F.col("total").cast("decimal(18,2)")).alias("t")).select(
        F.lit(1).alias("orden"), F.lit(None).cast("long").alias("id"), F.lit("").alias("factura"),
        F.lit("").alias("cliente"), F.lit("").alias("fecha_txt"),
        F.lit(None).cast("timestamp_ntz").alias("fecha_orden"), F.lit(GRAND_TOTAL).alias("items_txt"),
        F.format_number(F.coalesce("t", F.lit(0).cast("decimal(18,2)")), 2).alias("total_txt"))
    return detail.unionByName(total)


def write_sales_report_csv(report: DataFrame, path: str) -> None:
    """Write the report as CSV with a header (standard quoting); no
    thousands separator in the total column.

    The rows are sorted globally (range partitioning), so the part files of
    the folder, read in name order, are the report in order, newest invoice
    first and the grand total last. Each part carries the header line; no
    single task writes the whole report."""
    rows = sales_report_rows(report).withColumn("total_txt", F.regexp_replace("total_txt", ",", ""))
    out = rows.orderBy("orden", F.desc_nulls_last("fecha_orden"), F.desc_nulls_last("id")).select(
        *[F.col(c).alias(h) for c, h in zip(["factura", "cliente", "fecha_txt", "items_txt", "total_txt"],
                                           REPORT_HEADER)])
    out.write.mode("overwrite").option("header", True).csv(path)


def top_products_sheet(top: DataFrame, income) -> DataFrame:
    """Product / Quantity / Total rows of the top products plus a
    'Ganancias Totales' row with the total income (a scalar column)."""
    rows = top.select(F.lit(0).alias("orden"), F.col("producto").alias("Producto"),
                      F.col("cantidad").cast("string").alias("Cantidad"), F.col("total").alias("Total"))
    total = top.sparkSession.range(1).select(F.lit(1).alias("orden"), F.lit(SHEET_TOTAL).alias("Producto"),
                                             F.lit("").alias("Cantidad"), income.cast("double").alias("Total"))
    return rows.unionByName(total)


def order_documents(items: DataFrame) -> DataFrame:
    """The items document of every order (the declared items column), as
    one JSON object per line with its position in the order, from 0. Nothing is
    gathered, so an order of any size has the same form; a reader sorts by
    ``posicion``."""
    from vitrina.functions.scan import running_sum
    cols = ["id", "product_id", "name", "quantity", "price", "total"]
    one = items.withColumn("_one", F.lit(1))
    numbered = running_sum(one, ["id_pedido"], cols, "_one", "_pos")
    return numbered.select("id_pedido", (F.col("_pos") - 1).cast("long").alias("posicion"),
                           F.to_json(F.struct(*cols)).alias("item_json"))


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a job's new snapshot to a new path (parquet has no MERGE)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
