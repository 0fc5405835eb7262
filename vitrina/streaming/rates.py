"""As-of join of invoices with the exchange rate valid at their date.

Facts and rates form one ordered stream per day. Inside a day the last rate is
carried forward by a window; a fact before the day's first rate takes the last
rate of an earlier day, found over one row per calendar day. A day's facts are
spread over ``SALTS`` groups, each with a copy of the day's rates, so a day that
holds a third of all facts is not one task. Work is linear in facts and rates,
however often rates arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.money import DEC, to_money

SALTS = 16


def asof_rate(facts: DataFrame, rates: DataFrame, ts: str = "fecha") -> DataFrame:
    """Left as-of join: each fact row gets the latest rate whose date <= ``ts``
    (of rates with one date the largest); NULL before the first rate or without
    a date. Rates marked inactive (``activa`` 0) and without a date are skipped."""
    if "activa" in rates.columns:
        rates = rates.filter(F.col("activa") == 1)
    rates = rates.filter(F.col("fecha").isNotNull()).select(
        F.to_date("fecha").alias("_day"), F.col("fecha").alias("_ts"), F.col("tasa").alias("_rate"))
    rows = facts.select(F.to_date(ts).alias("_day"), F.col(ts).alias("_ts"),
                        F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int").alias("_salt"),
                        F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_row"))
    spread = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_kind", F.lit(0))
    both = rows.unionByName(spread, allowMissingColumns=True)
    inside = Window.partitionBy("_day", "_salt").orderBy("_ts", "_kind", "_rate")
    both = both.withColumn("_near", F.last("_rate", ignorenulls=True).over(inside)).filter(F.col("_kind") == 1)
    # one row per calendar day from here on
    last = rates.groupBy("_day").agg(F.max(F.struct("_ts", "_rate")).alias("l")).select("_day", F.col("l._rate").alias("_last"))
    days = last.unionByName(rows.select("_day").distinct(), allowMissingColumns=True).groupBy("_day").agg(F.max("_last").alias("_last"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    return both.join(days, "_day", "left").select("_row.*", F.coalesce("_near", "_carried").alias("tasa"))


def invoice_local_total(ctx) -> DataFrame:
    """Invoice total (subtotal + VAT) in local currency at the active rate
    valid on the invoice date; NULL before the first rate."""
    inv = ctx["facturas"].join(ctx["ventas"].select("id_venta", "fecha"), "id_venta", "inner")
    inv = inv.select("id_venta", "fecha", (F.col("subtotal") + F.col("impuesto")).cast(DEC).alias("_usd"))
    j = asof_rate(inv, ctx["tasas_cambio"], "fecha")
    return j.select("id_venta", "fecha", to_money("_usd").alias("total_usd"),
                    F.col("tasa").cast("double").alias("tasa"),
                    to_money(F.round(F.col("_usd") * F.col("tasa"), 2)).alias("total_bs"))
