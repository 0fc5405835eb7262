"""Money columns: VAT, rates, price text, invoice numbers (O46-O52 helpers).

All arithmetic stays in DECIMAL so sums and roundings do not depend on the
order in which partitions are combined; values are cast to double only at
the edge (``to_money``). Rounding is HALF_UP (Spark's ``round`` on decimals).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(18,2)"
RATE = "decimal(12,4)"

# VAT used when none is configured, the local-currency rate used
# when neither the configuration nor the feed has one, shipping fee for
# home delivery, and the expense factor of the profit chart.
DEFAULT_VAT = 16
DEFAULT_RATE = 40
SHIPPING_FEE = "5.00"
EXPENSE_FACTOR = "0.4"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_money(x) -> Column:
    """Edge cast: decimal -> double (result columns only)."""
    return _c(x).cast("double")


def positive_or_null(x) -> Column:
    """``x`` if it is > 0, else NULL (Python truthiness on a rate / VAT)."""
    x = _c(x)
    return F.when(x > 0, x)


def vat_rate(configured) -> Column:
    """The configured VAT if > 0, else the default 16."""
    return F.coalesce(positive_or_null(configured), F.lit(DEFAULT_VAT).cast("decimal(5,2)"))


def vat_amount(subtotal, rate) -> Column:
    """O50 (tax part): round(subtotal * rate / 100, 2) in decimal, HALF_UP."""
    return F.round(_c(subtotal).cast(DEC) * _c(rate).cast("decimal(5,2)") / F.lit(100), 2).cast(DEC)


def vat_breakdown(subtotal, rate) -> Column:
    """struct(subtotal, tax, total) with total = round(subtotal + tax, 2)."""
    sub = F.round(_c(subtotal).cast(DEC), 2).cast(DEC)
    tax = vat_amount(sub, rate)
    return F.struct(sub.alias("subtotal"), tax.alias("impuesto"),
                    F.round(sub + tax, 2).cast(DEC).alias("total"))


def clamp_at_zero(x) -> Column:
    """SQLite ``MAX(0, x)``: NULL stays NULL (Spark ``greatest`` would give 0)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0), x))


def _grouped(x: Column) -> Column:
    """Two-decimal text with ',' thousands separators ('1,234.50')."""
    return F.format_number(F.round(x.cast(DEC), 2), 2)


def format_price(usd, rate) -> Column:
    """O51: '$1,234.50 / 45.180,00 Bs'; NULL price reads as 0."""
    u = F.coalesce(_c(usd).cast(DEC), F.lit(0).cast(DEC))
    bs = F.round(u * _c(rate).cast(RATE), 2).cast(DEC)
    return F.concat(F.lit("$"), _grouped(u), F.lit(" / "),
                    F.translate(_grouped(bs), ",.", ".,"), F.lit(" Bs"))


def format_admin_price(usd, rate) -> Column:
    """Admin-panel layout: 'Bs 600.00 (15.00$)'."""
    u = F.coalesce(_c(usd).cast(DEC), F.lit(0).cast(DEC))
    bs = F.round(u * _c(rate).cast(RATE), 2).cast(DEC)
    return F.concat(F.lit("Bs "), bs.cast("string"), F.lit(" ("), u.cast("string"), F.lit("$)"))


def invoice_number(id_col) -> Column:
    """O52: 'INV-001'; ids beyond three digits keep every digit (not lpad)."""
    return F.format_string("INV-%03d", _c(id_col).cast("long"))


def price_from_text(text) -> Column:
    """Price text such as '$1,234.00 / 45.180,00 Bs' -> decimal 1234.00 (NULL if none)."""
    num = F.regexp_extract(_c(text), r"\$?([0-9,]+\.?[0-9]*)", 1)
    return F.regexp_replace(num, ",", "").try_cast(DEC)
