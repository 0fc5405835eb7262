"""Properties from the test strategy: VAT total = subtotal + tax (O50);
clamped stock is never negative and never rises (O60)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.functions import money
from vitrina.operators.changes import _clamped_deduction

cents = st.integers(min_value=0, max_value=10**11).map(lambda c: Decimal(c) / 100)
rates = st.integers(min_value=0, max_value=2500).map(lambda r: Decimal(r) / 100)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(cents, rates), min_size=1, max_size=200))
def test_vat_total_is_subtotal_plus_tax(spark, rows):
    df = spark.createDataFrame(rows, "s decimal(18,2), r decimal(5,2)")
    out = df.select("s", "r", money.vat_breakdown("s", "r").alias("v")).collect()
    for row in out:
        tax = (row.s * row.r / 100).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert row.v.impuesto == tax
        assert row.v.total == row.v.subtotal + row.v.impuesto


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 50)), min_size=1, max_size=60),
       st.lists(st.tuples(st.integers(1, 30), st.one_of(st.none(), st.integers(0, 100))), min_size=1, max_size=30,
                unique_by=lambda t: t[0]))
def test_clamped_stock(spark, lines, stock):
    inv = spark.createDataFrame(stock, "id_producto long, stock_actual int")
    ln = spark.createDataFrame(lines, "id_producto long, cantidad int")
    for r in _clamped_deduction(inv, ln).collect():
        if r.stock_antes is None:
            assert r.stock_despues is None
        else:
            assert 0 <= r.stock_despues <= r.stock_antes
            assert r.stock_despues == max(0, r.stock_antes - r.descontado)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 60), max_size=400), st.one_of(st.none(), st.integers(0, 300)))
def test_guard_scan_equals_line_by_line(qty, stock):
    import numpy as np
    from vitrina.streaming.ledger import guard_scan
    want, left = [], stock
    for q in qty:
        if left is None:
            want.append(True)
        elif left >= q:
            left -= q
            want.append(True)
        else:
            want.append(False)
    ok, rest = guard_scan(np.array(qty, dtype=np.int64), stock)
    assert list(ok) == want and rest == left
