"""Ordered folds (O73, O76) against a sequential brute force; ledger
properties (O70)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrina.streaming import carts, ledger


def _guard_brute(lines: pd.DataFrame, stock: dict) -> dict:
    out = {}
    lines = lines.sort_values(["id_producto", "fecha", "id_venta", "id_detalle", "cantidad"], kind="stable")
    left = {}
    for r in lines.itertuples():
        s = left.get(r.id_producto, stock.get(r.id_producto))
        if s is None:
            ok = True
        else:
            ok = s >= r.cantidad
            if ok:
                s -= r.cantidad
        left[r.id_producto] = s
        key = (r.id_venta, r.id_detalle, r.id_producto, r.fecha, r.cantidad)
        out.setdefault(key, []).append(ok)
    return {k: sorted(v) for k, v in out.items()}


def test_oversell_guard_matches_sequential_fold(spark, ctx):
    res = ledger.oversell_guard(ctx["detalle_ventas"], ctx["inventario"]).toPandas()
    lines = ctx["detalle_ventas"].toPandas()
    stock = {r.id_producto: r.stock_actual for r in ctx["inventario"].toPandas().itertuples()}
    want = _guard_brute(lines, stock)
    got = {}
    for r in res.itertuples():
        got.setdefault((r.id_venta, r.id_detalle, r.id_producto, r.fecha, r.cantidad), []).append(bool(r.aceptada))
    got = {k: sorted(v) for k, v in got.items()}
    assert len(res) == len(lines)
    assert got == want
    assert (~res["aceptada"]).sum() > 0  # the fixture does exhaust stock


def test_oversell_guard_small_cases(spark):
    lines = spark.createDataFrame(
        [(1, 1, 7, dt.datetime(2024, 1, 1), 3), (1, 2, 7, dt.datetime(2024, 1, 2), 5),
         (2, 1, 7, dt.datetime(2024, 1, 3), 2), (3, 1, 7, dt.datetime(2024, 1, 4), 1),
         (4, 1, 8, dt.datetime(2024, 1, 1), 100)],
        "id_venta long, id_detalle int, id_producto long, fecha timestamp_ntz, cantidad int")
    inv = spark.createDataFrame([(7, 6)], "id_producto long, stock_actual int")
    got = {(r.id_venta, r.id_detalle): r.aceptada for r in ledger.oversell_guard(lines, inv).collect()}
    # stock 6: take 3 (left 3), reject 5, take 2 (left 1), take 1 (left 0); no stock row -> accept
    assert got == {(1, 1): True, (1, 2): False, (2, 1): True, (3, 1): True, (4, 1): True}


def _carts_brute(ev: pd.DataFrame) -> dict:
    out = {}
    life = dt.timedelta(hours=24)
    for client, g in ev.sort_values(["id_carrito", "fecha", "id_detalle"]).groupby("id_carrito"):
        start, n = None, 0
        for r in g.itertuples():
            if start is None or r.fecha > start + life:
                start, n = r.fecha, n + 1
            out[r.id_detalle] = (n, start)
    return out


def test_active_carts_matches_sequential_fold(spark, ctx):
    res = carts.active_carts(ctx["cart_events"]).toPandas()
    ev = ctx["cart_events"].toPandas()
    want = _carts_brute(ev)
    got = {r.id_detalle: (r.carrito_n, r.creacion_carrito) for r in res.itertuples()}
    assert len(res) == len(ev)
    assert got == want


def test_active_carts_boundary_is_inclusive(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    ev = spark.createDataFrame(
        [(1, 5, t0), (2, 5, t0 + dt.timedelta(hours=24)), (3, 5, t0 + dt.timedelta(hours=24, seconds=1)),
         (4, 5, t0 + dt.timedelta(hours=30))],
        "id_detalle long, id_carrito long, fecha timestamp_ntz")
    got = {r.id_detalle: r.carrito_n for r in carts.active_carts(ev).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_ledger_balance(spark, ctx):
    led = ledger.stock_ledger(ctx["detalle_ventas"], ctx["detalle_compras"], ctx["inventario"])
    last = led.groupBy("id_producto").agg(F.max_by("stock_despues", F.struct(*ledger.MOVE_ORDER)).alias("fin"))
    net = (ctx["detalle_compras"].select("id_producto", F.col("cantidad").alias("q"))
           .unionByName(ctx["detalle_ventas"].select("id_producto", (-F.col("cantidad")).alias("q")))
           .groupBy("id_producto").agg(F.sum("q").alias("net")))
    chk = last.join(net, "id_producto").join(ctx["inventario"], "id_producto")
    bad = chk.filter(F.col("fin") != F.col("stock_actual") + F.col("net")).count()
    assert chk.count() > 0 and bad == 0


def _as_decisions(rows: pd.DataFrame) -> dict:
    got = {}
    for r in rows.itertuples():
        got.setdefault((r.id_venta, r.id_detalle, r.id_producto, r.fecha, r.cantidad), []).append(bool(r.aceptada))
    return {k: sorted(v) for k, v in got.items()}


def _hot_lines(spark, n, days, quantity):
    return spark.range(n).select(
        F.col("id").alias("id_venta"), F.lit(1).alias("id_detalle"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 200 + 2).cast("long").alias("id_producto"),
        (F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz")
         + F.make_dt_interval(days=(F.col("id") % days).cast("int"))).alias("fecha"),
        quantity.cast("int").alias("cantidad"))


@pytest.mark.parametrize("stock, days", [(9000, 400), (1_000_000, 400), (200, 1), (0, 7), (-5, 7)])
def test_hot_product_with_returns_is_exact(spark, stock, days):
    """One product holds a third of all lines and fills whole partitions, with
    some negative quantities, much, little or no stock, and also on one day."""
    h = F.abs(F.xxhash64("id"))
    base = _hot_lines(spark, 9000, days, F.when(h % 13 == 0, -(h % 90)).when(h % 5 == 0, h % 1500).otherwise(h % 30 + 1))
    base = base.unionByName(spark.createDataFrame([(1, 9, 1, dt.datetime(2020, 1, 1), None), (2, 9, None, dt.datetime(2020, 1, 1), 3)], base.schema))
    inv = spark.createDataFrame([(1, stock)] + [(i, 40) for i in range(2, 150)], "id_producto long, stock_actual int")
    got = ledger.oversell_guard(base, inv)
    odd = got.filter("cantidad is null or id_producto is null").collect()
    assert len(odd) == 2 and all(r.aceptada for r in odd)
    lines = base.filter("cantidad is not null and id_producto is not null").toPandas()
    want = _guard_brute(lines, {r.id_producto: r.stock_actual for r in inv.collect()})
    assert _as_decisions(got.filter("cantidad is not null and id_producto is not null").toPandas()) == want


def test_hot_product_day_is_spread(spark):
    """A third of all rows are one product on one day: the running sum is exact
    and no partition holds more than a few times the median."""
    from vitrina.functions.scan import ordered_parts, running_sum
    base = _hot_lines(spark, 9000, 1, F.col("id") % 7 + 1).filter("id_producto = 1 or id_venta % 2 = 0")
    base = base.withColumn("cantidad", F.when(F.col("id_venta") % 11 != 0, F.col("cantidad")))
    sizes = [r["count"] for r in ordered_parts(base, ["id_producto"], ledger.GUARD_ORDER).groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    got = running_sum(base, ["id_producto"], ledger.GUARD_ORDER, "cantidad", "run")
    assert got.columns == [*base.columns, "run"]
    rows = base.toPandas().sort_values(["id_producto", "fecha", "id_venta"])
    want = dict(zip(rows["id_venta"], rows["cantidad"].fillna(0).groupby(rows["id_producto"]).cumsum()))
    assert {r.id_venta: r.run for r in got.collect()} == want


def test_asof_rate_edges(spark):
    from vitrina.streaming import rates
    t = dt.datetime
    r = spark.createDataFrame([(t(2024, 1, 10), 1.5), (t(2024, 3, 1), 2.0), (t(2024, 9, 1), 3.0)],
                              "fecha timestamp_ntz, tasa double")
    f = spark.createDataFrame([(1, t(2024, 1, 9)), (2, t(2024, 1, 10)), (3, t(2024, 2, 29, 23)), (4, t(2024, 5, 5))],
                              "k long, fecha timestamp_ntz")
    got = {x.k: x.tasa for x in rates.asof_rate(f, r).collect()}
    # before the first rate -> none; the last rate starts after the last fact
    assert got == {1: None, 2: 1.5, 3: 1.5, 4: 2.0}


@pytest.mark.parametrize("gap", [600, 3600 * 5, 3600 * 24])
def test_hot_client_fills_partitions(spark, gap):
    """One client holds most events, many of them at one time, over several
    partitions; events without time or client belong to no cart."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 5 if i % 4 else i % 7, t0 + dt.timedelta(seconds=(i * i) % 97 * 60 + i // 3 * gap)) for i in range(3000)]
    odd = [(9001, None, t0), (9002, 5, None), (9003, None, None)]
    ev = spark.createDataFrame(rows + odd, "id_detalle long, id_carrito long, fecha timestamp_ntz").repartition(5)
    res = carts.active_carts(ev).toPandas()
    assert len(res) == 3003
    none = res[res["id_detalle"] > 9000]
    assert none["carrito_n"].isna().all() and none["creacion_carrito"].isna().all()
    got = {r.id_detalle: (r.carrito_n, r.creacion_carrito) for r in res[res["id_detalle"] < 9000].itertuples()}
    assert got == _carts_brute(pd.DataFrame(rows, columns=["id_detalle", "id_carrito", "fecha"]))


def test_entry_maps_compose(spark):
    """A map gives what a replay of its partition gives, for any entering cart."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        t = np.sort(rng.integers(0, int(rng.choice([1, 3, 40])) * carts._LIFE, int(rng.integers(1, 60))))
        first, last, count = carts._entry_map(t)
        for start in [int(t[0]) - int(x) for x in rng.integers(0, 3 * carts._LIFE, 8)] + [int(t[0]), int(t[0]) - carts._LIFE]:
            starts, numbers = carts._place(t, start, 7)
            k = int(np.searchsorted(first, start + carts._LIFE, side="right"))
            assert (starts[-1], numbers[-1]) == ((last[k], 7 + count[k]) if k < len(first) else (start, 7))


def test_asof_rate_many_rates_in_a_month(spark):
    from vitrina.streaming import rates
    t = dt.datetime
    r = spark.createDataFrame([(t(2024, 3, 1), 1.0), (t(2024, 3, 5), 2.0), (t(2024, 3, 5, 12), 3.0),
                               (t(2024, 5, 2), 4.0)], "fecha timestamp_ntz, tasa double")
    f = spark.createDataFrame([(1, t(2024, 3, 4)), (2, t(2024, 3, 5, 6)), (3, t(2024, 4, 30)), (4, t(2024, 5, 2)),
                               (5, t(2024, 6, 9))], "k long, fecha timestamp_ntz")
    got = {x.k: x.tasa for x in rates.asof_rate(f, r).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 4.0}


def test_asof_rate_every_minute_inactive_rates_and_a_hot_day(spark):
    import bisect
    from vitrina.streaming import rates
    start = dt.datetime(2024, 3, 5)
    r = [(start + dt.timedelta(minutes=m), float(m), int(m % 5 != 0)) for m in range(1, 1440)] + [(dt.datetime(2024, 2, 1), -1.0, 1), (None, 5.0, 1)]
    f = [(k, start + dt.timedelta(seconds=(k * 7919) % 86400)) for k in range(1500)]
    f += [(2000, dt.datetime(2024, 4, 1)), (2001, dt.datetime(2024, 1, 1)), (2002, None)]
    got = {x.k: x.tasa for x in rates.asof_rate(spark.createDataFrame(f, "k long, fecha timestamp_ntz"),
                                                spark.createDataFrame(r, "fecha timestamp_ntz, tasa double, activa int")).collect()}
    live = sorted((d, v) for d, v, a in r if a and d)
    for k, d in f:
        i = bisect.bisect_right(live, (d, float("inf"))) if d else 0
        assert got[k] == (live[i - 1][1] if i else None), k


def test_shop_limits_count_their_own_route(spark):
    from vitrina.streaming import limits
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=i), "login") for i in range(11)] + [("b", t + dt.timedelta(seconds=i), "shop") for i in range(40)]
    rows += [("b", t, "register")] * 6
    got = limits.shop_limit_flags(spark.createDataFrame(rows, "direccion string, ts timestamp_ntz, ruta string")).collect()
    assert {(r.direccion, r.ruta, r.solicitudes, r.limite) for r in got} == {("a", "login", 11, 10), ("b", "register", 6, 5)}
