"""Orders decided first come, first served, against a sequential replay."""
import random
from decimal import Decimal

import pytest

from vitrina.functions import serve
from vitrina.operators import changes, orders

WANTS = "order long, item long, need long, used long, stock long"


def replay(rows):
    left = {item: s or 0 for _, item, _, _, s in rows if item is not None}
    refused = set()
    for order in sorted({r[0] for r in rows if r[0] is not None}):
        mine = [r for r in rows if r[0] == order and r[1] is not None]
        if all((need or 0) <= max(0, left[item]) for _, item, need, _, _ in mine):
            for _, item, _, used, _ in mine:
                left[item] = max(0, left[item] - max(0, used or 0))
        else:
            refused.add(order)
    return refused


def refused(spark, rows):
    return sorted(r.order for r in serve.refused_in_order(spark.createDataFrame(rows, WANTS)).collect())


@pytest.fixture
def rounds(monkeypatch):
    calls = []
    real = serve._replayed
    monkeypatch.setattr(serve, "_replayed", lambda *a: calls.append(a[2]) or real(*a))
    return calls


def test_random_orders_equal_the_replay(spark):
    rnd = random.Random(8)
    for items, stock in ((4, 25), (40, 3), (300, 1)):
        left = {i: rnd.choice([0, -2, None, stock, stock, 4 * stock]) for i in range(items)}
        left[0] = 50  # a hot item: in a third of the orders
        rows = []
        for order in range(400):
            picks = set(rnd.sample(range(items), rnd.randint(1, 3))) | ({0} if order % 3 == 0 else set())
            rows += [(order, i, n, n + rnd.randint(0, 1), left[i]) for i in picks for n in [rnd.choice([-1, 0, 1, 1, 2, 3])]]
        want = replay(rows)
        assert refused(spark, rows) == sorted(want) and 0 < len(want) < 400


def test_a_chain_of_waiting_orders_takes_few_rounds(spark, rounds):
    """Each order shares an item with the one before, so its fate hangs on the whole chain."""
    rows = [(k, i, 1, 1, 1) for k in range(1000) for i in (k, k + 1)]
    assert refused(spark, rows) == list(range(1, 1000, 2))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rounds) <= parts + 2


def test_counter_sales_in_a_chain(spark):
    rows = [(k, 2 * k + j, k + 1 + j, 1, Decimal("1.00")) for k in range(1000) for j in (0, 1)]
    lines = spark.createDataFrame(rows, "id_carrito long, id_detalle long, id_producto long, cantidad int, precio_unitario decimal(14,2)")
    stock = spark.createDataFrame([(i, 1) for i in range(1, 1002)], "id_producto long, stock_actual int")
    got = changes._counter_rejections(lines, stock)
    assert sorted(r.id_carrito for r in got.collect()) == list(range(1, 1000, 2))


def test_client_matching_in_a_chain(spark, rounds):
    """1,000 rows that share the e-mail, then the name, in turn with the row before."""
    rows = [(k, f"N{(k + 1) // 2}", f"m{k // 2}@x.com", "A", "", "") for k in range(1000)]
    inc = spark.createDataFrame(rows, "key long, nombre string, correo string, direccion string, telefono string, cedula string")
    clients = spark.createDataFrame([], "id_cliente long, nombre string, correo string, direccion string")
    got = {r.key: (r.id_cliente, r.tier) for r in orders.match_or_create_clients(inc, clients).collect()}
    by_mail, by_name, want = {}, {}, {}
    for k, name, mail, *_ in rows:
        if mail in by_mail:
            want[k] = (by_mail[mail], "correo")
        elif name in by_name:
            want[k] = (by_name[name], "nombre_direccion")
        else:
            by_mail[mail] = by_name[name] = len(by_name) + 1
            want[k] = (len(by_name), "nuevo")
    assert got == want
    assert len(rounds) <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 2


def test_defined_results_for_odd_rows(spark):
    rows = [(None, 1, 1, 1, 1), (1, None, 9, 9, 0), (2, 1, None, None, 1), (3, 1, 1, -5, 1), (4, 1, 1, 1, 1), (5, 1, 1, 1, 1), (6, 2, 1, 1, None)]
    assert refused(spark, rows) == [5, 6]
    assert refused(spark, []) == []


def test_an_order_of_many_items_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(k, i, 1, 1, 2) for k in range(4) for i in range(300)] + [(4, 7, 1, 1, 2)]
        assert refused(spark, rows) == [2, 3, 4]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
