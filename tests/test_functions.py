"""Column functions and the reference's quirks (money, text, JSON, ids)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vitrina.functions import money, periods, text
from vitrina.functions.ids import dense_ids
from vitrina.operators import catalog, changes, checks
from vitrina.sources import files


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_vat_is_decimal_half_up(spark):
    v = spark.createDataFrame([(Decimal("16.72"),), (Decimal("2.675"),)], "s decimal(18,3)")
    r = v.select(money.vat_breakdown("s", F.lit(16)).alias("v")).collect()
    assert r[0].v.impuesto == Decimal("2.68") and r[0].v.total == Decimal("19.40")
    # subtotal itself is rounded HALF_UP in decimal (binary float would give 2.67)
    assert r[1].v.subtotal == Decimal("2.68")


def test_vat_rate_default(spark):
    assert _one(spark, money.vat_rate(F.lit(0))) == Decimal("16.00")
    assert _one(spark, money.vat_rate(F.lit(None).cast("decimal(5,2)"))) == Decimal("16.00")
    assert _one(spark, money.vat_rate(F.lit(12).cast("decimal(5,2)"))) == Decimal("12.00")


def test_invoice_number_keeps_all_digits(spark):
    assert _one(spark, money.invoice_number(F.lit(7))) == "INV-007"
    assert _one(spark, money.invoice_number(F.lit(1234))) == "INV-1234"


def test_format_price_layouts(spark):
    assert _one(spark, money.format_price(F.lit(1234.5), F.lit(36.6))) == "$1,234.50 / 45.182,70 Bs"
    assert _one(spark, money.format_price(F.lit(None), F.lit(40))) == "$0.00 / 0,00 Bs"
    assert _one(spark, money.format_admin_price(F.lit(15), F.lit(40))) == "Bs 600.00 (15.00$)"


def test_clamp_keeps_null(spark):
    assert _one(spark, money.clamp_at_zero(F.lit(-3))) == 0
    assert _one(spark, money.clamp_at_zero(F.lit(None).cast("int"))) is None


def test_price_from_text(spark):
    assert _one(spark, money.price_from_text(F.lit("$1,234.00 / 45.180,00 Bs"))) == Decimal("1234.00")


def test_product_name_from_file(spark):
    df = spark.createDataFrame([("mi_taza-azul.JPG",), (".hidden",), ("a.b.png",), ("  dos__espacios .jpg",)], "n string")
    got = [r.x for r in df.select(text.product_name_from_file("n").alias("x")).collect()]
    assert got == ["mi taza azul", ".hidden", "a.b", "dos espacios"]


def test_shipping_address_and_label(spark):
    df = spark.createDataFrame([("tienda", "MRW", "1", "Caracas", None), ("destino", "", "", "", ""),
                                ("agencia", "Zoom", "44", "Valencia", "Carabobo")], "t string, e string, c string, ci string, es string")
    r = df.select(text.shipping_address("t", "e", "c", "ci", "es").alias("a"),
                  text.shipping_label("t", "e").alias("l")).collect()
    assert r[0].a.startswith("Retiro en Tienda") and r[0].l == "Retiro en Tienda"
    assert r[1].a == "Por especificar" and r[1].l == "Cobro a Destino"
    assert r[2].a == "Zoom, Cód: 44, Valencia, Carabobo" and r[2].l == "Retirar en Agencia - Zoom"


def test_bar_width_and_capitalize(spark):
    assert _one(spark, text.bar_width(F.lit(1))) == 10
    assert _one(spark, text.bar_width(F.lit(7))) == 35
    assert _one(spark, text.bar_width(F.lit(50))) == 100
    assert _one(spark, text.capitalize(F.lit("tAZA"))) == "Taza"


def test_week_starts_on_sunday(spark):
    s, e = periods.period_bounds(F.lit(dt.date(1998, 3, 18)), "weekly")
    assert _one(spark, s) == dt.date(1998, 3, 15) and _one(spark, e) == dt.date(1998, 3, 21)
    f, t = periods.report_period("monthly", F.lit(dt.date(1998, 3, 18)))
    assert _one(spark, f) == dt.date(1998, 3, 1) and _one(spark, t) == dt.date(1998, 3, 18)


def test_like_pattern_escapes_backslash(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",), ("ÁB mayúscula",)], "n string")
    got = [r.n for r in df.filter(F.col("n").ilike(catalog.like_pattern("a\\b"))).collect()]
    assert got == ["a\\b"]
    assert df.filter(F.col("n").ilike(catalog.like_pattern("áb"))).count() == 1  # ilike folds all letters


def test_cart_payload_rules(spark):
    payload = ('[{"id": 0, "id_producto": 5, "price": 2, "quantity": -2},'
               ' {"id": "7", "price": "1.5", "quantity": 3.7},'
               ' {"id": 8, "price": "", "quantity": 1},'
               ' {"id": 9, "quantity": "3.7"},'
               ' {"name": "x", "quantity": 1},'
               ' {"id": 10},'
               ' {"id": 11, "quantity": null}]')
    df = spark.createDataFrame([(1, payload)], "id_carrito long, payload string")
    got = [(r.id, r.quantity, r.price) for r in files.parse_cart_payload(df).orderBy("pos").collect()]
    assert got == [(5, 1, 2.0), (7, 3, 1.5), (10, 1, 0.0)]


def test_rate_feed_keeps_last_good(spark):
    docs = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), '{"current": {"usd": 36.1, "eur": 39.0}}'),
         (dt.datetime(2024, 1, 2), '{"current": {"usd": 36.5, "eur": 0}}'),
         (dt.datetime(2024, 1, 3), 'not json')], "ts timestamp_ntz, doc string")
    r = files.parse_rate_docs(docs).first()
    assert (r.usd, r.eur) == (36.1, 39.0)


def test_dense_ids_equal_global_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 10007).alias("k")).repartition(7)
    out = dense_ids(df, ["k"], 100, "nid").orderBy("k").collect()
    assert [r.nid for r in out] == list(range(101, 101 + 5000))


def test_schema_evolve_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a")], "id long, origen string")
    added = [("cedula", "string", None), ("origen", "string", "auto")]
    once = checks.schema_evolve(df, added)
    assert once.columns == ["id", "origen", "cedula"]
    assert checks.schema_evolve(once, added).columns == once.columns


def test_merge_carts_adds_to_first_saved_line(spark):
    saved = spark.createDataFrame([(1, 5, 10, 1, Decimal("2.00")), (1, 5, 11, 2, Decimal("2.00"))],
                                  "id_carrito long, id_producto long, id_detalle long, cantidad int, precio_unitario decimal(18,2)")
    guest = spark.createDataFrame([(1, 5, 20, 3, Decimal("9.00")), (1, 6, 21, 1, Decimal("4.00")),
                                   (1, 6, 22, 2, Decimal("5.00"))], saved.schema)
    got = {(r.id_detalle, r.cantidad, r.precio_unitario, r.origen) for r in changes.merge_carts(guest, saved).collect()}
    assert got == {(10, 4, Decimal("2.00"), "guardado"), (11, 2, Decimal("2.00"), "guardado"),
                   (21, 3, Decimal("4.00"), "invitado")}
    total = sum(r.cantidad for r in changes.merge_carts(guest, saved).collect())
    assert total == 1 + 2 + 3 + 1 + 2  # quantity is preserved


def test_cart_payload_python_truthiness(spark):
    payload = ('[{"id": true, "quantity": " 4 "},'          # int(True) = 1; int(" 4 ") = 4
               ' {"id": "", "id_producto": 3, "price": 1e1},'  # '' is falsy -> id_producto
               ' {"id": 0.0, "id_producto": null},'            # both falsy/null -> dropped
               ' {"id": "0", "quantity": 2},'                  # "0" is truthy; int("0") = 0
               ' {"id": 12, "price": null}]')                  # float(None) fails -> dropped
    df = spark.createDataFrame([(1, payload)], "id_carrito long, payload string")
    got = [(r.id, r.quantity, r.price) for r in files.parse_cart_payload(df).orderBy("pos").collect()]
    assert got == [(1, 4, 0.0), (3, 1, 10.0), (0, 2, 0.0)]


def test_empty_inputs(spark):
    from vitrina.operators import orders as orders_mod
    empty = spark.createDataFrame([], "k long")
    assert dense_ids(empty, ["k"], 5, "nid").count() == 0
    clients = spark.createDataFrame([(1, "Ana", "a@x.com", "C")], "id_cliente long, nombre string, correo string, direccion string")
    inc = spark.createDataFrame([(7, "Ana", "a@x.com", "C", "", "")],
                                "key long, nombre string, correo string, direccion string, telefono string, cedula string")
    got = [(r.key, r.id_cliente, r.tier) for r in orders_mod.match_or_create_clients(inc, clients).collect()]
    assert got == [(7, 1, "correo")]  # nothing to create: the matching rounds see no rows
