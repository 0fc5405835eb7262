"""Table-changing jobs on tiny hand-made frames: the quirks SURVEY §2 marks."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vitrina.operators import accounts, changes, orders

D = "decimal(18,2)"


class Ctx(dict):
    """A stand-in for ShopTables over hand-made frames."""

    def __init__(self, spark, **tables):
        super().__init__(**tables)
        self.spark = spark

    def dim(self, name):
        return self[name]


def _states(spark):
    return spark.createDataFrame([(1, "Pendiente de Verificación"), (2, "Procesando"), (3, "Enviado"),
                                  (4, "Entregado")], "id_estado long, nombre string")


def test_verify_orders_guard_and_clamp(spark):
    ctx = Ctx(spark, estados_pedido=_states(spark),
              pedidos=spark.createDataFrame([(1, 1), (2, 3), (3, 9)], "id_pedido long, id_estado long"),
              detalle_pedidos=spark.createDataFrame([(1, 7, 4), (1, 7, 4), (2, 7, 1), (3, 8, 2), (3, 8, -5)],
                                                    "id_pedido long, id_producto long, cantidad int"),
              inventario=spark.createDataFrame([(7, 6), (8, None)], "id_producto long, stock_actual int"))
    decided, stock = changes.verify_orders(ctx, ctx["pedidos"])
    d = {r.id_pedido: (r.aceptado, r.estado_despues) for r in decided.collect()}
    # pending -> processing; shipped rejected; unknown state (NULL name) passes the guard
    assert d == {1: (True, 2), 2: (False, 3), 3: (True, 2)}
    s = {r.id_producto: r.stock_despues for r in stock.collect()}
    assert s == {7: 0, 8: None}  # 6 - 8 clamps at 0; NULL stock stays NULL; -5 line rejected


def test_checkout_rejects_whole_cart_with_a_short_line(spark):
    inv = spark.createDataFrame([(1, 5), (2, 0)], "id_producto long, stock_actual int")
    lines = spark.createDataFrame([(10, 1, 1, 2, Decimal("3.00")), (10, 2, 2, 1, Decimal("1.00")),
                                   (11, 3, 1, 5, Decimal("2.00")), (11, 4, None, 1, Decimal("9.99"))],
                                  f"id_carrito long, id_detalle long, id_producto long, cantidad int, precio_unitario {D}")
    chk = {r.id_detalle: r.ok for r in changes.stock_check(lines, inv).collect()}
    assert chk == {1: True, 2: False, 3: True, 4: True}  # custom line (no id) is not checked
    per = {(r.id_carrito, r.id_producto): r.ok for r in changes.stock_check(
        lines.unionByName(lines.filter("id_detalle = 3").withColumn("id_detalle", F.lit(5).cast("long"))),
        inv, per_product=True).collect()}
    assert per[(11, 1)] is False  # 5 + 5 > 5 once summed per product


def test_consolidate_and_rename_status(spark):
    cats = spark.createDataFrame([(1, "PROMO"), (2, "OLD"), (3, "LARGE")], "id_categoria long, nombre string")
    prods = spark.createDataFrame([(10, 2), (11, 3), (12, None), (13, 77)], "id_producto long, id_categoria long")
    ctx = Ctx(spark, categorias=cats, productos=prods, estados_pedido=_states(spark),
              pedidos=spark.createDataFrame([(1, 3), (2, 4)], "id_pedido long, id_estado long"))
    p, c = changes.consolidate_categories(ctx, ["PROMO", "LARGE"], "PROMO")
    assert {r.id_producto: r.id_categoria for r in p.collect()} == {10: 1, 11: 3, 12: None, 13: 77}
    assert sorted(r.nombre for r in c.collect()) == ["LARGE", "PROMO"]
    o, st = changes.rename_status(ctx, "Enviado", "Procesando")
    assert {r.id_pedido: r.id_estado for r in o.collect()} == {1: 2, 2: 4}
    assert st.count() == 3
    o2, st2 = changes.rename_status(ctx, "Pendiente", "Procesando")  # old state missing: no change
    assert {r.id_pedido: r.id_estado for r in o2.collect()} == {1: 3, 2: 4} and st2.count() == 4


def test_upsert_config_rules(spark):
    cfg = spark.createDataFrame([(Decimal("16.00"), Decimal("36.5000"), Decimal("39.0000"))],
                                "iva_default decimal(5,2), tasa_usd decimal(12,4), tasa_eur decimal(12,4)")
    t = dt.datetime
    ch = spark.createDataFrame(
        [(t(2024, 1, 1), None, Decimal("40.0000"), None), (t(2024, 1, 2), None, Decimal("0.0000"), Decimal("50.0000")),
         (t(2024, 1, 3), Decimal("12.00"), None, None)],
        "ts timestamp_ntz, iva decimal(5,2), usd decimal(12,4), eur decimal(12,4)")
    r = changes.upsert_config(cfg, ch).first()
    # the zero USD rate is rejected; the accepted one had no EUR, which becomes 0
    assert (r.iva_default, r.tasa_usd, r.tasa_eur) == (12.0, 40.0, 0.0)


def test_adjust_cart_quantities_bounds(spark):
    cart = spark.createDataFrame([(1, 5, 1, 2), (1, 6, 2, 98), (1, 7, 3, 1), (1, 8, 4, 150), (1, 9, 5, None)],
                                 "id_carrito long, id_producto long, id_detalle long, cantidad int")
    deltas = spark.createDataFrame([(1, 5, -7), (1, 6, 4), (1, 6, 1)], "id_carrito long, id_producto long, delta int")
    rem = spark.createDataFrame([(1, 7)], "id_carrito long, id_producto long")
    got = {r.id_producto: r.cantidad for r in changes.adjust_cart_quantities(cart, deltas, rem).collect()}
    assert got == {5: 1, 6: 103, 8: 150, 9: None}


def test_match_or_create_clients_tiers(spark):
    clients = spark.createDataFrame([(1, "Ana", "ana@x.com", "Caracas"), (2, "Luis", "", "Valencia")],
                                    "id_cliente long, nombre string, correo string, direccion string")
    inc = spark.createDataFrame(
        [(100, "Otra", "ana@x.com", "Maracay", "1", "V1"), (101, "Luis", "", "Valencia", "2", "V2"),
         (102, "Nuevo", "n@x.com", "Coro", "3", "V3"), (103, "Nuevo 2", "n@x.com", "Coro", "4", "V4"),
         (104, "Sin correo", "", "Merida", "5", "V5")],
        "key long, nombre string, correo string, direccion string, telefono string, cedula string")
    got = {r.key: (r.id_cliente, r.tier) for r in orders.match_or_create_clients(inc, clients).collect()}
    assert got[100] == (1, "correo") and got[101] == (2, "nombre_direccion")
    assert got[102] == (3, "nuevo") and got[103] == (3, "correo")  # 103 finds the client 102 created
    assert got[104] == (4, "nuevo")


def test_linked_accounts_rules(spark):
    users = spark.createDataFrame([(1, "a@x.com", True), (2, "b@x.com", False), (3, "c@x.com", False)],
                                  "id_usuario long, correo string, has_password boolean")
    links = spark.createDataFrame([(1, 2, "google", "g1", "b@x.com"), (2, 3, "google", "g2", "c@x.com"),
                                   (3, 3, "facebook", "f1", "c@x.com"), (4, 9, "google", "g9", "z@x.com")],
                                  "id_cuenta long, id_usuario long, proveedor string, proveedor_id string, proveedor_correo string")
    rules = {(r.id_usuario, r.proveedor): r.removible for r in accounts.link_removal_rules(links, users).collect()}
    assert rules[(2, "google")] is False  # only login method, no password
    assert rules[(3, "google")] is True and rules[(3, "facebook")] is True
    t = dt.datetime(2024, 1, 1)
    inc = spark.createDataFrame([("google", "g1", "zz@x.com", "u", t), ("google", "g9", "a@x.com", "u", t),
                                 ("facebook", "f7", "new@x.com", "u", t), ("google", "g7", "new@x.com", "u", t)],
                                "proveedor string, proveedor_id string, correo string, nombre string, ts timestamp_ntz")
    got = {r.proveedor_id: (r.id_usuario, r.via) for r in accounts.resolve_linked_accounts(inc, links, users).collect()}
    assert got["g1"] == (2, "vinculo")
    assert got["g9"] == (1, "correo")  # its link points to a deleted user: dropped, matched by e-mail
    assert got["f7"] == got["g7"] == (4, "nuevo")


def test_match_or_create_clients_chains_like_the_sequential_reference(spark):
    clients = spark.createDataFrame([(1, "Ana", "ana@x.com", "Caracas")],
                                    "id_cliente long, nombre string, correo string, direccion string")
    rows = [(10, "N1", "x@x.com", "A1"),   # creates 2
            (11, "N1", "y@x.com", "A1"),   # e-mail unknown; (N1, A1) was created by 10 -> 2
            (12, "N2", "y@x.com", "A2"),   # y@ never created (11 matched) -> creates 3
            (13, "N3", "y@x.com", "A3"),   # y@ now created by 12 -> 3
            (14, "N2", "z@x.com", "A2"),   # (N2, A2) created by 12 -> 3
            (9, "N4", "", "A4"),           # creates, and lowest key of all -> 2? no: key order 9 first
            (15, "N4", "", "A4")]          # (N4, A4) created by 9
    inc = spark.createDataFrame([(k, n, c, d, "", "") for k, n, c, d in rows],
                                "key long, nombre string, correo string, direccion string, telefono string, cedula string")
    got = {r.key: (r.id_cliente, r.tier) for r in orders.match_or_create_clients(inc, clients).collect()}
    # sequential replay: key 9 -> new 2, 10 -> new 3, 11 -> 3, 12 -> new 4, 13 -> 4, 14 -> 4, 15 -> 2
    assert got == {9: (2, "nuevo"), 10: (3, "nuevo"), 11: (3, "nombre_direccion"), 12: (4, "nuevo"),
                   13: (4, "correo"), 14: (4, "nombre_direccion"), 15: (2, "nombre_direccion")}


def test_active_rate_sources(spark):
    from vitrina.operators import sales
    cfg = lambda usd: spark.createDataFrame([(Decimal("16.00"), usd)], "iva_default decimal(5,2), tasa_usd decimal(12,4)")
    feed = spark.createDataFrame([(36.6,), (0.0,)], "usd double")
    manual = sales.active_rate(Ctx(spark, configuracion=cfg(Decimal("41.5000"))), feed).first()
    bcv = sales.active_rate(Ctx(spark, configuracion=cfg(Decimal("0.0000"))), feed).first()
    default = sales.active_rate(Ctx(spark, configuracion=cfg(None))).first()
    assert (float(manual.tasa), manual.fuente) == (41.5, "manual")
    assert (float(bcv.tasa), bcv.fuente) == (36.6, "bcv")
    assert (float(default.tasa), default.fuente) == (40.0, "bcv")


def test_physical_sales_replay(spark):
    """Carts served one by one against the stock left; hot product 1 has a third
    of the lines; custom lines, NULL, 0 and negative quantities, a product
    without a stock row."""
    import random
    rnd = random.Random(5)
    rows, k = [], 0
    for cart in range(1, 61):
        for _ in range(rnd.randint(1, 4)):
            k += 1
            product = 1 if rnd.random() < 0.33 else rnd.choice([2, 3, 4, 5, 6, 0, None, 99] if cart % 10 == 0 else [2, 3, 4, 5, 6, None])
            rows.append((cart, k, product, rnd.choice([None, 0, 1, 1, 2, 3, 5, -1]), Decimal("2.50")))
    stock0 = {1: 40, 2: 12, 3: 9, 4: 6, 5: 3, 6: 0}
    lines = spark.createDataFrame(rows, f"id_carrito long, id_detalle long, id_producto long, cantidad int, precio_unitario {D}")
    ctx = Ctx(spark, inventario=spark.createDataFrame(list(stock0.items()), "id_producto long, stock_actual int"),
              ventas=spark.createDataFrame([(7,)], "id_venta long"))
    got = changes.physical_sales(ctx, lines, F.lit(16).cast("decimal(5,2)"))
    left, accepted = dict(stock0), []
    for cart in range(1, 61):
        mine = [(p, 1 if q is None else q) for c, _, p, q, _ in rows if c == cart]
        if all(left.get(p, 0) >= q for p, q in mine if p):
            accepted.append(cart)
            for p, q in mine:
                if p in left:
                    left[p] = max(0, left[p] - max(0, q))
    head = {r.id_carrito: r.id_venta for r in got["summary"].collect()}
    assert sorted(head) == accepted and 0 < len(accepted) < 60
    assert [head[c] for c in accepted] == list(range(8, 8 + len(accepted)))
    assert {r.id_carrito for r in got["rejected"].collect()} == set(range(1, 61)) - set(accepted)
    after = {r.id_producto: r.stock_despues for r in got["stock"].collect()}
    assert all(left[p] == v for p, v in after.items())
    assert got["sale_lines"].count() == sum(c in head for c, *_ in rows)
    assert got["invoices"].count() == len(accepted)


def test_checkout_writes_clients_products_and_shipments(spark, monkeypatch):
    ctx = Ctx(spark, estados_pedido=_states(spark),
              inventario=spark.createDataFrame([(1, 5)], "id_producto long, stock_actual int"),
              productos=spark.createDataFrame([(1, "P")], "id_producto long, nombre string"),
              categorias=spark.createDataFrame([(3, "PROMO")], "id_categoria long, nombre string"),
              pedidos=spark.createDataFrame([(10,)], "id_pedido long"), ventas=spark.createDataFrame([(20,)], "id_venta long"),
              clientes=spark.createDataFrame([(4, "Ana", "ana@x.com", "0", "Coro", "manual")],
                                             "id_cliente long, nombre string, correo string, telefono string, direccion string, origen string"))
    carts = spark.createDataFrame(
        [(1, 1, 1, 0, Decimal("3.00")), (1, 2, None, 1, Decimal("9.00")), (2, 3, None, None, Decimal("4.00")),
         (3, 4, 1, 6, Decimal("3.00")), (4, 5, 1, 1, Decimal("3.00")), (5, 6, 1, 1, None)],
        f"id_carrito long, id_detalle long, id_producto long, cantidad int, precio_unitario {D}")
    form = lambda k, name, mail, kind, firm: (k, name, mail, f"t{k}", f"V{k}", kind, firm, "7", "Coro", "", "Zelle", None)
    forms = spark.createDataFrame(
        [form(1, "Ana", "ana@x.com", "destino", "MRW"), form(2, "Eva", "eva@x.com", "tienda", ""),
         form(3, "Leo", "leo@x.com", "destino", ""), form(4, "", "no@x.com", "destino", ""), form(5, "Eva B", "eva@x.com", "agencia", "")],
        "id_carrito long, nombre string, correo string, telefono string, cedula string, tipo_envio string, empresa_envio string, "
        "codigo_agencia string, ciudad string, estado string, metodo_pago string, referencia string")
    runs = {"match": 0, "stock": 0, "number": 0}

    def counted(module, name, key):
        real = getattr(module, name)

        def run(*args):
            runs[key] += 1
            return real(*args)
        monkeypatch.setattr(module, name, run)

    counted(orders, "match_or_create_clients", "match")
    counted(changes, "stock_check", "stock")
    counted(changes, "dense_ids", "number")
    got = changes.checkout(ctx, carts, forms, F.lit(16).cast("decimal(5,2)"))
    assert runs == {"match": 0, "stock": 0, "number": 0}  # nothing runs before a frame is asked for
    assert {r.id_carrito for r in got["rejected"].collect()} == {3, 4}  # short line; no name
    assert runs == {"match": 0, "stock": 1, "number": 1}
    assert {r.id_pedido: r.id_cliente for r in got["orders"].collect()} == {11: 4, 12: 5, 13: 5}
    clients = {r.id_cliente: (r.nombre, r.telefono, r.cambio) for r in got["clients"].collect()}
    assert clients == {4: ("Ana", "t1", "actualizado"), 5: ("Eva", "t5", "nuevo")}
    # header: quantity as given (0 x 3 + 9); lines: at least 1
    assert {r.id_venta: float(r.subtotal) for r in got["invoices"].collect()} == {21: 9.0, 22: 4.0, 23: 0.0}
    lines = {r.id_detalle: (r.id_producto, r.cantidad) for r in got["order_lines"].collect()}
    assert lines == {1: (1, 1), 2: (2, 1), 3: (3, 1), 6: (1, 1)}
    made = {r.id_producto: (r.nombre, r.id_categoria) for r in got["products"].collect()}
    assert made == {2: ("Producto Personalizado - 2", 4), 3: ("Producto Personalizado - 3", 4)}
    assert [(r.id_categoria, r.nombre) for r in got["categories"].collect()] == [(4, "Personalizado")]
    ships = {r.id_pedido: (r.empresa_envio, r.direccion_envio) for r in got["shipments"].collect()}
    assert ships[11] == ("Cobro a Destino - MRW", "MRW, Cód: 7, Coro") and ships[12][0] == "Retiro en Tienda"
    assert ships[13] == ("Retirar en Agencia", "Cód: 7, Coro")
    assert len(got) == 11 and all(f.columns for f in got.values())
    assert runs == {"match": 1, "stock": 1, "number": 2}  # each shared table was made once


def test_upsert_products_latest_valid_edit(spark):
    ctx = Ctx(spark, categorias=spark.createDataFrame([(1, "A")], "id_categoria long, nombre string"),
              productos=spark.createDataFrame([(1, Decimal("1.00"), 1), (2, Decimal("1.00"), 1)], f"id_producto long, costo {D}, activo int"))
    t = dt.datetime
    rows = [(1, "x", "A", Decimal("2.00"), 4, "a.png", "d", t(2024, 1, 1)), (1, "y", "A", Decimal("3.00"), 5, None, "d", t(2024, 1, 2)),
            (1, "z", "A", Decimal("9.00"), None, "z.png", "d", t(2024, 1, 3)), (2, "w", "A", Decimal("3.00"), None, None, "d", t(2024, 1, 1)),
            (None, "n", "B", Decimal("3.00"), None, None, "d", t(2024, 1, 1))]
    ch = spark.createDataFrame(rows, f"id_producto long, nombre string, categoria string, precio {D}, stock int, imagen string, descripcion string, ts timestamp_ntz")
    products, cats, stock, images = changes.upsert_products(ctx, ch)
    assert {r.id_producto: (r.nombre, r.cambio) for r in products.collect()} == {1: ("y", "actualizado"), 3: ("n", "nuevo")}
    assert {r.id_producto: r.stock_actual for r in stock.collect()} == {1: 5, 3: 0}
    assert [(r.id_producto, r.ruta_imagen) for r in images.collect()] == [(1, "a.png")] and cats.count() == 1


def test_sign_ins_without_mail_and_stale_links(spark):
    users = spark.createDataFrame([(1, "a@x.com"), (2, "")], "id_usuario long, correo string")
    links = spark.createDataFrame([(5, 9, "google", "g9", "z@x.com")],
                                  "id_cuenta long, id_usuario long, proveedor string, proveedor_id string, proveedor_correo string")
    t = lambda d: dt.datetime(2024, 1, d)
    inc = spark.createDataFrame([("google", "g1", None, "u1", t(1)), ("google", "g2", "", "u2", t(2)), ("google", "g9", "a@x.com", "u", t(3)),
                                 ("google", "g1", "a@x.com", "u1", t(4))],
                                "proveedor string, proveedor_id string, correo string, nombre string, ts timestamp_ntz")
    w = accounts.linked_account_writes(inc, links, users)
    assert {r.proveedor_id: (r.id_usuario, r.via) for r in w["resolved"].collect()} == {"g1": (3, "nuevo"), "g2": (4, "nuevo"), "g9": (1, "correo")}
    assert {r.id_usuario: (r.nombre, r.correo, r.id_rol) for r in w["new_users"].collect()} == {3: ("u1", None, 2), 4: ("u2", None, 2)}
    assert {r.proveedor_id: r.id_cuenta for r in w["new_links"].collect()} == {"g1": 6, "g2": 7, "g9": 8}
    assert [r.id_cuenta for r in w["stale_links"].collect()] == [5]


def test_new_ids_need_one_shuffle(spark):
    from vitrina.functions.ids import dense_ids
    rows = spark.range(0, 1000, 1, 8).selectExpr("(id * 7919) % 1000 as k")
    got = dense_ids(rows, ["k"], 10, "n")
    assert all(r.n == r.k + 11 for r in got.collect())
    assert rows.sparkSession.range(0).count() == 0 and dense_ids(rows.filter("k < 0"), ["k"], 1, "n").count() == 0


def test_stored_carts_are_replaced_by_folder(spark, tmp_path):
    """Only the folders of the given carts change; the rest keep their files."""
    import os
    from vitrina.operators import changes as ch
    schema = "id_carrito long, id_detalle long, id_producto long, cantidad int"
    path = str(tmp_path / "carts")
    old = [(c, 10 * c + k, k, 1) for c in range(20) for k in range(3)]
    ch.write_carts(spark.createDataFrame(old, schema), path, parts=8)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}

    before = files()
    ch.replace_stored_carts(path, spark.createDataFrame([(3, 900, 7, 2), (99, 901, 8, 1)], schema), parts=8)
    got = {tuple(r) for r in spark.read.parquet(path).select("id_carrito", "id_detalle", "id_producto", "cantidad").collect()}
    assert got == {r for r in old if r[0] != 3} | {(3, 900, 7, 2), (99, 901, 8, 1)}
    after = files()
    same = [f for f in before if after.get(f) == before[f]]
    changed_folders = {os.path.dirname(f) for f in after if f not in before}
    assert same and len(changed_folders) <= 2


def test_checkout_forms_by_shipment_type(spark):
    from vitrina.operators import catalog
    rows = [(1, None, None, None, None, None), (2, "", "x", "x", "x", "x"), (3, "retiro", None, None, None, None),
            (4, "destino", "MRW", " A1 ", "c", "e"), (5, "agencia", "", "a", "c", "e"), (6, "destino", "MRW", "  ", "c", "e"),
            (7, "agencia", "MRW", "a", None, "e"), (8, "destino", "MRW", "a", "c", " ")]
    forms = spark.createDataFrame(rows, "id long, tipo_envio string, empresa_envio string, codigo_agencia string, ciudad string, estado string")
    got = {r.id: r.reason for r in catalog.checkout_form_check(forms).collect()}
    assert got == {1: "falta tipo_envio", 2: "falta tipo_envio", 3: None, 4: None, 5: "falta empresa_envio", 6: "falta codigo_agencia",
                   7: "falta ciudad", 8: "falta estado"}
