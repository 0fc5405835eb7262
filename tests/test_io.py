"""Sources and sinks over real files (binaryFile, JSON, CSV)."""

import os
import tempfile

from pyspark.sql import functions as F

from vitrina.operators import orders, sales
from vitrina.sources import files, sinks


def _scratch():
    return tempfile.mkdtemp(prefix="vitrina-io-", dir="/tmp")


def test_read_rate_feed_from_files(spark):
    d = _scratch()
    docs = ['{"current": {"usd": 36.1, "eur": 39.2}}', '{"current": {"usd": 0, "eur": 40.0}}',
            '{"current": {"usd": 37.5, "eur": 40.5}}']
    for i, doc in enumerate(docs):
        p = os.path.join(d, f"rate_{i}.json")
        with open(p, "w") as fh:
            fh.write(doc)
        os.utime(p, (1_700_000_000 + i * 3600, 1_700_000_000 + i * 3600))
    r = files.read_rate_feed(spark, d).first()
    assert (r.usd, r.eur) == (37.5, 40.5)


def test_import_catalogue_from_folders(spark, ctx):
    d = _scratch()
    names = {"boligrafos": ["azul_fino.jpg", "rojo-grueso.PNG", "notas.txt"], "termos": ["acero_500ml.jpeg"],
             "otros": ["x.jpg"]}
    for folder, fs in names.items():
        os.makedirs(os.path.join(d, folder))
        for f in fs:
            with open(os.path.join(d, folder, f), "wb") as fh:
                fh.write(b"\x89PNG")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select("path")
    out = files.import_catalogue(listing, ctx["productos"], ctx["categorias"])
    prods = sorted((r.nombre, float(r.precio_venta), r.categoria) for r in out["products"].collect())
    assert prods == [("acero 500ml", 13.0, "Termos"), ("azul fino", 3.0, "Boligrafos"),
                     ("rojo grueso", 3.0, "Boligrafos")]
    assert {r.stock_actual for r in out["stock"].collect()} == {10}
    base = ctx["productos"].agg(F.max("id_producto")).first()[0]
    assert sorted(r.id_producto for r in out["products"].collect()) == [base + 1, base + 2, base + 3]
    assert sorted(r.nombre for r in out["categories"].collect()) == ["Boligrafos", "Termos"]


def test_sales_report_csv_round_trip(spark, ctx):
    d = _scratch()
    rep = sales.sales_report(ctx, "1997-01-01", "1997-01-31")
    sinks.write_sales_report_csv(rep, os.path.join(d, "r"))
    import glob
    parts = sorted(glob.glob(os.path.join(d, "r", "part-*.csv")))
    back = spark.read.option("header", True).csv(os.path.join(d, "r"))
    rows = []
    for f in parts:  # part files in name order are the report in order
        rows += spark.read.option("header", True).csv(f).collect()
    assert back.columns == sinks.REPORT_HEADER
    assert len(rows) == rep.count() + 1
    assert rows[-1]["Items"] == "Total General"
    dates = [r["Fecha"] for r in rows[:-1]]
    assert dates[0].endswith("1997") and len(parts) >= 1
    total = sum(float(r["Total"]) for r in rows[:-1])
    assert abs(total - float(rows[-1]["Total"])) < 0.005


def test_item_arrays_agree_with_counts(spark, ctx):
    det = orders.order_detail(ctx, with_items=True)
    bad = det.filter(F.coalesce(F.size("items"), F.lit(0)) != F.col("n_items")).count()
    assert bad == 0
    docs = sinks.order_documents(orders.order_items(ctx))
    per = docs.groupBy("id_pedido").agg(F.count("*").alias("n"), F.max("posicion").alias("last"), F.count_distinct("posicion").alias("d"))
    assert per.filter("n <> last + 1 or n <> d").count() == 0
    assert docs.filter(F.get_json_object("item_json", "$.quantity").isNotNull()).count() == ctx["detalle_pedidos"].filter("cantidad is not null").count()


def test_checkout_frames_are_consistent(spark, ctx):
    out = __import__("vitrina.operators.changes", fromlist=["checkout"]).checkout(ctx, ctx["carrito_compra"])
    s = out["summary"]
    assert s.count() == out["orders"].count() == out["sales"].count() == out["invoices"].count()
    assert out["order_lines"].count() == s.agg(F.sum("lineas")).first()[0]
    assert s.join(out["rejected"], "id_carrito").count() == 0


def test_invoice_lines_and_snapshot(spark, ctx):
    inv = sales.invoice_totals(ctx, with_lines=True)
    lines = ctx["detalle_ventas"].groupBy("id_venta").count().withColumnRenamed("id_venta", "id")
    chk = inv.join(lines, "id", "left").filter(F.coalesce(F.size("detalles"), F.lit(0)) != F.coalesce("count", F.lit(0)))
    assert chk.count() == 0
    d = _scratch()
    sinks.write_snapshot(inv.select("id", "numero", "total"), os.path.join(d, "facturas"))
    assert spark.read.parquet(os.path.join(d, "facturas")).count() == ctx["ventas"].count()


def test_linked_accounts_map(spark, ctx):
    from vitrina.operators import accounts
    m = accounts.linked_accounts_map(ctx["cuentas_vinculadas"])
    for r in m.collect():
        assert set(r.cuentas) <= {"google", "facebook"}
        assert all(v.endswith("@example.com") for v in r.cuentas.values())


def test_custom_report_period(spark):
    import datetime as dt
    from vitrina.functions import periods
    f, t = periods.report_period("custom", F.lit(dt.date(1998, 3, 18)), F.lit("1998-01-05"), F.lit("1998-02-01"))
    r = spark.range(1).select(f.alias("f"), t.alias("t")).first()
    assert (r.f, r.t) == (dt.date(1998, 1, 5), dt.date(1998, 2, 1))
    f, t = periods.report_period("annual", F.lit(dt.date(1998, 3, 18)))
    r = spark.range(1).select(f.alias("f"), t.alias("t")).first()
    assert (r.f, r.t) == (dt.date(1998, 1, 1), dt.date(1998, 3, 18))


def test_read_evolving_merges_old_and_new_files(spark):
    from vitrina.operators import checks
    d = _scratch()
    spark.createDataFrame([(1, "Ana")], "id_cliente long, nombre string").write.parquet(f"{d}/t/a=1")
    spark.createDataFrame([(2, "Luis", "V-2")], "id_cliente long, nombre string, cedula string").write.parquet(f"{d}/t/a=2")
    df = checks.read_evolving(spark, f"{d}/t", [("cedula", "string", None), ("origen", "string", "auto")])
    rows = {r.id_cliente: (r.cedula, r.origen) for r in df.collect()}
    assert rows == {1: (None, "auto"), 2: ("V-2", "auto")}


def test_bad_payloads_give_no_row_and_no_error(spark):
    bad = ['[{"id": 1, "quan', '{"id": 1}', '[1, "a", null, [2]]', '[{"id": 1, "quantity": [2]}]', '[{"id": 1, "quantity": 1e400}]', "", None,
           '[{"id": {"a": 1}}]', '[{"id": 99999999999999999999999999}]']
    good = '[5, {"id": 3, "quantity": 2, "price": "4.5", "name": "n", "details": {"color": "azul"}}]'
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, good])], "id_carrito long, payload string")
    rows = files.parse_cart_payload(df).collect()
    assert [(r.id_carrito, r.pos, r.id, r.quantity, r.price, r.details) for r in rows] == [(len(bad), 1, 3, 2, 4.5, '{"color":"azul"}')]


def test_constraints_of_a_table_share_one_pass(spark):
    from plan_text import final_plan
    from vitrina.operators import checks
    rules = [("t", "unique", "k", None, None), ("t", "unique", ("a", "b"), None, None), ("t", "foreign", "r", "ref", "id"),
             ("t", "foreign", "k", "ref", "id"), ("t", "foreign", "a", "names", "name"), ("t", "not_null", "a", None, None)]
    rows = [(1, "x|y", "z", 7), (1, "x", "y|z", 7), (None, None, "z", 9), (None, "x", "y|z", None), (2, "", "", 8), (3, None, None, 8)]
    ctx = {"t": spark.createDataFrame(rows, "k long, a string, b string, r int"),
           "ref": spark.createDataFrame([(7,), (1,), (2,), (None,)], "id long"),
           "names": spark.createDataFrame([("x",), ("",)], "name string")}
    found = checks.constraint_violations(ctx, rules)
    got = {(r.regla, r.columna, r.clave, r.filas) for r in found.collect()}
    assert got == {("unique", "k", "1", 2), ("unique", "a,b", "x|y|z", 2), ("foreign", "r", "8", 2), ("foreign", "r", "9", 1),
                   ("foreign", "k", "3", 1), ("foreign", "a", "x|y", 1), ("not_null", "a", None, 2)}
    plan = final_plan(checks.constraint_violations(ctx, [r for r in rules if r[1] == "unique"]))
    assert plan.count("Generate explode") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert checks.constraint_violations({k: v.limit(0) for k, v in ctx.items()}, rules).count() == 0


def test_constraints_hold_each_key_once(spark):
    """Rules on the same columns share a key, referenced keys need no join, and
    each table's aggregate has a stage of its own."""
    from plan_text import final_plan
    from vitrina.operators import checks
    rules = [("t", "unique", "k", None, None), ("t", "foreign", "k", "ref", "id"), ("t", "foreign", "k", "other", "id"), ("t", "not_null", "k", None, None),
             ("u", "foreign", "k", "ref", "id"), ("u", "not_null", "k", None, None)]
    long = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    ctx = {"t": long("k", 1, 1, 2, 3, 4, 4, 4, None), "u": long("k", 2, 0, 0), "ref": long("id", 1, 2, 2, 2, None, 9), "other": long("id", 4, 3, 3, 1)}
    found = checks.constraint_violations(ctx, rules)
    assert sorted(tuple(r) for r in found.fillna({"clave": "NULL"}).collect()) == [
        ("t", "foreign", "k", "2", 1), ("t", "foreign", "k", "3", 1), ("t", "foreign", "k", "4", 3),
        ("t", "not_null", "k", "NULL", 1), ("t", "unique", "k", "1", 2), ("t", "unique", "k", "4", 3), ("u", "foreign", "k", "0", 2)]
    plan = final_plan(found)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("REBALANCE") == 2
