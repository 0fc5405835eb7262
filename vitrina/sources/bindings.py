"""Shop tables presented over the driver's parquet data.

``ShopTables`` is the ``ctx`` every operator takes: a lazy mapping from shop
table name to a DataFrame. Nothing is read until a table is asked for, and
every table is a projection / filter / small aggregate of one driver table, so
Catalyst prunes columns and pushes the filters into the parquet scan.

The rules (which rows become which shop rows, which gaps are made on purpose)
are fixed values of the test bindings and are mirrored in SQL by
``vitrina.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.sources.schema import DRIVER_SCHEMAS

DEC = "decimal(18,2)"
RATE = "decimal(12,4)"

# The four order states, ids 1..4 (in this order).
ORDER_STATES = ["Pendiente de Verificación", "Procesando", "Enviado", "Entregado"]
# The category that the shop adds for custom products.
CUSTOM_CATEGORY = (99, "Personalizado")


def _no_text(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def _mod(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))


class ShopTables:
    """Lazy, memoised shop tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._memo: dict[str, DataFrame] = {}

    # raw driver tables, read with a fixed schema (no inference)
    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._memo:
            reader = self.spark.read
            if name in DRIVER_SCHEMAS:
                reader = reader.schema(DRIVER_SCHEMAS[name])
            self._memo[key] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._memo[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._memo:
            build = getattr(self, "_t_" + name, None)
            if build is None:
                raise KeyError(name)
            self._memo[name] = build()
        return self._memo[name]

    def __contains__(self, name: str) -> bool:
        return hasattr(self, "_t_" + name)

    def dim(self, name: str) -> DataFrame:
        """A dimension table for joins. Spark's own size check decides whether
        it is broadcast."""
        return self[name]

    # ---- catalogue -------------------------------------------------------
    def _t_categorias(self) -> DataFrame:
        # distinct first: the window below then sees one row per category
        types = self.raw("part").select(F.col("p_type").alias("nombre")).distinct()
        numbered = types.select(
            F.row_number().over(Window.orderBy("nombre")).cast("long").alias("id_categoria"),
            "nombre")
        extra = self.spark.createDataFrame([CUSTOM_CATEGORY], "id_categoria long, nombre string")
        return numbered.unionByName(extra)

    def _t_productos(self) -> DataFrame:
        part = self.raw("part")
        cats = self.dim("categorias")
        j = part.join(cats, part.p_type == cats.nombre, "left")
        return j.select(
            F.col("p_partkey").alias("id_producto"),
            F.col("p_name").alias("nombre"),
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("descripcion"),
            F.col("p_retailprice").cast(DEC).alias("costo"),
            F.col("p_retailprice").cast(DEC).alias("precio_venta"),
            F.when(_mod(F.col("p_partkey"), 19) == 0, F.lit(None).cast("long"))
             .otherwise(F.col("id_categoria")).alias("id_categoria"),
            F.when(_mod(F.col("p_partkey"), 10) == 0, F.lit(0)).otherwise(F.lit(1)).alias("activo"),
        )

    def _t_inventario(self) -> DataFrame:
        return (self.raw("part").filter(_mod(F.col("p_partkey"), 17) != 0)
                .select(F.col("p_partkey").alias("id_producto"),
                        F.col("p_size").alias("stock_actual"),
                        F.lit(5).alias("stock_minimo")))

    def _t_imagenes_productos(self) -> DataFrame:
        li = self.raw("lineitem").filter(
            (F.col("l_returnflag") == "R") & (_mod(F.col("l_partkey"), 3) != 0))
        return li.select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id_imagen"),
            F.col("l_partkey").alias("id_producto"),
            F.concat(F.lit("img_"), F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("ruta_imagen"),
        ).distinct()

    # ---- people ----------------------------------------------------------
    def _t_clientes(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("id_cliente"),
            F.col("c_name").alias("nombre"),
            F.concat(F.lit("0414-"), F.col("c_custkey").cast("string")).alias("telefono"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("correo"),
            F.col("c_mktsegment").alias("direccion"),
            F.when(_mod(F.col("c_nationkey"), 2) == 0, F.lit("manual")).otherwise(F.lit("auto")).alias("origen"),
            F.when(F.col("c_acctbal") > 0, F.lit(1)).otherwise(F.lit(0)).alias("activo"),
        )

    def _t_usuarios(self) -> DataFrame:
        u = self.raw("events").select(F.col("user_id").alias("id_usuario")).distinct()
        return u.select(
            "id_usuario",
            F.concat(F.lit("user"), F.col("id_usuario").cast("string")).alias("nombre"),
            F.concat(F.lit("c"), F.col("id_usuario").cast("string"), F.lit("@example.com")).alias("correo"),
            (_mod(F.col("id_usuario"), 4) + 1).alias("id_rol"),
            (_mod(F.col("id_usuario"), 3) != 0).alias("has_password"),
        )

    def _t_cuentas_vinculadas(self) -> DataFrame:
        """External sign-in links from the signup events: provider by event id
        parity, provider id from props.k; one link per (provider, provider id),
        the earliest event wins."""
        e = self.raw("events").filter(F.col("event_type") == "signup")
        prov = F.when(_mod(F.col("event_id"), 2) == 0, F.lit("google")).otherwise(F.lit("facebook"))
        links = e.select(
            F.col("event_id").alias("id_cuenta"), F.col("user_id").alias("id_usuario"), prov.alias("proveedor"),
            F.concat(prov, F.lit("_"), F.get_json_object("props", "$.k")).alias("proveedor_id"),
            F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("proveedor_correo"))
        return links.groupBy("proveedor", "proveedor_id").agg(
            F.min_by(F.struct("id_cuenta", "id_usuario", "proveedor_correo"), "id_cuenta").alias("l")) \
            .select("l.id_cuenta", "l.id_usuario", "proveedor", "proveedor_id", "l.proveedor_correo")

    def _t_roles(self) -> DataFrame:
        # The three roles the shop creates at start.
        return self.spark.createDataFrame(
            [(1, "Administrador Panel"), (2, "Trabajador"), (3, "Administrador Web")],
            "id_rol long, nombre string")

    # ---- sales and orders -----------------------------------------------
    def _t_ventas(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id_venta"),
            F.when(_mod(F.col("o_orderkey"), 50) == 0, F.lit(-1).cast("long"))
             .otherwise(F.col("o_custkey")).alias("id_cliente"),
            F.col("o_orderdate").alias("fecha"),
            F.col("o_totalprice").cast(DEC).alias("total"),
        )

    def _lines(self, flag_is_r: bool) -> DataFrame:
        li = self.raw("lineitem")
        cond = (F.col("l_returnflag") == "R") if flag_is_r else (F.col("l_returnflag") != "R")
        return li.filter(cond)

    def _t_detalle_ventas(self) -> DataFrame:
        return self._lines(False).select(
            F.col("l_orderkey").alias("id_venta"),
            F.col("l_partkey").alias("id_producto"),
            F.col("l_quantity").cast("int").alias("cantidad"),
            F.col("l_extendedprice").cast(DEC).alias("precio_unitario"),
            F.col("l_linenumber").alias("id_detalle"),
            F.col("l_shipdate").alias("fecha"),
        )

    def _t_detalle_compras(self) -> DataFrame:
        return self._lines(True).select(
            F.col("l_suppkey").alias("id_proveedor"),
            F.col("l_partkey").alias("id_producto"),
            F.col("l_quantity").cast("int").alias("cantidad"),
            F.col("l_extendedprice").cast(DEC).alias("costo_unitario"),
            F.col("l_shipdate").alias("fecha"),
        )

    def _t_estados_pedido(self) -> DataFrame:
        rows = [(i + 1, n) for i, n in enumerate(ORDER_STATES)]
        return self.spark.createDataFrame(rows, "id_estado long, nombre string")

    def _t_pedidos(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id_pedido"),
            F.col("o_custkey").alias("id_cliente"),
            F.when(F.col("o_orderstatus") == "P", F.lit(1))
             .when(F.col("o_orderstatus") == "O", F.lit(2))
             .when(F.col("o_orderpriority") == "1-URGENT", F.lit(3))
             .otherwise(F.lit(4)).cast("long").alias("id_estado"),
            F.col("o_orderdate").alias("fecha"),
            F.col("o_totalprice").cast(DEC).alias("total"),
        )

    def _t_detalle_pedidos(self) -> DataFrame:
        return self["detalle_ventas"].withColumnRenamed("id_venta", "id_pedido")

    def _t_envios(self) -> DataFrame:
        o = self.raw("orders")
        p1 = F.substring("o_orderpriority", 1, 1)
        first = o.filter(_mod(F.col("o_orderkey"), 7) != 0).select(
            F.col("o_orderkey").alias("id_envio"),
            F.col("o_orderkey").alias("id_pedido"),
            F.when(p1.isin("1", "2"), F.lit("destino"))
             .when(p1 == "3", F.lit("tienda"))
             .when(p1 == "4", F.lit("agencia")).otherwise(F.lit("")).alias("tipo_envio"),
            F.when(_mod(F.col("o_orderkey"), 3) == 0, F.lit("Pendiente")).otherwise(F.lit("MRW")).alias("empresa_envio"),
            F.when(F.col("o_orderstatus") == "F",
                   F.concat(F.lit("G"), F.col("o_orderkey").cast("string"))).otherwise(F.lit("")).alias("numero_guia"),
            *_no_text("direccion_envio", "metodo_pago", "referencia_pago"),
        )
        second = o.filter(_mod(F.col("o_orderkey"), 13) == 0).select(
            (F.col("o_orderkey") + 10000000).alias("id_envio"),
            F.col("o_orderkey").alias("id_pedido"),
            F.lit("tienda").alias("tipo_envio"),
            F.lit("MRW").alias("empresa_envio"),
            F.lit("").alias("numero_guia"),
            *_no_text("direccion_envio", "metodo_pago", "referencia_pago"),
        )
        return first.unionByName(second)

    def _t_facturas(self) -> DataFrame:
        v = self["ventas"].filter(_mod(F.col("id_venta"), 11) != 0)
        return v.select(
            "id_venta",
            F.col("total").alias("subtotal"),
            F.lit(16).cast("decimal(5,2)").alias("porcentaje_iva"),
            F.round(F.col("total") * 16 / 100, 2).cast(DEC).alias("impuesto"),
        )

    def _t_tasas_cambio(self) -> DataFrame:
        months = (self.raw("orders")
                  .select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("fecha"))
                  .distinct())
        months = months.filter(_mod(F.month("fecha"), 2) == 1)
        tasa = ((F.lit(200) + (F.year("fecha") - 1995) * 20 + F.month("fecha")) * F.lit(0.1).cast("decimal(2,1)"))
        return months.select("fecha", tasa.cast(RATE).alias("tasa"),
                             F.when(F.month("fecha") == 7, 0).otherwise(1).alias("activa"))

    def _t_configuracion(self) -> DataFrame:
        # one row: default VAT, the latest bound rate as USD rate, no EUR rate
        r = self["tasas_cambio"]
        return r.agg(F.max_by("tasa", "fecha").alias("tasa_usd")).select(
            F.lit(16).cast("decimal(5,2)").alias("iva_default"),
            F.lit("USD").alias("moneda_principal"),
            F.col("tasa_usd").cast(RATE).alias("tasa_usd"),
            F.lit(0).cast(RATE).alias("tasa_eur"),
        )

    # ---- carts -----------------------------------------------------------
    def _t_cart_events(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id_detalle"),
            F.col("user_id").alias("id_carrito"),
            F.get_json_object("props", "$.k").cast("int").alias("id_producto"),
            (1 + _mod(F.col("event_id"), 3)).cast("int").alias("cantidad"),
            F.col("value").cast(DEC).alias("precio_unitario"),
            F.col("ts").alias("fecha"),
            "event_type",
        )

    def _t_detalle_carrito(self) -> DataFrame:
        """Saved cart lines: the click events."""
        return self["cart_events"].filter(F.col("event_type") == "click").drop("event_type")

    def _t_carrito_invitado(self) -> DataFrame:
        """Guest (cookie) cart lines: the view events."""
        return self["cart_events"].filter(F.col("event_type") == "view").drop("event_type")

    def _t_carrito_compra(self) -> DataFrame:
        """Carts sent to checkout / the counter: the purchase events."""
        return self["cart_events"].filter(F.col("event_type") == "purchase").drop("event_type")

    def _t_carrito_pago(self) -> DataFrame:
        """Carts sent to checkout with gaps: every 11th line has quantity 0, every
        13th none, every 7th is a custom line without product id."""
        k = F.col("id_detalle")
        c = self["carrito_compra"]
        return c.withColumn("cantidad", F.when(_mod(k, 11) == 0, F.lit(0)).when(_mod(k, 13) != 0, F.col("cantidad"))) \
            .withColumn("id_producto", F.when(_mod(k, 7) != 0, F.col("id_producto")))

    def _t_carrito_quitar(self) -> DataFrame:
        """Lines removed from saved carts: the error events."""
        return self["cart_events"].filter(F.col("event_type") == "error").drop("event_type")


def shop_views(spark: SparkSession, sf_dir: str) -> ShopTables:
    return ShopTables(spark, sf_dir)
