"""Fixed schemas: the driver's parquet tables and the shop tables.

Every read goes through an explicit ``StructType`` (no inference, no extra
file listing pass). Timestamps are wall-clock values without zone
(``timestamp_ntz``), read and compared in UTC.
"""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DecimalType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampNTZType)

_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(),
          "boolean": BooleanType(), "timestamp_ntz": TimestampNTZType(),
          "decimal(18,2)": DecimalType(18, 2), "decimal(12,4)": DecimalType(12, 4),
          "decimal(5,2)": DecimalType(5, 2)}


def _st(fields: str) -> StructType:
    """'a long, b string' -> StructType (only the type names above)."""
    out = []
    for item in fields.replace("decimal(18, 2)", "decimal(18,2)").split(", "):
        name, typ = item.strip().split(" ", 1)
        out.append(StructField(name, _TYPES[typ.strip()], True))
    return StructType(out)


DRIVER_SCHEMAS: dict[str, StructType] = {
    "region": _st("r_regionkey int, r_name string"),
    "nation": _st("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _st("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": _st("s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    "part": _st("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": _st("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                  "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": _st("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                    "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": _st("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
}

# Shop tables (the columns the operators use). Money is decimal(18,2), rates
# decimal(12,4), flags int 0/1.
SHOP_SCHEMAS: dict[str, StructType] = {
    "categorias": _st("id_categoria long, nombre string"),
    "productos": _st("id_producto long, nombre string, descripcion string, costo decimal(18,2), "
                     "precio_venta decimal(18,2), id_categoria long, activo int"),
    "imagenes_productos": _st("id_imagen long, id_producto long, ruta_imagen string"),
    "inventario": _st("id_producto long, stock_actual int, stock_minimo int"),
    "clientes": _st("id_cliente long, nombre string, telefono string, correo string, direccion string, "
                    "fecha_registro timestamp_ntz, activo int, cedula string, origen string"),
    "usuarios": _st("id_usuario long, nombre string, correo string, id_rol long, activo int, "
                    "telefono string, has_password boolean"),
    "ventas": _st("id_venta long, id_cliente long, fecha timestamp_ntz, total decimal(18,2)"),
    "pedidos": _st("id_pedido long, id_cliente long, id_estado long, fecha timestamp_ntz, total decimal(18,2)"),
    "envios": _st("id_envio long, id_pedido long, direccion_envio string, empresa_envio string, "
                  "numero_guia string, estado_envio string, fecha_envio timestamp_ntz, metodo_pago string, "
                  "referencia_pago string, tipo_envio string"),
    "configuracion": _st("iva_default decimal(5,2), moneda_principal string, tasa_usd decimal(12,4), "
                         "tasa_eur decimal(12,4)"),
}

# Columns added to existing tables after creation, with their defaults.
# Fixed values (name, type, default) per table.
ADDED_COLUMNS: dict[str, list[tuple[str, str, object]]] = {
    "usuarios": [("telefono", "string", None)],
    "clientes": [("cedula", "string", None), ("origen", "string", "auto")],
    "envios": [("metodo_pago", "string", None), ("referencia_pago", "string", None),
               ("tipo_envio", "string", None)],
    "configuracion": [("tasa_eur", "decimal(12,4)", None), ("tasa_usd", "decimal(12,4)", None)],
}
