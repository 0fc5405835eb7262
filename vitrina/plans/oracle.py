"""DuckDB SQL for the correctness gate.

``BINDINGS`` states the shop tables over the driver's tables in SQL (the same
rules ``vitrina.sources.bindings`` builds with the DataFrame API, written
independently). ``with_views(body)`` prepends, as CTEs, every binding the body
names, plus the bindings those depend on, in dependency order.
"""

from __future__ import annotations

import re

BINDINGS: dict[str, str] = {
    "categorias": """
        select cast(row_number() over (order by nombre) as bigint) id_categoria, nombre
        from (select distinct p_type nombre from part) t
        union all select 99, 'Personalizado'""",
    "productos": """
        select p_partkey id_producto, p_name nombre, concat(p_brand, ' ', p_type) descripcion,
          cast(p_retailprice as decimal(18,2)) costo, cast(p_retailprice as decimal(18,2)) precio_venta,
          case when p_partkey % 19 = 0 then null else c.id_categoria end id_categoria,
          case when p_partkey % 10 = 0 then 0 else 1 end activo
        from part left join categorias c on c.nombre = p_type""",
    "inventario": """
        select p_partkey id_producto, p_size stock_actual, 5 stock_minimo from part where p_partkey % 17 <> 0""",
    "imagenes_productos": """
        select distinct l_partkey * 100000 + l_suppkey id_imagen, l_partkey id_producto,
          concat('img_', cast(l_suppkey as varchar), '.jpg') ruta_imagen
        from lineitem where l_returnflag = 'R' and l_partkey % 3 <> 0""",
    "clientes": """
        select c_custkey id_cliente, c_name nombre, '0414-' || cast(c_custkey as varchar) telefono, concat('c', cast(c_custkey as varchar), '@example.com') correo,
          c_mktsegment direccion, case when c_nationkey % 2 = 0 then 'manual' else 'auto' end origen,
          case when c_acctbal > 0 then 1 else 0 end activo
        from customer""",
    "usuarios": """
        select id_usuario, concat('user', cast(id_usuario as varchar)) nombre,
          concat('c', cast(id_usuario as varchar), '@example.com') correo, id_usuario % 4 + 1 id_rol,
          id_usuario % 3 <> 0 has_password
        from (select distinct user_id id_usuario from events) t""",
    "cuentas_vinculadas": """
        select min(event_id) id_cuenta, arg_min(user_id, event_id) id_usuario, proveedor, proveedor_id,
          arg_min('c' || cast(user_id as varchar) || '@example.com', event_id) proveedor_correo
        from (select event_id, user_id, case when event_id % 2 = 0 then 'google' else 'facebook' end proveedor,
                (case when event_id % 2 = 0 then 'google' else 'facebook' end) || '_'
                  || json_extract_string(props, '$.k') proveedor_id
              from events where event_type = 'signup') t
        group by proveedor, proveedor_id""",
    "roles": """
        select cast(id_rol as bigint) id_rol, nombre
        from (values (1, 'Administrador Panel'), (2, 'Trabajador'), (3, 'Administrador Web')) t(id_rol, nombre)""",
    "ventas": """
        select o_orderkey id_venta, case when o_orderkey % 50 = 0 then -1 else o_custkey end id_cliente,
          o_orderdate fecha, cast(o_totalprice as decimal(18,2)) total
        from orders""",
    "detalle_ventas": """
        select l_orderkey id_venta, l_partkey id_producto, cast(l_quantity as int) cantidad,
          cast(l_extendedprice as decimal(18,2)) precio_unitario, l_linenumber id_detalle, l_shipdate fecha
        from lineitem where l_returnflag <> 'R'""",
    "detalle_compras": """
        select l_suppkey id_proveedor, l_partkey id_producto, cast(l_quantity as int) cantidad,
          cast(l_extendedprice as decimal(18,2)) costo_unitario, l_shipdate fecha
        from lineitem where l_returnflag = 'R'""",
    "estados_pedido": """
        select cast(id_estado as bigint) id_estado, nombre from (values (1, 'Pendiente de Verificación'),
          (2, 'Procesando'), (3, 'Enviado'), (4, 'Entregado')) t(id_estado, nombre)""",
    "pedidos": """
        select o_orderkey id_pedido, o_custkey id_cliente,
          cast(case when o_orderstatus = 'P' then 1 when o_orderstatus = 'O' then 2
               when o_orderpriority = '1-URGENT' then 3 else 4 end as bigint) id_estado,
          o_orderdate fecha, cast(o_totalprice as decimal(18,2)) total
        from orders""",
    "detalle_pedidos": """
        select id_venta id_pedido, id_producto, cantidad, precio_unitario, id_detalle, fecha from detalle_ventas""",
    "envios": """
        select o_orderkey id_envio, o_orderkey id_pedido,
          case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'destino'
               when substr(o_orderpriority, 1, 1) = '3' then 'tienda'
               when substr(o_orderpriority, 1, 1) = '4' then 'agencia' else '' end tipo_envio,
          case when o_orderkey % 3 = 0 then 'Pendiente' else 'MRW' end empresa_envio,
          case when o_orderstatus = 'F' then concat('G', cast(o_orderkey as varchar)) else '' end numero_guia,
          cast(null as varchar) direccion_envio, cast(null as varchar) metodo_pago,
          cast(null as varchar) referencia_pago
        from orders where o_orderkey % 7 <> 0
        union all
        select o_orderkey + 10000000, o_orderkey, 'tienda', 'MRW', '', null, null, null
        from orders where o_orderkey % 13 = 0""",
    "facturas": """
        select id_venta, total subtotal, cast(16 as decimal(5,2)) porcentaje_iva,
          cast(round(total * 16 / 100, 2) as decimal(18,2)) impuesto
        from ventas where id_venta % 11 <> 0""",
    "tasas_cambio": """
        select fecha, cast((200 + (year(fecha) - 1995) * 20 + month(fecha)) * 0.1 as decimal(12,4)) tasa,
          case when month(fecha) = 7 then 0 else 1 end activa
        from (select distinct cast(date_trunc('month', o_orderdate) as timestamp) fecha from orders) t
        where month(fecha) % 2 = 1""",
    "configuracion": """
        select cast(16 as decimal(5,2)) iva_default, 'USD' moneda_principal,
          cast(arg_max(tasa, fecha) as decimal(12,4)) tasa_usd, cast(0 as decimal(12,4)) tasa_eur
        from tasas_cambio""",
    "cart_events": """
        select event_id id_detalle, user_id id_carrito, cast(json_extract_string(props, '$.k') as int) id_producto,
          cast(1 + event_id % 3 as int) cantidad, cast(value as decimal(18,2)) precio_unitario, ts fecha, event_type
        from events""",
    "detalle_carrito": """
        select id_detalle, id_carrito, id_producto, cantidad, precio_unitario, fecha
        from cart_events where event_type = 'click'""",
    "carrito_invitado": """
        select id_detalle, id_carrito, id_producto, cantidad, precio_unitario, fecha
        from cart_events where event_type = 'view'""",
    "carrito_compra": """
        select id_detalle, id_carrito, id_producto, cantidad, precio_unitario, fecha
        from cart_events where event_type = 'purchase'""",
    "carrito_pago": """
        select id_detalle, id_carrito, case when id_detalle % 7 <> 0 then id_producto end id_producto,
          case when id_detalle % 11 = 0 then 0 when id_detalle % 13 <> 0 then cantidad end cantidad,
          precio_unitario, fecha
        from carrito_compra""",
    "carrito_quitar": """
        select id_detalle, id_carrito, id_producto, cantidad, precio_unitario, fecha
        from cart_events where event_type = 'error'""",
}

_NAME_RE = {n: re.compile(r"\b" + n + r"\b") for n in BINDINGS}


def _deps(sql: str) -> list[str]:
    return [n for n, rx in _NAME_RE.items() if rx.search(sql)]


def with_views(body: str) -> str:
    """Prepend the binding CTEs that ``body`` (transitively) refers to."""
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order:
            return
        for d in _deps(BINDINGS[name]):
            if d != name and d not in stack:
                visit(d, stack + (name,))
        order.append(name)

    for n in _deps(body):
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({BINDINGS[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{stripped[15:]}"
    if stripped[:5].lower() == "with ":
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{body}"
