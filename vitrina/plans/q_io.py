"""Registered sources, sinks, checks and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import money, text
from vitrina.operators import checks, orders, sales
from vitrina.plans.registry import register
from vitrina.sources import files, sinks
from vitrina.sources.schema import ADDED_COLUMNS

register("table_scan", "O01", "select * from lineitem")(
    lambda ctx: files.table_scan(ctx.spark, f"{ctx.sf_dir}/lineitem.parquet", "lineitem"))

register("schema_evolve", "O02", """
select *, cast(null as varchar) cedula from clientes
""")(lambda ctx: checks.schema_evolve(ctx["clientes"], ADDED_COLUMNS["clientes"]))

register("constraint_violations", "O03", checks.constraint_violations_sql())(checks.constraint_violations)

register("read_rate_feed", "O04", """
with docs as (
  select fecha ts, cast(tasa as double) usd,
    cast(case when month(fecha) = 11 then 0 else round(tasa * 1.08, 4) end as double) eur
  from tasas_cambio)
select arg_max(usd, ts) usd, arg_max(eur, ts) eur, max(ts) ts from docs where usd > 0 and eur > 0
""")(lambda ctx: files.parse_rate_docs(files.rate_docs_from_table(ctx["tasas_cambio"])))

register("parse_cart_payload", "O05", """
with e as (select *, id_detalle x from cart_events)
select id_detalle, cast(case when x % 61 = 0 then 2 else 0 end as integer) pos, cast(id_producto as bigint) id,
  cast(case when x % 19 = 0 or x % 23 = 0 then 1 when x % 37 = 0 then 3 when x % 41 = 0 then 4
       else greatest(1, cantidad) end as bigint) quantity,
  case when x % 71 = 0 then cast('inf' as double) when x % 47 = 0 then 12.5 else cast(precio_unitario as double) end price,
  'p' || cast(id_producto as varchar) name, case when x % 7 = 0 then 'rojo' else '' end details
from e
where not ((x % 11 = 0 or x % 29 = 0 or id_producto = 0) and x % 31 = 0)
  and not (x % 13 = 0 or (x % 17 = 0))
  and not (x % 53 = 0 or x % 59 = 0)
  and not (x % 67 = 0 and x % 19 <> 0 and x % 23 <> 0)
  and (x % 43 <> 0 or x % 71 = 0)
""")(lambda ctx: files.parse_cart_payload(files.cart_payloads_from_events(ctx["cart_events"]),
                                          owner="id_detalle"))

_IMPORT = """
f as (
  select id_producto src, '/import/' || folder || '/' || replace(nombre, ' ', '_') || '-'
      || cast(id_producto as varchar) || ext path, folder carpeta,
    replace(nombre, ' ', '_') || '-' || cast(id_producto as varchar) || ext archivo,
    replace(nombre, ' ', '_') || '-' || cast(id_producto as varchar) stem, ext
  from (select *, case id_producto % 4 when 0 then 'boligrafos' when 1 then 'termos' when 2 then 'mousepads'
                  else 'otros' end folder,
               case id_producto % 5 when 0 then '.JPG' when 1 then '.png' when 2 then '.jpeg' when 3 then '.gif'
                  else '.jpg' end ext from productos) p),
cfg as (select * from (values ('boligrafos', 'Boligrafos', 3.00), ('termos', 'Termos', 13.00),
                              ('mousepads', 'Mousepads', 7.00)) t(carpeta, categoria, precio)),
ok as (select f.*, cfg.categoria, cfg.precio from f join cfg on cfg.carpeta = f.carpeta
       where lower(f.ext) in ('.jpg', '.jpeg', '.png')),
new_cats as (
  select cast((select coalesce(max(id_categoria), 0) from categorias) + row_number() over (order by n.nombre) as bigint)
    id_categoria, n.nombre
  from (select distinct categoria nombre from ok) n
  where not exists (select 1 from categorias c where c.nombre = n.nombre)),
cats as (select nombre, id_categoria from categorias union all select nombre, id_categoria from new_cats)"""

register("import_catalogue", "O06/O53", f"""
with {_IMPORT}
select cast((select max(id_producto) from productos) + row_number() over (order by carpeta, archivo, path) as bigint)
    id_producto,
  trim(regexp_replace(translate(stem, '_-', '  '), '\\s+', ' ', 'g')) nombre,
  trim(regexp_replace(translate(stem, '_-', '  '), '\\s+', ' ', 'g')) descripcion,
  cast(precio as double) costo, cast(precio as double) precio_venta, c.id_categoria, 1 activo, ok.categoria, path
from ok left join cats c on c.nombre = ok.categoria
""")(lambda ctx: _imported_products(ctx))


def _imported_products(ctx):
    r = files.import_catalogue(files.image_paths_from_products(ctx), ctx["productos"], ctx["categorias"])
    return r["products"].select(
        "id_producto", "nombre", "descripcion", money.to_money("costo").alias("costo"),
        money.to_money("precio_venta").alias("precio_venta"), "id_categoria", "activo", "categoria", "path")

register("import_catalogue_categories", "O06", f"with {_IMPORT} select * from new_cats")(
    lambda ctx: files.import_catalogue(files.image_paths_from_products(ctx), ctx["productos"],
                                       ctx["categorias"])["categories"])

register("sales_report_rows", "O07/O52", """
with r as (
  select v.id_venta id, c.nombre cliente, v.fecha, count(d.id_detalle) items, coalesce(v.total, 0) total
  from ventas v left join clientes c on v.id_cliente = c.id_cliente
  left join detalle_ventas d on d.id_venta = v.id_venta
  where v.fecha >= timestamp '1997-01-01' and v.fecha <= timestamp '1997-12-31 23:59:59'
  group by v.id_venta, c.nombre, v.fecha, v.total)
select 0 orden, id, printf('INV-%03d', id) factura, coalesce(nullif(cliente, ''), 'Desconocido') cliente,
  strftime(fecha, '%-d/%-m/%Y') fecha_txt, cast(items as varchar) || ' producto(s)' items_txt,
  format('{:,.2f}', total) total_txt
from r
union all
select 1, null, '', '', '', 'Total General', format('{:,.2f}', coalesce(sum(total), 0)) from r
""")(lambda ctx: sinks.sales_report_rows(sales.sales_report(ctx, "1997-01-01", "1997-12-31").select(
    "id", F.when(F.col("cliente") == sales.UNKNOWN_CLIENT, F.lit(None)).otherwise(F.col("cliente")).alias("cliente"),
    "fecha", "items", "total")).drop("fecha_orden"))

register("top_products_sheet", "O08", """
select * from (
  select 0 orden, p.nombre "Producto", cast(sum(d.cantidad) as varchar) "Cantidad",
    cast(coalesce(sum(d.cantidad * d.precio_unitario), 0) as double) "Total"
  from detalle_ventas d join productos p on p.id_producto = d.id_producto
  group by d.id_producto, p.nombre
  order by sum(d.cantidad) desc nulls last, d.id_producto limit 5) t
union all
select 1, 'Ganancias Totales', '', cast(coalesce(sum(total), 0) as double) from ventas
""")(lambda ctx: sinks.top_products_sheet(
    sales.top_products(ctx, 5), ctx["ventas"].select(F.coalesce(F.sum("total"), F.lit(0))).scalar()))

register("order_documents", "O09", """
with it as (
  select d.id_pedido, d.id_detalle id, d.id_producto product_id, coalesce(p.nombre, 'Producto personalizado') name,
    d.cantidad quantity, cast(coalesce(d.precio_unitario, 0) as double) price,
    cast(coalesce(d.precio_unitario, 0) * case when d.cantidad is null or d.cantidad = 0 then 1
         else d.cantidad end as double) total
  from detalle_pedidos d left join productos p on p.id_producto = d.id_producto)
select id_pedido,
  row_number() over (partition by id_pedido order by id, product_id, name, quantity, price, total) - 1 posicion,
  cast(to_json(struct_pack(id := id, product_id := product_id, name := name, quantity := quantity,
                           price := price, total := total)) as varchar) item_json
from it
""")(lambda ctx: sinks.order_documents(orders.order_items(ctx)))

register("vat_breakdown", "O50", """
select id_venta, cast(total as double) subtotal, cast(round(total * 16 / 100, 2) as double) impuesto,
  cast(round(total + round(total * 16 / 100, 2), 2) as double) total
from ventas
""")(lambda ctx: ctx["ventas"].select(
    "id_venta", money.vat_breakdown("total", F.lit(16)).alias("v")).select(
    "id_venta", money.to_money("v.subtotal").alias("subtotal"), money.to_money("v.impuesto").alias("impuesto"),
    money.to_money("v.total").alias("total")))

register("select_cart_positions", "O54", """
select * from (
  select id_detalle, id_carrito, id_producto, cantidad, cast(precio_unitario as double) precio_unitario, fecha,
    cast(row_number() over (partition by id_carrito order by id_detalle) - 1 as integer) posicion
  from detalle_carrito) t where posicion in (0, 2)
""")(lambda ctx: orders.select_cart_positions(ctx["detalle_carrito"], [0, 2]).select(
    "id_detalle", "id_carrito", "id_producto", "cantidad", money.to_money("precio_unitario").alias("precio_unitario"),
    "fecha", "posicion"))

register("shipping_labels", "O55", """
select e.id_envio, e.tipo_envio,
  case when e.tipo_envio = 'tienda' then 'Retiro en Tienda — Av. Principal, Local 5, CC La Cascada, Caracas'
    else coalesce(nullif(concat_ws(', ', nullif(e.empresa_envio, ''), 'Cód: ' || nullif(e.numero_guia, ''),
                                   nullif(c.direccion, '')), ''), 'Por especificar') end direccion,
  case when e.tipo_envio in ('destino', 'agencia') and e.empresa_envio <> '' then
    (case e.tipo_envio when 'destino' then 'Cobro a Destino' else 'Retirar en Agencia' end) || ' - ' || e.empresa_envio
    else case e.tipo_envio when 'destino' then 'Cobro a Destino' when 'tienda' then 'Retiro en Tienda'
      when 'agencia' then 'Retirar en Agencia' else '' end end etiqueta
from envios e left join pedidos p on p.id_pedido = e.id_pedido left join clientes c on c.id_cliente = p.id_cliente
""")(lambda ctx: ctx["envios"].join(ctx["pedidos"].select("id_pedido", "id_cliente"), "id_pedido", "left")
     .join(ctx["clientes"].select("id_cliente", "direccion"), "id_cliente", "left")
     .select("id_envio", "tipo_envio",
             text.shipping_address("tipo_envio", "empresa_envio", "numero_guia", "direccion", F.lit(None))
             .alias("direccion"),
             text.shipping_label("tipo_envio", "empresa_envio").alias("etiqueta")))

register("top_products_bars", "O56", """
select d.id_producto, cast(sum(d.cantidad) as bigint) cantidad,
  cast(least(100, greatest(10, round(5 * sum(d.cantidad)))) as integer) ancho
from detalle_ventas d join productos p on p.id_producto = d.id_producto
group by d.id_producto order by cantidad desc nulls last, d.id_producto limit 5
""")(lambda ctx: sales.top_products(ctx, 5).select("id_producto", "cantidad",
                                                   text.bar_width("cantidad").alias("ancho")))

register("custom_product_text", "O57", """
select p_partkey id, 'Personalizado - ' || upper(substr(lower(p_type), 1, 1)) || lower(substr(p_type, 2)) nombre,
  '(' || upper(substr(lower(p_type), 1, 1)) || lower(substr(p_type, 2)) || ', ' || cast(p_size as varchar) || ', '
    || split_part(p_name, ' ', 1) || ', ' || p_brand || ')'
    || case when p_partkey % 3 = 0 then '' else ' con texto: ''' || p_name || ''' (Arial) en frente' end descripcion
from part
""")(lambda ctx: _custom_texts(ctx))


def _custom_texts(ctx):
    """Every part as a custom-product form: type, size, first word of the
    name as colour, brand as material, the name as text (none for every
    third part), Arial on the front."""
    name, desc = text.custom_product_text(
        F.lower("p_type"), "p_size", F.split("p_name", " ").getItem(0), "p_brand",
        F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit("")).otherwise(F.col("p_name")),
        F.lit("Arial"), F.lit("frente"))
    return ctx.raw("part").select(F.col("p_partkey").alias("id"), name.alias("nombre"), desc.alias("descripcion"))
