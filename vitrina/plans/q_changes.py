"""Registered table-changing jobs.

Change sets are derived from the driver's tables (see the ``*_from_*``
helpers in ``vitrina.operators.changes``); the SQL states the same rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions.money import to_money
from vitrina.operators import changes as ch
from vitrina.plans.registry import register

KEEP_CATEGORIES, DEFAULT_CATEGORY = ["PROMO", "LARGE", "Personalizado"], "PROMO"
AS_OF = "1998-08-02 00:00:00"

_VAT = "(select coalesce(case when max(iva_default) > 0 then max(iva_default) end, 16) from configuracion)"


def _money_cols(df, *names):
    return df.select(*[to_money(c).alias(c) if c in names else F.col(c) for c in df.columns])


register("merge_carts", "O58", """
with g as (
  select id_carrito, id_producto, sum(coalesce(cantidad, 1)) g_qty, min(id_detalle) g_id,
    arg_min(precio_unitario, id_detalle) g_price
  from carrito_invitado where id_producto is not null group by id_carrito, id_producto),
sf as (select id_carrito, id_producto, min(id_detalle) s_first from detalle_carrito
       group by id_carrito, id_producto),
adds as (select sf.s_first id_detalle, g.g_qty from g join sf
         on sf.id_carrito = g.id_carrito and sf.id_producto = g.id_producto)
select s.id_carrito, s.id_producto, s.id_detalle, cast(coalesce(s.cantidad, 1) + coalesce(a.g_qty, 0) as bigint) cantidad,
  cast(s.precio_unitario as double) precio_unitario, 'guardado' origen
from detalle_carrito s left join adds a on a.id_detalle = s.id_detalle
union all
select g.id_carrito, g.id_producto, g.g_id, cast(g.g_qty as bigint), cast(g.g_price as double), 'invitado'
from g where not exists (select 1 from sf where sf.id_carrito = g.id_carrito and sf.id_producto = g.id_producto)
""")(lambda ctx: _money_cols(ch.merge_carts(ctx["carrito_invitado"], ctx["detalle_carrito"]), "precio_unitario"))

register("replace_carts", "O59", """
select id_detalle, id_carrito, id_producto, cantidad, cast(precio_unitario as double) precio_unitario, fecha
from detalle_carrito d where not exists (select 1 from carrito_invitado n where n.id_carrito = d.id_carrito)
union all
select id_detalle, id_carrito, id_producto, cantidad, cast(precio_unitario as double), fecha from carrito_invitado
""")(lambda ctx: _money_cols(ch.replace_carts(ctx["detalle_carrito"], ctx["carrito_invitado"]), "precio_unitario"))

register("verify_orders", "O60", """
select p.id_pedido, p.id_estado estado_antes,
  case when e.nombre is null or e.nombre = 'Pendiente de Verificación'
       then coalesce((select max(id_estado) from estados_pedido where nombre = 'Procesando'), p.id_estado)
       else p.id_estado end estado_despues,
  (e.nombre is null or e.nombre = 'Pendiente de Verificación') aceptado
from pedidos p left join estados_pedido e on e.id_estado = p.id_estado
""")(lambda ctx: ch.verify_orders(ctx, ctx["pedidos"])[0])

register("verify_orders_stock", "O60", """
with ok as (
  select p.id_pedido from pedidos p left join estados_pedido e on e.id_estado = p.id_estado
  where e.nombre is null or e.nombre = 'Pendiente de Verificación'),
used as (
  select id_producto, sum(cantidad) descontado from detalle_pedidos
  where id_pedido in (select id_pedido from ok) and cantidad >= 0 and id_producto is not null
  group by id_producto)
select i.id_producto, i.stock_actual stock_antes, cast(u.descontado as bigint) descontado,
  cast(case when i.stock_actual - u.descontado is null then null
       else greatest(0, i.stock_actual - u.descontado) end as bigint) stock_despues
from inventario i join used u on u.id_producto = i.id_producto
""")(lambda ctx: ch.verify_orders(ctx, ctx["pedidos"])[1])

_UPDATES = """
u as (select id_pedido,
  case when id_pedido % 27 = 0 then 'Cancelado'
       else (['Pendiente de Verificación', 'Procesando', 'Enviado', 'Entregado'])[id_estado % 4 + 1] end estado
  from pedidos)"""

register("apply_status_updates", "O61", f"""
with {_UPDATES}
select p.id_pedido, p.id_estado estado_antes, coalesce(s.id_estado, p.id_estado) estado_despues,
  s.id_estado is not null aplicado
from pedidos p join u on u.id_pedido = p.id_pedido left join estados_pedido s on s.nombre = u.estado
""")(lambda ctx: ch.apply_status_updates(ctx, ch.status_updates_from_orders(ctx))[0])

register("apply_status_updates_envios", "O61", f"""
with {_UPDATES}
select e.id_envio, e.id_pedido, 'T' || cast(e.id_pedido as varchar) numero_guia, 'MRW' empresa_envio,
  'Enviado' estado_envio
from envios e join u on u.id_pedido = e.id_pedido where u.estado = 'Enviado'
""")(lambda ctx: ch.apply_status_updates(ctx, ch.status_updates_from_orders(ctx))[1])

_CHECK = """
chk as (
  select l.id_carrito, l.id_detalle, l.id_producto, greatest(1, coalesce(l.cantidad, 1)) cantidad_pedida,
    coalesce(i.stock_actual, 0) disponible,
    (l.id_producto is null or l.id_producto = 0 or coalesce(i.stock_actual, 0) >= greatest(1, coalesce(l.cantidad, 1))) ok,
    coalesce(p.nombre, 'Producto') pname
  from carrito_compra l left join inventario i on i.id_producto = l.id_producto
  left join productos p on p.id_producto = l.id_producto),
bad as (select distinct id_carrito from chk where not ok),
good as (select * from carrito_compra where id_carrito not in (select id_carrito from bad))"""

register("stock_check", "O63", f"""
with {_CHECK}
select id_detalle, id_carrito, id_producto, cantidad_pedida, disponible, ok,
  case when not ok then '"' || pname || '" no tiene stock suficiente. Disponible: ' || cast(disponible as varchar) end mensaje
from chk
""")(lambda ctx: ch.stock_check(ctx["carrito_compra"], ctx["inventario"], ctx["productos"]).select(
    "id_detalle", "id_carrito", "id_producto", "cantidad_pedida", "disponible", "ok", "mensaje"))

register("stock_check_per_product", "O63", """
with req as (select id_carrito, id_producto, cast(sum(greatest(1, coalesce(cantidad, 1))) as bigint) q
             from carrito_compra group by id_carrito, id_producto)
select r.id_carrito, r.id_producto, r.q cantidad_pedida, coalesce(i.stock_actual, 0) disponible,
  (r.id_producto is null or r.id_producto = 0 or coalesce(i.stock_actual, 0) >= r.q) ok
from req r left join inventario i on i.id_producto = r.id_producto
""")(lambda ctx: ch.stock_check(ctx["carrito_compra"], ctx["inventario"], per_product=True).select(
    "id_carrito", "id_producto", F.col("cantidad_pedida").cast("long").alias("cantidad_pedida"),
    "disponible", "ok"))

_CHECKOUT = f"""
chk as (
  select l.id_carrito, (l.id_producto is null or l.id_producto = 0
    or coalesce(i.stock_actual, 0) >= greatest(1, coalesce(l.cantidad, 1))) ok
  from carrito_pago l left join inventario i on i.id_producto = l.id_producto),
form as (
  select id_usuario id_carrito, nombre, 
    case when id_usuario % 4 = 0 then 'web' || id_usuario || '@mail.com' else correo end correo,
    '0416-' || id_usuario telefono, 'V-' || id_usuario cedula, (['destino', 'tienda', 'agencia'])[id_usuario % 3 + 1] tipo,
    id_usuario % 2 = 0 mrw, 'R' || id_usuario referencia,
    case when id_usuario % 3 = 1 then 'Retiro en Tienda — Av. Principal, Local 5, CC La Cascada, Caracas'
      when id_usuario % 2 = 0 then 'MRW, Cód: A' || id_usuario || ', Caracas'
      else 'Cód: A' || id_usuario || ', Caracas' end direccion
  from usuarios where id_usuario % 9 <> 0),
ok_carts as (
  select id_carrito from chk group by id_carrito having bool_and(ok)
  intersect select id_carrito from form),
good as (select l.* from carrito_pago l where id_carrito in (select id_carrito from ok_carts)),
amounts as (
  select id_carrito, count(*) lineas,
    cast(sum(coalesce(precio_unitario, 0) * coalesce(cantidad, 1)) as decimal(18,2)) subtotal
  from good group by id_carrito),
buyers as (
  select f.*, (select min(c.id_cliente) from clientes c where c.correo = f.correo) id_old
  from form f where id_carrito in (select id_carrito from ok_carts)),
fresh as (
  select id_carrito, (select max(id_cliente) from clientes) + row_number() over (order by id_carrito) id_new
  from buyers where id_old is null),
head as (
  select a.*, {_VAT} pct, round(a.subtotal * {_VAT} / 100, 2) impuesto, coalesce(b.id_old, f.id_new) id_cliente,
    (select max(id_pedido) from pedidos) + row_number() over (order by a.id_carrito) id_pedido,
    (select max(id_venta) from ventas) + row_number() over (order by a.id_carrito) id_venta
  from amounts a join buyers b on b.id_carrito = a.id_carrito left join fresh f on f.id_carrito = a.id_carrito),
custom as (
  select id_carrito, id_detalle,
    cast((select max(id_producto) from productos) + row_number() over (order by id_carrito, id_detalle) as bigint) id_custom
  from good where id_producto is null or id_producto = 0),
line as (
  select h.id_pedido, h.id_venta, g.id_detalle, coalesce(c.id_custom, g.id_producto) id_producto,
    greatest(1, coalesce(g.cantidad, 1)) cantidad, cast(coalesce(g.precio_unitario, 0) as double) precio_unitario
  from good g join head h on h.id_carrito = g.id_carrito
  left join custom c on c.id_carrito = g.id_carrito and c.id_detalle = g.id_detalle)"""


def _checkout(frame, *money):
    return lambda ctx: _money_cols(ch.checkout(ctx, ctx["carrito_pago"], ch.checkout_forms_from_users(ctx), as_of=AS_OF)[frame], *money)


register("checkout", "O62", f"""
with {_CHECKOUT}
select id_carrito, id_pedido, id_venta, id_cliente, lineas, cast(subtotal as double) subtotal,
  cast(impuesto as double) impuesto, cast(round(subtotal + impuesto, 2) as double) total
from head
""")(_checkout("summary"))

register("checkout_orders", "O62", f"""
with {_CHECKOUT}
select id_pedido, id_cliente, cast(1 as bigint) id_estado, cast(round(subtotal + impuesto, 2) as double) total from head
""")(_checkout("orders", "total"))

register("checkout_order_lines", "O62", f"""
with {_CHECKOUT}
select id_pedido, id_detalle, id_producto, cantidad, precio_unitario from line
""")(_checkout("order_lines", "precio_unitario"))

register("checkout_shipments", "O62", f"""
with {_CHECKOUT},
labels(tipo, txt) as (values ('destino', 'Cobro a Destino'), ('tienda', 'Retiro en Tienda'), ('agencia', 'Retirar en Agencia'))
select h.id_pedido, b.direccion direccion_envio,
  l.txt || case when b.mrw and b.tipo <> 'tienda' then ' - MRW' else '' end empresa_envio,
  '' numero_guia, 'Pendiente' estado_envio, timestamp '{AS_OF}' fecha_envio, 'Zelle' metodo_pago,
  b.referencia referencia_pago, b.tipo tipo_envio
from head h join buyers b on b.id_carrito = h.id_carrito join labels l on l.tipo = b.tipo
""")(_checkout("shipments"))

register("checkout_sales", "O62", f"""
with {_CHECKOUT}
select id_venta, id_cliente, cast(round(subtotal + impuesto, 2) as double) total from head
""")(_checkout("sales", "total"))

register("checkout_sale_lines", "O62", f"""
with {_CHECKOUT}
select id_venta, id_detalle, id_producto, cantidad, precio_unitario from line
""")(_checkout("sale_lines", "precio_unitario"))

register("checkout_invoices", "O62", f"""
with {_CHECKOUT}
select id_venta, cast(subtotal as double) subtotal, cast(pct as double) porcentaje_iva, cast(impuesto as double) impuesto,
  cast(round(subtotal + impuesto, 2) as double) total_usd
from head
""")(_checkout("invoices", "subtotal", "porcentaje_iva", "impuesto", "total_usd"))

register("checkout_clients", "O62/O29", f"""
with {_CHECKOUT}
select f.id_new id_cliente, b.nombre, b.correo, b.telefono, b.direccion, b.cedula, 'auto' origen, 'nuevo' cambio
from fresh f join buyers b on b.id_carrito = f.id_carrito
union all
select c.id_cliente, c.nombre, c.correo, b.telefono, c.direccion, b.cedula, c.origen, 'actualizado'
from buyers b join clientes c on c.id_cliente = b.id_old
""")(_checkout("clients"))

register("checkout_products", "O62", f"""
with {_CHECKOUT}
select id_custom id_producto, 'Producto Personalizado - ' || id_custom nombre, 'Producto personalizado' descripcion,
  cast(30 as double) costo, cast(30 as double) precio_venta,
  (select min(id_categoria) from categorias where nombre = 'Personalizado') id_categoria, 1 activo
from custom
""")(_checkout("products", "costo", "precio_venta"))

register("checkout_rejected", "O62", f"""
with {_CHECKOUT}
select distinct id_carrito from carrito_pago where id_carrito not in (select id_carrito from ok_carts)
""")(_checkout("rejected"))

# The counter serves one cart after another: a recursive step per cart with the
# stock left of every product as a list.
_COUNTER = f"""
need as (
  select id_carrito, id_producto, max(coalesce(cantidad, 1)) n, sum(greatest(0, coalesce(cantidad, 1))) u
  from carrito_pago where id_producto is not null and id_producto <> 0 group by id_carrito, id_producto),
prods as (
  select d.id_producto, row_number() over (order by d.id_producto) pi, cast(coalesce(i.stock_actual, 0) as bigint) stock
  from (select distinct id_producto from need) d left join inventario i on i.id_producto = d.id_producto),
queue as (
  select n.id_carrito, row_number() over (order by n.id_carrito) rn, list(p.pi order by p.pi) ps,
    list(cast(n.n as bigint) order by p.pi) ns, list(cast(n.u as bigint) order by p.pi) us
  from need n join prods p on p.id_producto = n.id_producto group by n.id_carrito),
served(rn, id_carrito, quedan, ok) as (
  select cast(0 as bigint), cast(null as bigint), (select list(stock order by pi) from prods), true
  union all
  select t.rn, t.id_carrito,
    case when t.yes then list_transform(t.quedan, lambda x, p: greatest(0, x - coalesce(t.us[list_position(t.ps, p)], 0)))
         else t.quedan end, t.yes
  from (select q.*, s.quedan,
          len(list_filter(q.ps, lambda p, k: s.quedan[p] < q.ns[k])) = 0 yes
        from served s join queue q on q.rn = s.rn + 1) t),
good as (select * from carrito_pago where id_carrito not in (select id_carrito from served where not ok)),
h as (
  select id_carrito, count(*) lineas,
    cast(sum(coalesce(precio_unitario, 0) * coalesce(cantidad, 1)) as decimal(18,2)) subtotal
  from good group by id_carrito),
head as (
  select *, {_VAT} pct, round(subtotal * {_VAT} / 100, 2) impuesto,
    (select max(id_venta) from ventas) + row_number() over (order by id_carrito) id_venta
  from h)"""


def _counter(frame, *money):
    return lambda ctx: _money_cols(ch.physical_sales(ctx, ctx["carrito_pago"])[frame], *money)


register("physical_sales", "O71", f"""
with recursive {_COUNTER}
select id_carrito, id_venta, lineas, cast(subtotal as double) subtotal,
  cast(impuesto as double) impuesto, cast(round(subtotal + impuesto, 2) as double) total
from head
""")(_counter("summary"))

register("physical_sales_lines", "O71", f"""
with recursive {_COUNTER}
select h.id_venta, g.id_detalle, g.id_producto, coalesce(g.cantidad, 1) cantidad,
  cast(coalesce(g.precio_unitario, 0) as double) precio_unitario
from good g join head h on h.id_carrito = g.id_carrito
""")(_counter("sale_lines", "precio_unitario"))

register("physical_sales_invoices", "O71", f"""
with recursive {_COUNTER}
select id_venta, cast(subtotal as double) subtotal, cast(pct as double) porcentaje_iva, cast(impuesto as double) impuesto,
  cast(round(subtotal + impuesto, 2) as double) total_usd
from head
""")(_counter("invoices", "subtotal", "porcentaje_iva", "impuesto", "total_usd"))

register("physical_sales_stock", "O71", f"""
with recursive {_COUNTER},
used as (select id_producto, sum(greatest(0, coalesce(cantidad, 1))) descontado from good
         where id_producto is not null and id_producto <> 0 group by id_producto)
select i.id_producto, i.stock_actual stock_antes, cast(u.descontado as bigint) descontado,
  cast(greatest(0, i.stock_actual - u.descontado) as bigint) stock_despues
from inventario i join used u on u.id_producto = i.id_producto
""")(_counter("stock"))

register("physical_sales_rejected", "O71", f"""
with recursive {_COUNTER}
select distinct id_carrito from carrito_pago where id_carrito not in (select id_carrito from good)
""")(_counter("rejected"))

register("missing_shipments", "O64", f"""
select p.id_pedido, '' direccion_envio, 'Pendiente' empresa_envio, '' numero_guia, 'Pendiente' estado_envio,
  timestamp '{AS_OF}' fecha_envio, '' metodo_pago, '' referencia_pago, 'destino' tipo_envio
from pedidos p where not exists (select 1 from envios e where e.id_pedido = p.id_pedido)
""")(lambda ctx: ch.missing_shipments(ctx, AS_OF))

register("carrier_labels", "O65", """
select id_envio, id_pedido, tipo_envio,
  case when empresa_envio = 'Pendiente' and tipo_envio <> '' then
    case tipo_envio when 'destino' then 'Cobro a Destino' when 'tienda' then 'Retiro en Tienda'
      when 'agencia' then 'Retirar en Agencia' else 'Pendiente' end
  else empresa_envio end empresa_envio,
  (empresa_envio = 'Pendiente' and tipo_envio <> '') cambiado
from envios
""")(ch.carrier_labels)

register("consolidate_categories", "O66", """
with old as (select id_categoria from categorias where nombre not in ('PROMO', 'LARGE', 'Personalizado')),
d as (select min(id_categoria) id from categorias where nombre = 'PROMO')
select p.id_producto, p.id_categoria categoria_antes,
  case when o.id_categoria is not null and d.id is not null then d.id else p.id_categoria end id_categoria
from productos p left join old o on o.id_categoria = p.id_categoria cross join d
""")(lambda ctx: ch.consolidate_categories(ctx, KEEP_CATEGORIES, DEFAULT_CATEGORY)[0])

register("rename_status", "O67", """
with o as (select min(id_estado) id from estados_pedido where nombre = 'Enviado'),
n as (select min(id_estado) id from estados_pedido where nombre = 'Procesando')
select p.id_pedido, p.id_estado estado_antes,
  case when o.id is not null and n.id is not null and p.id_estado = o.id then n.id else p.id_estado end id_estado
from pedidos p cross join o cross join n
""")(lambda ctx: ch.rename_status(ctx, "Enviado", "Procesando")[0])

_PRODUCT_CHANGES = """
edits as (
  select p.id_producto, p.nombre, lower(coalesce(c.nombre, 'varios')) categoria,
    cast(round(p.precio_venta * 1.05, 2) as decimal(18,2)) precio, p.descripcion, coalesce(i.stock_actual, 0) + 10 stock,
    case when p.id_producto % 4 = 0 then 'nuevo_' || p.id_producto || '.png' end imagen, 1 seq
  from productos p left join categorias c on c.id_categoria = p.id_categoria
  left join inventario i on i.id_producto = p.id_producto
  union all
  select id_producto, nombre || ' II', 'varios', cast(round(precio_venta * 1.10, 2) as decimal(18,2)), descripcion, 3, null, 2
  from productos where id_producto % 5 = 0 and id_producto % 35 <> 0),
last_edit as (
  select e.* exclude (imagen), (select max(x.imagen) from edits x where x.id_producto = e.id_producto) imagen
  from edits e where e.seq = (select max(seq) from edits m where m.id_producto = e.id_producto)),
news as (
  select 'Producto ' || s_name nombre, 'Personalizado' categoria, cast(abs(s_acctbal) as decimal(18,2)) precio,
    'Producto personalizado' descripcion
  from supplier),
wanted as (select categoria nombre from edits union select categoria from news),
new_cats as (
  select cast((select coalesce(max(id_categoria), 0) from categorias) + row_number() over (order by w.nombre) as bigint)
    id_categoria, w.nombre
  from (select distinct nombre from wanted where nombre is not null and nombre <> '') w
  where not exists (select 1 from categorias c where c.nombre = w.nombre)),
all_cats as (select id_categoria, nombre from categorias union all select id_categoria, nombre from new_cats)"""

register("upsert_products", "O68", f"""
with {_PRODUCT_CHANGES}
select e.id_producto, e.nombre, coalesce(e.descripcion, '') descripcion, cast(p.costo as double) costo,
  cast(e.precio as double) precio_venta, a.id_categoria, p.activo, 'actualizado' cambio
from last_edit e join productos p on p.id_producto = e.id_producto left join all_cats a on a.nombre = e.categoria
union all
select cast((select max(id_producto) from productos) + row_number() over (order by n.nombre, n.precio) as bigint),
  n.nombre, n.descripcion, cast(n.precio as double), cast(n.precio as double), a.id_categoria, 1, 'nuevo'
from news n left join all_cats a on a.nombre = n.categoria
where n.nombre is not null and n.precio is not null
""")(lambda ctx: _money_cols(ch.upsert_products(ctx, ch.product_changes_from_data(ctx))[0],
                             "costo", "precio_venta"))

register("upsert_products_categories", "O68/O45", f"""
with {_PRODUCT_CHANGES}
select * from new_cats
""")(lambda ctx: ch.upsert_products(ctx, ch.product_changes_from_data(ctx))[1])

register("upsert_products_stock", "O68", f"""
with {_PRODUCT_CHANGES}
select id_producto, cast(stock as integer) stock_actual from last_edit
union all
select cast((select max(id_producto) from productos) + row_number() over (order by nombre, precio) as bigint), 0 from news
""")(lambda ctx: ch.upsert_products(ctx, ch.product_changes_from_data(ctx))[2])

register("upsert_products_images", "O68", f"""
with {_PRODUCT_CHANGES}
select id_producto, imagen ruta_imagen from last_edit where imagen is not null
""")(lambda ctx: ch.upsert_products(ctx, ch.product_changes_from_data(ctx))[3])

register("delete_products", "O69", """
select id_producto, nombre, cast(precio_venta as double) precio_venta, id_categoria, activo
from productos where id_producto not in (select id_producto from productos where activo = 0)
""")(lambda ctx: _money_cols(ch.delete_products(ctx, ctx["productos"].filter("activo = 0"))[0].select(
    "id_producto", "nombre", "precio_venta", "id_categoria", "activo"), "precio_venta"))

register("delete_products_stock", "O69", """
select * from inventario where id_producto not in (select id_producto from productos where activo = 0)
""")(lambda ctx: ch.delete_products(ctx, ctx["productos"].filter("activo = 0"))[2])

register("delete_products_images", "O69", """
select * from imagenes_productos where id_producto not in (select id_producto from productos where activo = 0)
""")(lambda ctx: ch.delete_products(ctx, ctx["productos"].filter("activo = 0"))[1])

register("soft_delete_clients", "O80", """
select c.id_cliente, c.nombre, c.telefono, c.correo, c.direccion, c.origen,
  case when not exists (select 1 from ventas v where v.id_cliente = c.id_cliente) then 0 else c.activo end activo
from clientes c
""")(lambda ctx: ch.soft_delete_clients(
    ctx, ctx["clientes"].join(ctx["ventas"].select("id_cliente"), "id_cliente", "left_anti")))


def _client_changes(ctx):
    c = ctx.raw("customer")
    s = ctx.raw("supplier")
    ts = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    upd = c.select(F.col("c_custkey").alias("id_cliente"), F.upper("c_name").alias("nombre"),
                   F.concat(F.lit("cliente"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("correo"),
                   F.concat(F.lit("0412-"), F.col("c_custkey").cast("string")).alias("telefono"),
                   F.col("c_mktsegment").alias("direccion"), ts.alias("ts"))
    ins = s.select(F.lit(None).cast("long").alias("id_cliente"), F.col("s_name").alias("nombre"),
                   F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@proveedor.com")).alias("correo"),
                   F.lit(None).cast("string").alias("telefono"), F.lit(None).cast("string").alias("direccion"),
                   ts.alias("ts"))
    return upd.unionByName(ins)


register("upsert_clients", "O81", """
select c.id_cliente, upper(cu.c_name) nombre, 'cliente' || cast(cu.c_custkey as varchar) || '@example.com' correo,
  '0412-' || cast(cu.c_custkey as varchar) telefono, cu.c_mktsegment direccion, c.activo, c.origen,
  'actualizado' cambio
from clientes c join customer cu on cu.c_custkey = c.id_cliente where c.activo = 1
union all
select cast((select max(id_cliente) from clientes) + row_number() over (order by 's' || cast(s_suppkey as varchar) || '@proveedor.com') as bigint),
  s_name, 's' || cast(s_suppkey as varchar) || '@proveedor.com', '', '', 1, 'manual', 'nuevo'
from supplier
""")(lambda ctx: ch.upsert_clients(ctx, _client_changes(ctx)))

register("upsert_config", "O77", """
with chg as (
  select fecha ts,
    case when month(fecha) = 1 then cast(12 + year(fecha) % 5 as decimal(5,2)) end iva,
    case when (month(fecha) + year(fecha) * 12) % 5 = 0 then cast(0 as decimal(12,4)) else tasa end usd,
    cast(case when (month(fecha) + year(fecha) * 12) % 3 = 0 then null else round(tasa * 1.1, 4) end as decimal(12,4)) eur
  from tasas_cambio),
r as (select arg_max(usd, ts) usd, arg_max(coalesce(eur, 0), ts) eur from chg where usd > 0),
v as (select arg_max(iva, ts) iva from chg where iva is not null)
select cast(coalesce((select iva from v), (select max(iva_default) from configuracion), 16) as double) iva_default,
  cast(coalesce((select usd from r), (select max(tasa_usd) from configuracion)) as double) tasa_usd,
  cast(coalesce((select eur from r), (select max(tasa_eur) from configuracion)) as double) tasa_eur
""")(lambda ctx: ch.upsert_config(ctx["configuracion"], ch.config_changes_from_rates(ctx)))

register("adjust_cart_quantities", "O78", """
with d as (
  select id_carrito, id_producto, sum(case when id_detalle % 2 = 0 then cantidad else -cantidad end) delta
  from carrito_invitado group by id_carrito, id_producto)
select s.id_detalle, s.id_carrito, s.id_producto,
  cast(case when d.delta is null then s.cantidad else greatest(1, coalesce(s.cantidad, 1) + d.delta) end as integer) cantidad,
  cast(s.precio_unitario as double) precio_unitario, s.fecha
from detalle_carrito s left join d on d.id_carrito = s.id_carrito and d.id_producto = s.id_producto
where not exists (select 1 from carrito_quitar q where q.id_carrito = s.id_carrito and q.id_producto = s.id_producto)
""")(lambda ctx: _money_cols(ch.adjust_cart_quantities(
    ctx["detalle_carrito"],
    ctx["carrito_invitado"].select("id_carrito", "id_producto", F.when(
        F.pmod("id_detalle", F.lit(2)) == 0, F.col("cantidad")).otherwise(-F.col("cantidad")).alias("delta")),
    ctx["carrito_quitar"]).select("id_detalle", "id_carrito", "id_producto", "cantidad", "precio_unitario", "fecha"),
    "precio_unitario"))
