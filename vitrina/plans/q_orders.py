"""Registered order / cart / people queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.operators import orders
from vitrina.plans.registry import register

_SHIP = """(select * from (select e.*, row_number() over (partition by id_pedido order by id_envio desc) rn
   from envios e) t where rn = 1)"""

register("order_history", "O21", f"""
select p.id_cliente, p.id_pedido id, p.fecha, cast(coalesce(p.total, 0) as double) total,
  coalesce(e.nombre, 'Pendiente') estado, coalesce(s.empresa_envio, '') empresa_envio,
  coalesce(s.numero_guia, '') numero_guia,
  case when coalesce(s.empresa_envio, '') not in ('', 'Pendiente') then s.empresa_envio else 'Sin asignar' end envio_texto,
  case when coalesce(s.numero_guia, '') <> '' then s.numero_guia else 'Pendiente' end guia_texto
from pedidos p left join estados_pedido e on e.id_estado = p.id_estado
left join {_SHIP} s on s.id_pedido = p.id_pedido
order by p.id_cliente nulls first, p.fecha desc nulls last, p.id_pedido
""")(orders.order_history)

register("admin_orders", "O22", f"""
with newest as (select * from pedidos order by fecha desc nulls last, id_pedido limit 50),
rate as (select coalesce(max(case when tasa_usd > 0 then tasa_usd end), 40) tasa from configuracion)
select n.id_pedido id, c.nombre cliente, c.telefono, c.correo, e.nombre estado, cast(coalesce(n.total, 0) as double) total,
  n.fecha, s.direccion_envio, s.metodo_pago, s.referencia_pago, s.empresa_envio, s.numero_guia,
  case e.nombre when 'Pendiente de Verificación' then 'verificar' when 'Procesando' then 'enviar'
    when 'Enviado' then 'entregar' else 'ninguna' end accion,
  cast(round(coalesce(n.total, 0) * rate.tasa, 2) as double) total_bs
from newest n left join clientes c on c.id_cliente = n.id_cliente
left join estados_pedido e on e.id_estado = n.id_estado
left join {_SHIP} s on s.id_pedido = n.id_pedido cross join rate
order by n.fecha desc nulls last, n.id_pedido
""")(lambda ctx: orders.admin_orders(ctx, 50))

register("orders_one_shipment", "O23", f"""
select id_envio, id_pedido, tipo_envio, empresa_envio, numero_guia, direccion_envio, metodo_pago,
  referencia_pago from {_SHIP} s
""")(orders.orders_one_shipment)

register("order_items", "O24", """
select d.id_pedido, d.id_detalle id, d.id_producto product_id, coalesce(p.nombre, 'Producto personalizado') name,
  d.cantidad quantity, cast(coalesce(d.precio_unitario, 0) as double) price,
  cast(coalesce(d.precio_unitario, 0) * case when d.cantidad is null or d.cantidad = 0 then 1
       else d.cantidad end as double) total
from detalle_pedidos d left join productos p on p.id_producto = d.id_producto
""")(orders.order_items)

register("cart_items", "O25", """
select d.id_carrito, d.id_detalle, d.id_producto, coalesce(p.nombre, 'Producto personalizado') name,
  coalesce(p.descripcion, '') details, cast(coalesce(d.precio_unitario, 0) as double) price,
  coalesce(d.cantidad, 1) quantity, coalesce(fi.ruta_imagen, 'placeholder.png') image_url
from detalle_carrito d left join productos p on p.id_producto = d.id_producto
left join (select id_producto, arg_min(ruta_imagen, id_imagen) ruta_imagen
           from imagenes_productos group by id_producto) fi on fi.id_producto = d.id_producto
""")(orders.cart_items)

register("order_detail", "O26", f"""
with items as (
  select id_pedido, count(*) n_items,
    sum(coalesce(precio_unitario, 0) * case when cantidad is null or cantidad = 0 then 1 else cantidad end) t
  from detalle_pedidos group by id_pedido)
select p.id_pedido id, p.id_cliente, p.fecha, cast(coalesce(p.total, 0) as double) total,
  coalesce(e.nombre, 'Pendiente') estado, coalesce(c.nombre, '') cliente, coalesce(c.correo, '') cliente_correo,
  coalesce(s.direccion_envio, '') direccion, coalesce(s.metodo_pago, '') payment_method,
  coalesce(s.referencia_pago, '') reference, coalesce(i.n_items, 0) n_items,
  cast(coalesce(i.t, 0) as double) items_total
from pedidos p left join estados_pedido e on e.id_estado = p.id_estado
left join clientes c on c.id_cliente = p.id_cliente
left join {_SHIP} s on s.id_pedido = p.id_pedido
left join items i on i.id_pedido = p.id_pedido
""")(lambda ctx: orders.order_detail(ctx, with_items=False))

register("client_of_user", "O27", """
select u.id_usuario, u.correo, c.id_cliente from usuarios u left join clientes c on c.correo = u.correo
""")(orders.client_of_user)

register("users_with_role", "O28", """
select u.id_usuario, u.nombre, u.correo, u.id_rol, coalesce(r.nombre, 'Trabajador') rol
from usuarios u left join roles r on r.id_rol = u.id_rol
""")(orders.users_with_role)

register("match_or_create_clients", "O29", """
with inc as (
  select id_cliente key,
    case when id_cliente % 5 = 0 then nombre || ' (nuevo)' else nombre end nombre,
    case when id_cliente % 4 = 0 then '' else correo end correo, direccion
  from clientes),
by_mail as (select correo, min(id_cliente) id_mail from clientes
            where correo is not null and correo <> '' group by correo),
by_name as (select nombre, direccion, min(id_cliente) id_name from clientes group by nombre, direccion),
m as (
  select i.key, i.nombre, i.direccion, nullif(i.correo, '') mail, bm.id_mail, bn.id_name
  from inc i left join by_mail bm on bm.correo = nullif(i.correo, '')
  left join by_name bn on bn.nombre = i.nombre and bn.direccion = i.direccion),
fresh as (
  select key, case when mail is not null then 'm:' || mail
    else 'n:' || coalesce(nombre, '') || '|' || coalesce(direccion, '') end ident
  from m where id_mail is null and id_name is null),
idents as (select ident, min(key) first_key from fresh group by ident),
new_ids as (
  select ident, (select max(id_cliente) from clientes) + row_number() over (order by first_key) id_nuevo
  from idents)
select key, coalesce(id_mail, id_name) id_cliente,
  case when id_mail is not null then 'correo' else 'nombre_direccion' end tier
from m where id_mail is not null or id_name is not null
union all
select f.key, n.id_nuevo,
  case when f.key = i.first_key then 'nuevo' when f.ident like 'm:%' then 'correo' else 'nombre_direccion' end
from fresh f join new_ids n on n.ident = f.ident join idents i on i.ident = f.ident
""")(lambda ctx: orders.match_or_create_clients(orders.incoming_from_customers(ctx), ctx["clientes"]))



def _client_writes(ctx):
    incoming = orders.incoming_from_customers(ctx)
    return orders.client_writes(incoming, orders.match_or_create_clients(incoming, ctx["clientes"]), ctx["clientes"])


# every customer comes once, so a new client is never found again by e-mail
register("client_writes", "O29", """
with inc as (
  select id_cliente key,
    case when id_cliente % 5 = 0 then nombre || ' (nuevo)' else nombre end nombre,
    case when id_cliente % 4 = 0 then '' else correo end correo, direccion
  from clientes),
by_mail as (select correo, min(id_cliente) id_mail from clientes
            where correo is not null and correo <> '' group by correo),
by_name as (select nombre, direccion, min(id_cliente) id_name from clientes group by nombre, direccion),
m as (
  select i.key, i.nombre, i.direccion, nullif(i.correo, '') mail, bm.id_mail, bn.id_name
  from inc i left join by_mail bm on bm.correo = nullif(i.correo, '')
  left join by_name bn on bn.nombre = i.nombre and bn.direccion = i.direccion),
fresh as (
  select key, case when mail is not null then 'm:' || mail
    else 'n:' || coalesce(nombre, '') || '|' || coalesce(direccion, '') end ident
  from m where id_mail is null and id_name is null),
idents as (select ident, min(key) first_key from fresh group by ident),
new_ids as (
  select ident, (select max(id_cliente) from clientes) + row_number() over (order by first_key) id_nuevo
  from idents)
select n.id_nuevo id_cliente, m.nombre, coalesce(m.mail, '') correo, '0414-' || m.key telefono, m.direccion, 'V-' || m.key cedula,
  'auto' origen, 'nuevo' cambio
from fresh f join idents i on i.ident = f.ident and i.first_key = f.key join new_ids n on n.ident = f.ident
join m on m.key = f.key
union all
select c.id_cliente, c.nombre, c.correo, '0414-' || m.key, c.direccion, 'V-' || m.key, c.origen, 'actualizado'
from m join clientes c on c.id_cliente = m.id_mail
""")(_client_writes)

from vitrina.operators import accounts  # noqa: E402

register("linked_accounts", "O38", """
with per as (select id_usuario, proveedor, count(*) n, arg_max(proveedor_correo, id_cuenta) proveedor_correo
             from cuentas_vinculadas group by id_usuario, proveedor),
tot as (select id_usuario, count(*) t from cuentas_vinculadas group by id_usuario)
select p.id_usuario, p.proveedor, p.proveedor_correo, cast(t.t - p.n as bigint) otros,
  (coalesce(u.has_password, false) or t.t - p.n > 0) removible
from per p join tot t on t.id_usuario = p.id_usuario left join usuarios u on u.id_usuario = p.id_usuario
""")(lambda ctx: accounts.link_removal_rules(ctx["cuentas_vinculadas"], ctx["usuarios"]))

register("linked_accounts_by_provider", "O38", """
with per as (select id_usuario, proveedor, arg_max(proveedor_correo, id_cuenta) c
             from cuentas_vinculadas group by id_usuario, proveedor)
select id_usuario, max(case when proveedor = 'google' then c end) google,
  max(case when proveedor = 'facebook' then c end) facebook
from per group by id_usuario
""")(lambda ctx: accounts.linked_accounts_map(ctx["cuentas_vinculadas"]).select(
    "id_usuario", F.try_element_at("cuentas", F.lit("google")).alias("google"),
    F.try_element_at("cuentas", F.lit("facebook")).alias("facebook")))

# Sign-ins of all three tiers; users with an id divisible by 11 have been deleted.
_SIGNIN = """
inc as (
  select case when event_id % 2 = 0 then 'google' else 'facebook' end prov, ts, 'user' || user_id nombre,
    json_extract_string(props, '$.k') || case when event_id % 3 = 0 then '_u' || user_id else '' end k,
    case when event_id % 7 = 0 then null when event_id % 5 = 0 then 'nuevo' || user_id || '@mail.com'
         else 'c' || user_id || '@example.com' end correo
  from events where event_type = 'purchase'),
firsts as (
  select * from (select *, prov || '_' || k pid, row_number() over (
    partition by prov, k order by ts, correo nulls first, nombre) n from inc) t where n = 1),
alive as (select * from usuarios where id_usuario % 11 <> 0),
tiers as (
  select f.*, coalesce('m:' || f.correo, 'p:' || f.prov || '|' || f.pid) node, l.id_usuario u_link, m.id_usuario u_mail
  from firsts f
  left join (select x.* from cuentas_vinculadas x join alive a on a.id_usuario = x.id_usuario) l
    on l.proveedor = f.prov and l.proveedor_id = f.pid
  left join alive m on m.correo = f.correo),
born as (
  select *, (select max(id_usuario) from alive) + row_number() over (order by ts, node) u_new
  from (select node, ts, correo, nombre, row_number() over (partition by node order by ts, prov, pid) n
        from tiers where u_link is null and u_mail is null) t where n = 1),
answer as (
  select t.prov, t.pid, t.correo, coalesce(t.u_link, t.u_mail, b.u_new) u,
    case when t.u_link is not null then 'vinculo' when t.u_mail is not null then 'correo' else 'nuevo' end via
  from tiers t left join born b on b.node = t.node and t.u_link is null and t.u_mail is null)"""


def _signins(frame):
    return lambda ctx: accounts.linked_account_writes(
        accounts.signins_from_events(ctx.raw("events")), ctx["cuentas_vinculadas"],
        ctx["usuarios"].filter(F.pmod("id_usuario", F.lit(11)) != 0))[frame]


register("resolve_linked_accounts", "O79", f"""
with {_SIGNIN}
select prov proveedor, pid proveedor_id, u id_usuario, via from answer
""")(_signins("resolved"))

register("linked_accounts_new_users", "O79", f"""
with {_SIGNIN}
select u_new id_usuario, nombre, correo, cast(2 as bigint) id_rol from born
""")(_signins("new_users"))

register("linked_accounts_new_links", "O79", f"""
with {_SIGNIN}
select u id_usuario, prov proveedor, pid proveedor_id, coalesce(correo, '') proveedor_correo,
  (select max(id_cuenta) from cuentas_vinculadas) + row_number() over (order by prov, pid) id_cuenta
from answer where via <> 'vinculo'
""")(_signins("new_links"))

register("linked_accounts_stale_links", "O79", f"""
with {_SIGNIN}
select l.* from cuentas_vinculadas l left join alive a on a.id_usuario = l.id_usuario where a.id_usuario is null
""")(_signins("stale_links"))

register("unlink_accounts", "O79", """
with counted as (
  select id_usuario, proveedor, count(*) n, sum(count(*)) over (partition by id_usuario) t
  from cuentas_vinculadas group by id_usuario, proveedor)
select l.* from cuentas_vinculadas l
join counted c on c.id_usuario = l.id_usuario and c.proveedor = l.proveedor
left join usuarios u on u.id_usuario = l.id_usuario
where l.proveedor = 'google' and (coalesce(u.has_password, false) or c.t > c.n)
""")(lambda ctx: accounts.unlink_accounts(
    ctx["cuentas_vinculadas"].filter("proveedor = 'google'"), ctx["cuentas_vinculadas"], ctx["usuarios"]))
