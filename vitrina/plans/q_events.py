"""Registered event operators (O70, O72-O76), batch twins of the streams.

O73 and O76 are ordered folds; their SQL statements are recursive CTEs, and
``tests/test_events.py`` also checks them against a sequential brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.streaming import carts, ledger, limits, rates
from vitrina.plans.registry import register

RATE_LIMIT, RATE_WINDOW = 8, "1 day"

_LEDGER = """
mov as (
  select id_producto, fecha, 'salida' tipo, cantidad, 'Venta realizada' descripcion, id_venta ref,
    cast(id_detalle as bigint) linea, -cantidad signed
  from detalle_ventas
  union all
  select id_producto, fecha, 'entrada', cantidad, 'Compra realizada', id_proveedor, 0, cantidad
  from detalle_compras),
led as (
  select m.id_producto, m.fecha, m.tipo, m.cantidad, m.descripcion, m.ref, m.linea,
    cast(i.stock_actual + sum(coalesce(m.signed, 0)) over (partition by m.id_producto
      order by m.fecha, m.tipo, m.ref, m.linea, m.cantidad
      rows between unbounded preceding and current row) as bigint) stock_despues
  from mov m left join inventario i on i.id_producto = m.id_producto)"""


def _ledger(ctx):
    return ledger.stock_ledger(ctx["detalle_ventas"], ctx["detalle_compras"], ctx["inventario"])


register("stock_ledger", "O70", f"with {_LEDGER} select * from led")(_ledger)

register("low_stock_alerts", "O74", f"""
with {_LEDGER}
select l.id_producto, l.fecha, l.tipo, l.ref, l.linea, l.stock_despues, i.stock_minimo,
  'Stock bajo del mínimo permitido' mensaje
from led l join inventario i on i.id_producto = l.id_producto
where l.stock_despues <= i.stock_minimo
""")(lambda ctx: ledger.low_stock_alerts(_ledger(ctx), ctx["inventario"]))

register("invoice_local_total", "O72", """
select x.id_venta, x.fecha, cast(x.usd as double) total_usd, cast(r.tasa as double) tasa,
  cast(round(x.usd * r.tasa, 2) as double) total_bs
from (select f.id_venta, v.fecha, f.subtotal + f.impuesto usd
      from facturas f join ventas v on v.id_venta = f.id_venta) x
asof left join (select * from tasas_cambio where activa = 1) r on x.fecha >= r.fecha
""")(rates.invoice_local_total)

register("rate_limit_flags", "O75", f"""
select user_id, date_trunc('day', ts) ventana_inicio, date_trunc('day', ts) + interval 1 day ventana_fin,
  count(*) solicitudes, {RATE_LIMIT} limite
from events group by user_id, date_trunc('day', ts)
having count(*) > {RATE_LIMIT}
""")(lambda ctx: limits.rate_limit_flags(ctx.raw("events"), RATE_LIMIT, RATE_WINDOW))

# The folds stated as recursive SQL: one step per line of a product / per
# cart of a client (depth = lines per product, carts per client).
register("oversell_guard", "O73", """
with recursive l as (
  select id_venta, id_detalle, id_producto, fecha, cast(cantidad as bigint) cantidad,
    row_number() over (partition by id_producto order by fecha, id_venta, id_detalle, cantidad) rn
  from detalle_ventas),
st(id_producto, rn, quedan, ok) as (
  select l.id_producto, l.rn,
    case when i.stock_actual is null or l.cantidad is null then i.stock_actual
         when i.stock_actual >= l.cantidad then i.stock_actual - l.cantidad else i.stock_actual end,
    (i.stock_actual is null or l.cantidad is null or i.stock_actual >= l.cantidad)
  from l left join inventario i on i.id_producto = l.id_producto where l.rn = 1
  union all
  select l.id_producto, l.rn,
    case when st.quedan is null or l.cantidad is null then st.quedan
         when st.quedan >= l.cantidad then st.quedan - l.cantidad else st.quedan end,
    (st.quedan is null or l.cantidad is null or st.quedan >= l.cantidad)
  from st join l on l.id_producto = st.id_producto and l.rn = st.rn + 1)
select l.id_venta, l.id_detalle, l.id_producto, l.fecha, l.cantidad, st.ok aceptada
from l join st on st.id_producto = l.id_producto and st.rn = l.rn
""")(lambda ctx: ledger.oversell_guard(ctx["detalle_ventas"], ctx["inventario"]))

register("active_carts", "O76", """
with recursive ev as (select id_detalle, id_carrito, fecha from cart_events),
starts(id_carrito, s, n) as (
  select id_carrito, min(fecha), 1 from ev group by id_carrito
  union all
  select st.id_carrito, (select min(e.fecha) from ev e where e.id_carrito = st.id_carrito
                         and e.fecha > st.s + interval 24 hour), st.n + 1
  from starts st
  where exists (select 1 from ev e where e.id_carrito = st.id_carrito and e.fecha > st.s + interval 24 hour))
select c.*, cast(st.n as bigint) carrito_n, st.s creacion_carrito
from cart_events c asof join starts st on c.id_carrito = st.id_carrito and c.fecha >= st.s
""")(lambda ctx: carts.active_carts(ctx["cart_events"]))

# Requests: the events 240 times as fast, from two addresses; clicks are logins
# and signups are registrations.
_REQUESTS = """
req as (
  select case when user_id % 3 = 0 then 'a' else 'b' end direccion, make_timestamp(epoch_us(ts) // 240) ts,
    case event_type when 'click' then 'login' when 'signup' then 'register' else 'shop' end ruta
  from events)"""
_LIMITS_SQL = "\nunion all\n".join(
    f"""select direccion, date_trunc('{unit}', ts) ventana_inicio, date_trunc('{unit}', ts) + interval 1 {unit} ventana_fin,
  count(*) solicitudes, {n} limite, '1 {unit}' ventana, '{route or "todas"}' ruta
from req {f"where ruta = '{route}'" if route else ""} group by direccion, date_trunc('{unit}', ts) having count(*) > {n}"""
    for n, unit, route in [(200, "day", None), (50, "hour", None), (10, "minute", "login"), (5, "minute", "register")])


def _requests(ctx):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    route = F.when(F.col("event_type") == "click", "login").when(F.col("event_type") == "signup", "register").otherwise("shop")
    return ctx.raw("events").select(
        F.when(F.pmod("user_id", F.lit(3)) == 0, "a").otherwise("b").alias("direccion"),
        F.timestamp_micros(F.floor(micros / 240)).cast("timestamp_ntz").alias("ts"), route.alias("ruta"))


register("shop_limit_flags", "O75", f"with {_REQUESTS}\n{_LIMITS_SQL}")(
    lambda ctx: limits.shop_limit_flags(_requests(ctx), key="direccion"))
