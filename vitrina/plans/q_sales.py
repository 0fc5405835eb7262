"""Registered dashboard / sales / report / money queries."""

from __future__ import annotations

from vitrina.functions import periods
from vitrina.operators import sales
from vitrina.plans.registry import register

# Fixed query parameters (same on both sides).
REPORT_FROM, REPORT_TO = "1997-01-01", "1997-12-31"

register("top_products", "O30", """
select d.id_producto, p.nombre producto, cast(sum(d.cantidad) as bigint) cantidad,
  cast(coalesce(sum(d.cantidad * d.precio_unitario), 0) as double) total
from detalle_ventas d join productos p on p.id_producto = d.id_producto
group by d.id_producto, p.nombre
order by cantidad desc nulls last, d.id_producto limit 5
""")(lambda ctx: sales.top_products(ctx, 5))

register("stock_by_category", "O31", """
select c.id_categoria, c.nombre categoria, cast(coalesce(sum(i.stock_actual), 0) as bigint) stock
from categorias c left join productos p on p.id_categoria = c.id_categoria
left join inventario i on i.id_producto = p.id_producto
group by c.id_categoria, c.nombre
order by stock desc, c.id_categoria limit 5
""")(lambda ctx: sales.stock_by_category(ctx, 5))

register("sales_by_month", "O32", """
select strftime(fecha, '%m') mes, cast(coalesce(sum(total), 0) as double) total
from ventas group by mes order by mes nulls first
""")(sales.sales_by_month)

_SALES_LINES = """
select v.id_venta id, coalesce(c.nombre, 'Cliente desconocido') cliente, v.fecha,
  count(d.id_detalle) items, cast(coalesce(v.total, 0) as double) total
from ventas v left join clientes c on v.id_cliente = c.id_cliente
left join detalle_ventas d on d.id_venta = v.id_venta
{where}
group by v.id_venta, c.nombre, v.fecha, v.total
order by v.fecha desc nulls last, v.id_venta {limit}
"""
_RANGE = (f"where v.fecha >= timestamp '{REPORT_FROM}' "
          f"and v.fecha <= timestamp '{REPORT_TO} 23:59:59'")

register("sales_list", "O33", _SALES_LINES.format(where="", limit="limit 20"))(
    lambda ctx: sales.sales_list(ctx, 20))

register("sales_report", "O34", _SALES_LINES.format(where=_RANGE, limit=""))(
    lambda ctx: sales.sales_report(ctx, REPORT_FROM, REPORT_TO))

register("sales_report_all", "O34", _SALES_LINES.format(where="", limit=""))(
    lambda ctx: sales.sales_report(ctx))

register("report_totals", "O35", f"""
select count(*) facturas, cast(coalesce(sum(total), 0) as double) gran_total
from ventas v {_RANGE}
""")(lambda ctx: sales.report_totals(ctx, REPORT_FROM, REPORT_TO))

register("dashboard_kpis", "O36", """
select (select count(*) from ventas) total_ventas,
  (select count(*) from clientes where activo = 1) clientes_activos,
  (select count(*) from productos where activo = 1) productos_activos,
  (select cast(coalesce(sum(stock_actual), 0) as bigint) from inventario) stock_total,
  (select cast(coalesce(sum(total), 0) as double) from ventas) ingresos_totales
""")(sales.dashboard_kpis)

register("cart_totals", "O37", """
select id_carrito, cast(sum(coalesce(precio_unitario, 0) * coalesce(cantidad, 1)) as double) total,
  count(*) lineas, cast(sum(coalesce(cantidad, 1)) as bigint) unidades
from detalle_carrito group by id_carrito
""")(sales.cart_totals)

register("invoice_totals", "O39/O52", """
select v.id_venta id, printf('INV-%03d', v.id_venta) numero, c.nombre cliente, v.fecha,
  cast(coalesce(v.total, 0) as double) total,
  cast(case when f.id_venta is not null then f.subtotal else v.total end as double) subtotal,
  cast(case when f.id_venta is not null then f.porcentaje_iva else 0 end as double) iva_pct,
  cast(case when f.id_venta is not null then f.impuesto else 0 end as double) iva_monto
from ventas v left join facturas f on f.id_venta = v.id_venta
left join clientes c on c.id_cliente = v.id_cliente
""")(sales.invoice_totals)

_RECEIPT = """
with sub as (
  select id_pedido, sum(coalesce(precio_unitario, 0)
    * case when cantidad is null or cantidad = 0 then 1 else cantidad end) subtotal
  from detalle_pedidos group by id_pedido),
ship as (
  select id_pedido, tipo_envio from (
    select id_pedido, tipo_envio, row_number() over (partition by id_pedido order by id_envio desc) rn
    from envios) t where rn = 1),
vat as (
  select coalesce(case when max(iva_default) > 0 then max(iva_default) end, 16) iva from configuracion),
r as (
  select p.id_pedido, coalesce(s.subtotal, 0) subtotal, vat.iva iva_pct,
    case when sh.tipo_envio = 'destino' then 5.00 else 0 end envio,
    round(coalesce(s.subtotal, 0) * vat.iva / 100, 2) iva_monto
  from pedidos p left join sub s on s.id_pedido = p.id_pedido
  left join ship sh on sh.id_pedido = p.id_pedido cross join vat)
"""

register("receipt_totals", "O40", _RECEIPT + """
select id_pedido, cast(subtotal as double) subtotal, cast(iva_pct as double) iva_pct,
  cast(iva_monto as double) iva_monto, cast(envio as double) envio,
  cast(round(subtotal + iva_monto + envio, 2) as double) total
from r
""")(sales.receipt_totals)

register("receipt_vs_order", "O41", _RECEIPT + """
select p.id_pedido, cast(p.total as double) guardado,
  cast(round(r.subtotal + r.iva_monto, 2) as double) recalculado,
  cast(p.total - round(r.subtotal + r.iva_monto, 2) as double) diferencia
from pedidos p join r on r.id_pedido = p.id_pedido
where abs(p.total - round(r.subtotal + r.iva_monto, 2)) >= 0.01
""")(sales.receipt_vs_order)

register("receipt_vs_order_mixed", "O41", _RECEIPT + """
, p as (
  select o.id_pedido, cast(case when o.id_pedido % 3 = 1 then o.total
    else round(r.subtotal + r.iva_monto, 2) + case when o.id_pedido % 6 = 0 then 0.01 else 0 end end as decimal(18,2)) total
  from pedidos o left join r on r.id_pedido = o.id_pedido)
select p.id_pedido, cast(p.total as double) guardado,
  cast(round(r.subtotal + r.iva_monto, 2) as double) recalculado,
  cast(p.total - cast(round(r.subtotal + r.iva_monto, 2) as decimal(18,2)) as double) diferencia
from p join r on r.id_pedido = p.id_pedido
where abs(p.total - cast(round(r.subtotal + r.iva_monto, 2) as decimal(18,2))) >= 0.01
""")(lambda ctx: sales.receipt_vs_order(ctx, orders=sales.orders_with_receipt_totals(ctx)))

register("profit_series", "O42", """
select mes, cast(ingresos as double) ingresos, cast(round(ingresos * 0.4, 2) as double) gastos
from (select strftime(fecha, '%m') mes, coalesce(sum(total), 0) ingresos from ventas group by mes) t
order by mes nulls first
""")(sales.profit_series)

register("prices_in_currency", "O46/O51", """
with rate as (
  select coalesce(max(case when tasa_usd > 0 then tasa_usd end), 40) tasa,
    case when max(case when tasa_usd > 0 then tasa_usd end) is not null then 'manual' else 'bcv' end fuente
  from configuracion)
select p.id_producto, p.nombre, cast(p.precio_venta as double) precio_usd,
  cast(round(p.precio_venta * rate.tasa, 2) as double) precio_bs, cast(rate.tasa as double) tasa, rate.fuente,
  '$' || format('{:,.2f}', round(p.precio_venta, 2)) || ' / '
    || translate(format('{:,.2f}', round(p.precio_venta * rate.tasa, 2)), ',.', '.,') || ' Bs' precio_texto,
  'Bs ' || cast(cast(round(p.precio_venta * rate.tasa, 2) as decimal(18,2)) as varchar) || ' ('
    || cast(p.precio_venta as varchar) || '$)' precio_admin
from productos p cross join rate
""")(sales.prices_in_currency)

_PERIOD_SQL = {
    "daily": ("cast(fecha as date)", "desde"),
    "weekly": ("cast(fecha as date) - cast(dayofweek(fecha) as integer)", "desde + 6"),
    "monthly": ("cast(date_trunc('month', fecha) as date)", "last_day(desde)"),
    "annual": ("cast(date_trunc('year', fecha) as date)", "make_date(year(desde), 12, 31)"),
}
for _p, (_start, _end) in _PERIOD_SQL.items():
    register(f"sales_by_period_{_p}", "O47/O48", f"""
select '{_p}' tipo, desde, cast({_end} as date) hasta, facturas, cast(total as double) total
from (select {_start} desde, count(*) facturas, coalesce(sum(total), 0) total
      from ventas group by desde) t
order by desde nulls first
""")(lambda ctx, _p=_p: sales.sales_by_period(ctx, _p))

register("vat_rate", "O49", """
select cast(coalesce(case when max(iva_default) > 0 then max(iva_default) end, 16) as double) iva
from configuracion
""")(sales.vat_rate_table)

register("report_period", "O47", """
with days as (select distinct cast(fecha as date) as_of from ventas)
select as_of, 'daily' periodo, as_of desde, as_of hasta from days
union all select as_of, 'weekly', as_of - cast(dayofweek(as_of) as integer), as_of from days
union all select as_of, 'monthly', cast(date_trunc('month', as_of) as date), as_of from days
union all select as_of, 'annual', cast(date_trunc('year', as_of) as date), as_of from days
union all select as_of, 'custom', as_of - 10, as_of + 3 from days
""")(periods.report_periods_of_sales)
