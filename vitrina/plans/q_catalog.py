"""Registered catalogue / listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.operators import catalog
from vitrina.plans.registry import register

# Fixed query parameters.
SEARCH = dict(category="PROMO", q="WIDGET", sort="price_asc", limit=50)
DISPLAY_ORDER = ["PROMO", "LARGE", "SMALL", "MEDIUM", "ECONOMY", "STANDARD", "Personalizado"]
REQUIRED_CATEGORIES = ["camisas", "tazas", "gorras", "llaveros", "Termos", "Mousepads", "Boligrafos",
                       "Personalizado"]

_FIRST_IMAGE = """(select id_producto, arg_min(ruta_imagen, id_imagen) ruta_imagen
   from imagenes_productos group by id_producto)"""

_CATALOG = f"""
select p.id_producto, p.nombre, p.descripcion, cast(p.precio_venta as double) precio_venta,
  c.nombre categoria, coalesce(fi.ruta_imagen, 'placeholder.png') ruta_imagen
from productos p left join categorias c on p.id_categoria = c.id_categoria
left join {_FIRST_IMAGE} fi on fi.id_producto = p.id_producto
where p.activo = 1 and p.id_categoria is not null {{extra}}
order by {{order}} {{limit}}
"""

register("catalog_search", "O10", _CATALOG.format(
    extra="and c.nombre = 'PROMO' and (p.nombre ilike '%WIDGET%' or p.descripcion ilike '%WIDGET%')",
    order="p.precio_venta asc nulls first, p.id_producto", limit="limit 50"))(
    lambda ctx: catalog.catalog_search(ctx, **SEARCH))

register("catalog_search_default", "O10", _CATALOG.format(extra="", order="p.id_producto desc", limit=""))(
    lambda ctx: catalog.catalog_search(ctx))

register("catalog_search_name", "O10", _CATALOG.format(
    extra="and (p.nombre ilike '%red%' or p.descripcion ilike '%red%')",
    order="p.nombre asc nulls first, p.id_producto", limit=""))(
    lambda ctx: catalog.catalog_search(ctx, q="red", sort="name_asc"))

register("product_cards", "O11", f"""
select p.id_producto id, p.nombre name, coalesce(nullif(c.nombre, ''), 'General') category,
  cast(p.precio_venta as double) price, coalesce(nullif(fi.ruta_imagen, ''), 'placeholder.png') image_url,
  coalesce(p.descripcion, '') description, coalesce(i.stock_actual, 0) stock
from productos p left join categorias c on p.id_categoria = c.id_categoria
left join {_FIRST_IMAGE} fi on fi.id_producto = p.id_producto
left join inventario i on i.id_producto = p.id_producto
where p.activo = 1 and p.id_categoria is not null
""")(lambda ctx: catalog.product_cards(catalog.catalog_search(ctx), ctx["inventario"]))

register("product_detail", "O12", f"""
select p.id_producto, p.nombre, p.descripcion, cast(p.precio_venta as double) precio_venta, c.nombre categoria,
  coalesce(fi.ruta_imagen, 'placeholder.png') ruta_imagen, coalesce(i.stock_actual, 0) stock
from productos p left join categorias c on p.id_categoria = c.id_categoria
left join {_FIRST_IMAGE} fi on fi.id_producto = p.id_producto
left join inventario i on i.id_producto = p.id_producto
where p.activo = 1
""")(catalog.product_detail)

register("product_admin_detail", "O13", f"""
select p.id_producto, p.nombre, p.descripcion, cast(p.precio_venta as double) precio, c.nombre categoria,
  coalesce(i.stock_actual, 0) stock, coalesce(fi.ruta_imagen, '') imagen
from productos p left join categorias c on p.id_categoria = c.id_categoria
left join {_FIRST_IMAGE} fi on fi.id_producto = p.id_producto
left join inventario i on i.id_producto = p.id_producto
""")(catalog.product_admin_detail)

_INVENTORY = """
select p.id_producto, p.nombre, cast(p.precio_venta as double) precio, coalesce(i.stock_actual, 0) stock,
  coalesce(c.nombre, 'Sin categoría') categoria
from productos p left join categorias c on p.id_categoria = c.id_categoria
left join inventario i on i.id_producto = p.id_producto
where p.activo = 1
"""

register("inventory_list", "O14", _INVENTORY + " order by p.nombre nulls first, p.id_producto")(
    catalog.inventory_list)

register("low_stock_items", "O15", f"""
select id_producto, nombre, stock, 'Stock bajo: ' || nombre mensaje from ({_INVENTORY}) t where stock <= 5
""")(lambda ctx: catalog.low_stock_items(ctx, 5))

register("client_directory", "O16", """
select id_cliente, nombre, telefono, correo, direccion, upper(substr(nombre, 1, 1)) inicial
from clientes where activo = 1 and origen = 'manual'
order by nombre nulls first, id_cliente limit 20
""")(lambda ctx: catalog.client_directory(ctx, 20))

register("sales_picker", "O17", """
select * from (
  select 'producto' tipo, p.id_producto id, p.nombre, cast(p.precio_venta as double) precio,
    coalesce(i.stock_actual, 0) stock
  from productos p left join inventario i on i.id_producto = p.id_producto
  where p.activo = 1 order by p.nombre nulls first, p.id_producto limit 20) a
union all
select * from (
  select 'cliente' tipo, id_cliente id, nombre, cast(null as double) precio, cast(null as integer) stock
  from clientes where activo = 1 and origen = 'manual' order by nombre nulls first, id_cliente limit 20) b
""")(lambda ctx: catalog.sales_picker(ctx, 20))

register("product_form_check", "O18", """
select id_producto,
  case when nombre is null or nombre = '' then 'falta nombre'
       when precio_venta is null then 'falta precio_venta'
       when id_categoria is null then 'falta id_categoria' end reason,
  not (nombre is null or nombre = '' or precio_venta is null or id_categoria is null) valido
from productos
""")(catalog.product_form_check)

_FORMS = """
select id_cliente id_formulario, case when id_cliente % 11 <> 0 then nombre end nombre,
  case when id_cliente % 7 = 0 then '' else correo end correo,
  case when id_cliente % 5 = 0 then '' else 'clave' || id_cliente end clave,
  ['destino', 'agencia', 'retiro', ''][id_cliente % 4 + 1] tipo_envio,
  case when id_cliente % 9 <> 0 then 'MRW' end empresa_envio,
  case when id_cliente % 13 = 0 then '  ' else 'A' || id_cliente end codigo_agencia,
  case when id_cliente % 6 = 0 then '' else 'Caracas' end ciudad,
  case when id_cliente % 10 <> 0 then 'Miranda' end estado
from clientes"""
_CHECKED = "select id_formulario, reason, reason is null valido from (select id_formulario, {reason} reason from (" + _FORMS + ") f) t"
_FORM_COLS = ["id_formulario", "reason", "valido"]

register("checkout_form_check", "O18", _CHECKED.format(reason="""case
  when tipo_envio = '' then 'falta tipo_envio' when tipo_envio = 'retiro' then null
  when empresa_envio is null then 'falta empresa_envio' when trim(codigo_agencia) = '' then 'falta codigo_agencia'
  when ciudad = '' then 'falta ciudad' when estado is null then 'falta estado' end"""))(
    lambda ctx: catalog.checkout_form_check(catalog.forms_from_customers(ctx)).select(*_FORM_COLS))

register("client_form_check", "O18", _CHECKED.format(reason="""case
  when nombre is null or nombre = '' then 'falta nombre' when correo is null or correo = '' then 'falta correo' end"""))(
    lambda ctx: catalog.client_form_check(catalog.forms_from_customers(ctx)).select(*_FORM_COLS))

register("signup_form_check", "O18", _CHECKED.format(reason="""case
  when nombre is null or nombre = '' then 'falta nombre' when correo is null or correo = '' then 'falta correo'
  when clave = '' then 'falta clave' end"""))(
    lambda ctx: catalog.signup_form_check(catalog.forms_from_customers(ctx)).select(*_FORM_COLS))

register("registration_conflicts", "O19", """
with signups as (select id_cliente id_alta, nombre, correo from clientes)
select id_alta, nombre, correo, string_agg(motivo, ',' order by motivo) motivos from (
  select s.*, 'nombre' motivo from signups s where exists (select 1 from usuarios u where u.nombre = s.nombre)
  union all
  select s.*, 'correo' motivo from signups s where exists (select 1 from usuarios u where u.correo = s.correo)
) t group by id_alta, nombre, correo
""")(lambda ctx: catalog.registration_conflicts(catalog.signups_from_customers(ctx), ctx["usuarios"]))

register("first_image", "O20", f"select * from {_FIRST_IMAGE} t")(catalog.first_image)

register("trending", "O43", _CATALOG.format(extra="", order="p.id_producto desc", limit="limit 8"))(
    lambda ctx: catalog.trending(ctx, 8))

_order_values = ", ".join(f"('{n}', {i + 1})" for i, n in enumerate(DISPLAY_ORDER))
register("ordered_category_filter", "O44", f"""
select c.id_categoria, c.nombre, cast(o.posicion as bigint) posicion
from categorias c join (values {_order_values}) o(nombre, posicion) on o.nombre = c.nombre
order by posicion, id_categoria
""")(lambda ctx: catalog.ordered_category_filter(ctx, DISPLAY_ORDER))

_req_values = ", ".join(f"('{n}')" for n in REQUIRED_CATEGORIES)
register("missing_reference_rows", "O45", f"""
select cast((select coalesce(max(id_categoria), 0) from categorias)
            + row_number() over (order by r.nombre) as bigint) id_categoria, r.nombre
from (values {_req_values}) r(nombre)
where not exists (select 1 from categorias c where c.nombre = r.nombre)
""")(lambda ctx: catalog.missing_reference_rows(
    ctx.spark.createDataFrame([(n,) for n in REQUIRED_CATEGORIES], "nombre string"),
    ctx["categorias"], "nombre", "id_categoria"))
