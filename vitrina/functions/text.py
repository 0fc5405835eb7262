"""Text columns: product names from files, shipping address / label, bar
widths, custom product descriptions (O53, O55-O57)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pick-up address of the store and the labels of the
# shipment types.
STORE_ADDRESS = "Retiro en Tienda — Av. Principal, Local 5, CC La Cascada, Caracas"
TYPE_LABELS = [("destino", "Cobro a Destino"), ("tienda", "Retiro en Tienda"), ("agencia", "Retirar en Agencia")]
NO_ADDRESS = "Por especificar"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def product_name_from_file(name) -> Column:
    """Drop the extension (a leading dot is not one), '_' and '-' to
    spaces, collapse whitespace, trim."""
    n = _c(name)
    stem = F.regexp_replace(n, r"^(\.*[^.].*)\.[^.]*$", "$1")
    spaced = F.translate(stem, "_-", "  ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def _truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def shipping_address(tipo, empresa, codigo, ciudad, estado) -> Column:
    """The checkout address: the store for pick-up, else the non-empty
    parts joined by ', ' (agency code prefixed 'Cód: '), or 'Por especificar'."""
    parts = F.concat_ws(", ", _truthy(_c(empresa)),
                        F.concat(F.lit("Cód: "), _truthy(_c(codigo))),
                        _truthy(_c(ciudad)), _truthy(_c(estado)))
    return F.when(_c(tipo) == "tienda", F.lit(STORE_ADDRESS)) \
        .otherwise(F.coalesce(F.nullif(parts, F.lit("")), F.lit(NO_ADDRESS)))


def type_label(tipo) -> Column:
    out = F.lit("")
    for t, label in reversed(TYPE_LABELS):
        out = F.when(_c(tipo) == t, F.lit(label)).otherwise(out)
    return out


def shipping_label(tipo, empresa) -> Column:
    """Carrier text: type label, plus ' - empresa' for home delivery or
    agency when a carrier is given."""
    t, e = _c(tipo), _c(empresa)
    return F.when(t.isin("destino", "agencia") & e.isNotNull() & (e != ""),
                  F.concat(type_label(t), F.lit(" - "), e)).otherwise(type_label(t))


def bar_width(qty) -> Column:
    """Chart bar width in percent: 5 x quantity, between 10 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(10), F.round(_c(qty) * 5))).cast("int")


def capitalize(s) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def custom_product_text(tipo, size, color, material, text, font, placement) -> tuple[Column, Column]:
    """(name, description) of a custom product:
    'Personalizado - Tipo' and "(Tipo, size, color, material) con texto: 'x' (font) en placement"."""
    cap = capitalize(tipo)
    base = F.concat(F.lit("("), cap, F.lit(", "), _c(size).cast("string"), F.lit(", "), _c(color),
                    F.lit(", "), _c(material), F.lit(")"))
    t = _c(text)
    extra = F.when(t.isNotNull() & (t != ""),
                   F.concat(F.lit(" con texto: '"), t, F.lit("' ("), _c(font), F.lit(") en "), _c(placement)))
    return F.concat(F.lit("Personalizado - "), cap), F.concat(base, F.coalesce(extra, F.lit("")))
