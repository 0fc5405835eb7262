"""Request limits (O75): users over ``n`` requests in a fixed window.

Batch twin of the streaming job in ``vitrina.streaming.streams``: the same
``window`` aggregation, without a watermark. Fixed windows start at the epoch
(UTC), like a fixed-window limiter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The limits the shop sets (requests, window, route; None: all).
SHOP_LIMITS = [(200, "1 day", None), (50, "1 hour", None), (10, "1 minute", "login"), (5, "1 minute", "register")]


def rate_limit_counts(events: DataFrame, window: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("solicitudes"))


def rate_limit_flags(events: DataFrame, n: int, window: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, window start, window end, requests, limit) for every window in
    which the key made more than ``n`` requests."""
    c = rate_limit_counts(events, window, key, ts)
    return c.filter(F.col("solicitudes") > n).select(
        key, F.col("w.start").alias("ventana_inicio"), F.col("w.end").alias("ventana_fin"),
        "solicitudes", F.lit(n).alias("limite"))


def shop_limit_flags(requests: DataFrame, limits: list[tuple[int, str, str | None]] | None = None,
                     key: str = "direccion", ts: str = "ts", route: str = "ruta") -> DataFrame:
    """O75 for every limit the shop sets at once. A limit with a route counts the
    requests of that route, one without counts all. One aggregation per window
    length; flags carry the limit, its window and its route ('todas': all)."""
    limits = limits or SHOP_LIMITS
    parts = []
    for window in dict.fromkeys(w for _, w, _ in limits):
        mine = [(n, r) for n, w, r in limits if w == window]
        counts = requests.groupBy(F.window(ts, window).alias("w"), key).agg(
            *[F.count(F.when(F.col(route) == r, 1) if r else F.lit(1)).alias(f"_n{i}") for i, (_, r) in enumerate(mine)])
        flags = F.explode(F.array(*[F.struct(F.col(f"_n{i}").alias("solicitudes"), F.lit(n).alias("limite"),
                                             F.lit(r or "todas").alias("ruta")) for i, (n, r) in enumerate(mine)]))
        parts.append(counts.select(key, "w", flags.alias("f")).filter("f.solicitudes > f.limite").select(
            key, F.col("w.start").alias("ventana_inicio"), F.col("w.end").alias("ventana_fin"), "f.solicitudes",
            "f.limite", F.lit(window).alias("ventana"), "f.ruta"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
