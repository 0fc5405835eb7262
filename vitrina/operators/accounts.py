"""External sign-in links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.ids import dense_ids, next_id_base

DEFAULT_ROLE_ID = 2  # Fixed value: role 'Trabajador' for users created by sign-in


def linked_accounts_map(links: DataFrame) -> DataFrame:
    """O38 (profile): per user, provider -> e-mail map (latest link wins)."""
    per = links.groupBy("id_usuario", "proveedor").agg(F.max_by("proveedor_correo", "id_cuenta").alias("c"))
    return per.groupBy("id_usuario").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("proveedor", "c")))).alias("cuentas"))


def link_removal_rules(links: DataFrame, users: DataFrame) -> DataFrame:
    """O38 (unlink): per (user, provider): the number of the user's links to
    other providers, and whether the link may be removed (the user has a
    password, or another link). Counts are two aggregates joined, not a
    window per user, so a user with very many links is not one task."""
    per = links.groupBy("id_usuario", "proveedor").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("proveedor_correo", "id_cuenta").alias("proveedor_correo"))
    tot = links.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("_t"))
    j = per.join(tot, "id_usuario").join(users.select("id_usuario", "has_password"), "id_usuario", "left")
    others = (F.col("_t") - F.col("_n")).cast("long")
    return j.select("id_usuario", "proveedor", "proveedor_correo", others.alias("otros"),
                    (F.coalesce("has_password", F.lit(False)) | (others > 0)).alias("removible"))


def linked_account_writes(incoming: DataFrame, links: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """External sign-ins (proveedor, proveedor_id, correo, nombre, ts)
    -> the users they resolve to and the rows to write.

    Links whose user no longer exists are dropped first. Tier 1: an existing
    link. Tier 2: a user with the sign-in e-mail (a link is added). Tier 3: a
    new user with a link: one per distinct e-mail, or per (provider, provider
    id) where the e-mail is NULL or empty; ids follow the current maximum in
    order of first sign-in. Later sign-ins with the same provider id follow the
    first one, as the sequential reference does through the link it created.

    Frames: resolved (proveedor, proveedor_id, id_usuario, via), new_users,
    new_links, stale_links (rows to delete)."""
    valid_links = links.join(users.select("id_usuario"), "id_usuario", "left_semi")
    stale = links.join(users.select("id_usuario"), "id_usuario", "left_anti")
    first = incoming.groupBy("proveedor", "proveedor_id").agg(
        F.min(F.struct("ts", F.nullif("correo", F.lit("")).alias("correo"), "nombre")).alias("f"))
    first = first.select("proveedor", "proveedor_id", "f.correo", "f.nombre", "f.ts")
    by_link = valid_links.groupBy("proveedor", "proveedor_id").agg(F.min("id_usuario").alias("_u_link"))
    by_mail = users.filter(F.col("correo") != "").groupBy("correo").agg(F.min("id_usuario").alias("_u_mail"))
    j = first.join(by_link, ["proveedor", "proveedor_id"], "left").join(by_mail, "correo", "left")
    j = j.withColumn("_node", F.coalesce(F.concat(F.lit("m:"), "correo"),
                                         F.concat(F.lit("p:"), "proveedor", F.lit("|"), "proveedor_id")))
    fresh = j.filter(F.col("_u_link").isNull() & F.col("_u_mail").isNull())
    nodes = fresh.groupBy("_node").agg(F.min(F.struct("ts", "proveedor", "proveedor_id", "correo", "nombre")).alias("f"))
    nodes = dense_ids(nodes.select("_node", "f.ts", "f.correo", "f.nombre"), ["ts", "_node"],
                      next_id_base(users, "id_usuario"), "_u_new")
    all_ = j.join(nodes.select("_node", "_u_new"), "_node", "left").select(
        "proveedor", "proveedor_id", "correo", F.coalesce("_u_link", "_u_mail", "_u_new").alias("id_usuario"),
        F.when(F.col("_u_link").isNotNull(), F.lit("vinculo")).when(F.col("_u_mail").isNotNull(), F.lit("correo"))
        .otherwise(F.lit("nuevo")).alias("via"))
    added = all_.filter(F.col("via") != "vinculo").select(
        "id_usuario", "proveedor", "proveedor_id", F.coalesce("correo", F.lit("")).alias("proveedor_correo"))
    added = dense_ids(added, ["proveedor", "proveedor_id"], next_id_base(links, "id_cuenta"), "id_cuenta")
    return {"resolved": all_.drop("correo"),
            "new_users": nodes.select(F.col("_u_new").alias("id_usuario"), "nombre", "correo",
                                      F.lit(DEFAULT_ROLE_ID).cast("long").alias("id_rol")),
            "new_links": added, "stale_links": stale}


def resolve_linked_accounts(incoming: DataFrame, links: DataFrame, users: DataFrame) -> DataFrame:
    """One row per (proveedor, proveedor_id) with its user; see
    ``linked_account_writes`` for the rules."""
    return linked_account_writes(incoming, links, users)["resolved"]


def unlink_accounts(requests: DataFrame, links: DataFrame, users: DataFrame) -> DataFrame:
    """O79 (unlink): the links that requests (id_usuario, proveedor) delete: the
    pairs that ``link_removal_rules`` marks removable."""
    can = link_removal_rules(links, users).filter("removible").select("id_usuario", "proveedor")
    pairs = requests.select("id_usuario", "proveedor").distinct().join(can, ["id_usuario", "proveedor"], "left_semi")
    return links.join(pairs, ["id_usuario", "proveedor"], "left_semi")


def signins_from_events(events: DataFrame) -> DataFrame:
    """Purchase events presented as external sign-ins: provider by event id
    parity, provider id from props.k (every third event one of its user's own,
    which no link has), every fifth event with an e-mail no user has, every
    seventh without e-mail."""
    prov = F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("google")).otherwise(F.lit("facebook"))
    user = F.col("user_id").cast("string")
    own = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("_u"), user)).otherwise(F.lit(""))
    mail = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(None).cast("string")) \
        .when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("nuevo"), user, F.lit("@mail.com"))) \
        .otherwise(F.concat(F.lit("c"), user, F.lit("@example.com")))
    return events.filter(F.col("event_type") == "purchase").select(
        prov.alias("proveedor"), F.concat(prov, F.lit("_"), F.get_json_object("props", "$.k"), own).alias("proveedor_id"),
        mail.alias("correo"), F.concat(F.lit("user"), user).alias("nombre"), F.col("ts"))
