"""Tracking links: registry, resolution, rotation, counts, and URL building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import crypto, urls
from eventloom.functions.columns import first_rows
from eventloom.operators.filters import PAGE_LIMIT
from eventloom.operators.rollup import PIVOT_TYPES, link_pivot


def current_links(links: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The registry with the latest destination of every link.

    ``changes`` holds (id, destination, updated_at); a change to an unknown link is ignored.
    """
    if changes is None:
        return links
    latest = changes.groupBy("id").agg(
        F.max_by("destination", F.struct("updated_at", "destination")).alias("_new")
    )
    return (
        links.join(latest, "id", "left")
        .withColumn("destination", F.coalesce("_new", "destination"))
        .drop("_new")
    )


def link_registry(
    links: DataFrame, tenants: DataFrame, tenant_id: str | None = None,
    limit: int | None = PAGE_LIMIT, offset: int = 0,
) -> DataFrame:
    """A page of links with their tenant's prefix, newest first."""
    if tenant_id is not None:
        links = links.where(F.col("tenant_id") == tenant_id)
    ids = tenants.select(F.col("id").alias("tenant_id"), "key_prefix")
    rows = links.join(ids, "tenant_id").select("id", "destination", "created_at", "key_prefix")
    return first_rows(rows.orderBy(F.desc("created_at"), F.desc("id")), limit, offset)


def registry_map(links: DataFrame, tenants: DataFrame) -> DataFrame:
    """All links as (tu_id, destination, key_prefix), the shape request handling needs."""
    ids = tenants.select(F.col("id").alias("tenant_id"), "key_prefix")
    return links.join(ids, "tenant_id").select(F.col("id").alias("tu_id"), "destination", "key_prefix")


def resolve_links(clicks: DataFrame, registry: DataFrame) -> DataFrame:
    """Link clicks with their link's tenant and redirect target; NULL target: unknown link."""
    joined = clicks.where("tu_id is not null").join(registry, "tu_id", "left")
    return joined.withColumn(
        "redirect", urls.append_param(F.col("destination"), "ad_click_id", F.col("event_id"))
    )


def unknown_links(clicks: DataFrame, registry: DataFrame) -> DataFrame:
    """Links seen in clicks but not registered. Clicks are counted per link before the join."""
    return (
        clicks.where("tu_id is not null")
        .groupBy("tu_id")
        .agg(F.count("*").alias("clicks"), F.max("timestamp_ms").alias("last_seen_ms"))
        .join(registry.select("tu_id"), "tu_id", "left_anti")
    )


def link_counts(
    links: DataFrame, hourly_by_link: DataFrame, types: tuple[str, ...] = PIVOT_TYPES
) -> DataFrame:
    """Every link with its event counts, zeros where it has none."""
    counts = link_pivot(hourly_by_link, types).withColumnRenamed("tu_id", "id")
    return links.join(counts, "id", "left").fillna(0, subset=[f"{t}s" for t in types])


# --- URL building -----------------------------------------------------------------------


def _root(base_url: str) -> Column:
    return F.lit(base_url.rstrip("/"))


def _joined(root: Column, path: Column | str, query: Column) -> Column:
    return F.concat(root, F.lit(path) if isinstance(path, str) else path, F.lit("?"), query)


def _with_extra(head: Column, params: Column) -> Column:
    extra = urls.encode_query(params)
    return F.when(F.size(params) > 0, F.concat(head, F.lit("&"), extra)).otherwise(head)


def _signature(ipad: Column, opad: Column, message: Column, params: Column) -> Column:
    """Hex HMAC, prefixed by the tenant's prefix when params carry one."""
    raw = crypto.hmac_hex(ipad, opad, message)
    prefix = params["key_prefix"]
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("_"), raw)).otherwise(raw)


def signed_click_url(
    base_url: str, pads: tuple[Column, Column], destination: Column, params: Column
) -> Column:
    sig = _signature(*pads, destination, params)
    head = F.concat(F.lit("url="), F.url_encode(destination), F.lit("&sig="), sig)
    return _joined(_root(base_url), "/t", _with_extra(head, params))


def tracked_click_url(
    base_url: str, pads: tuple[Column, Column], tu_id: Column, params: Column
) -> Column:
    """Short link: the signature covers the link id, so its destination may change."""
    head = F.concat(F.lit("sig="), _signature(*pads, tu_id, params))
    return _joined(_root(base_url), F.concat(F.lit("/t/"), tu_id), _with_extra(head, params))


def encrypted_click_url(
    base_url: str, key_hex: Column, destination: Column, params: Column
) -> Column:
    head = F.concat(F.lit("d="), crypto.aes_seal(destination, key_hex))
    return _joined(_root(base_url), "/t", _with_extra(head, params))


def postback_url(base_url: str, params: Column) -> Column:
    return _joined(_root(base_url), "/p", urls.encode_query(params))


def impression_url(base_url: str, params: Column) -> Column:
    return _joined(_root(base_url), "/i", urls.encode_query(params))


def build_links(
    rows: DataFrame, tenants: DataFrame, base_url: str, tu_id: str = "tu_id",
    destination: str = "destination", params: str = "params",
) -> DataFrame:
    """All five URL kinds for a table of (tu_id, destination, key_prefix, params).

    Pads are prepared once per tenant, before the join.
    """
    ipad, opad = crypto.pad_columns(F.col("hmac_secret"))
    secrets = tenants.select(
        "key_prefix", ipad.alias("_ipad"), opad.alias("_opad"), "encryption_key"
    )
    pads = (F.col("_ipad"), F.col("_opad"))
    d, p = F.col(destination), F.col(params)
    return (
        rows.join(secrets, "key_prefix")
        .withColumns(
            {
                "signed_url": signed_click_url(base_url, pads, d, p),
                "tracked_url": tracked_click_url(base_url, pads, F.col(tu_id), p),
                "encrypted_url": encrypted_click_url(base_url, F.col("encryption_key"), d, p),
                "postback_url": postback_url(base_url, p),
                "impression_url": impression_url(base_url, p),
            }
        )
        .drop("_ipad", "_opad", "encryption_key")
    )


def decrypt_links(rows: DataFrame, key_hex: Column, blob: str = "d") -> DataFrame:
    """Opaque link blobs opened; ``ok`` is false for a row that cannot be."""
    return rows.withColumn("destination", crypto.aes_open(F.col(blob), key_hex)).withColumn(
        "ok", F.col("destination").isNotNull()
    )
