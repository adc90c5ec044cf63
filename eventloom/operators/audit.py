"""Audits over tables of requests: ingest tokens and signed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import crypto

TOKEN_START = "pt_"


def token_audit(requests: DataFrame, registry: DataFrame, as_of_ms: int) -> DataFrame:
    """Adds ``status`` and, for an accepted token, the tenant's ``key_prefix``.

    Only the hash of a token is compared. Status is malformed, unknown, revoked, expired
    or valid, tested in that order.
    """
    hashed = requests.withColumn("token_hash", F.sha2("token", 256))
    known = registry.select(
        "token_hash", F.col("key_prefix").alias("_prefix"), "revoked", "expires_at"
    )
    status = (
        F.when(~F.coalesce(F.startswith("token", F.lit(TOKEN_START)), F.lit(False)), "malformed")
        .when(F.col("_prefix").isNull(), "unknown")
        .when(F.col("revoked"), "revoked")
        .when((F.col("expires_at") != 0) & (as_of_ms // 1000 > F.col("expires_at")), "expired")
        .otherwise("valid")
    )
    return (
        hashed.join(known, "token_hash", "left")
        .withColumn("status", status)
        .withColumn("key_prefix", F.when(F.col("status") == "valid", F.col("_prefix")))
        .drop("_prefix", "revoked", "expires_at", "token_hash")
    )


def signature_prefix(sig: Column) -> Column:
    """Text before an underscore within the first ten characters, when both parts exist."""
    at = F.instr(F.substring(sig, F.lit(1), F.lit(10)), F.lit("_"))
    return F.when(
        (at > 1) & (F.length(sig) > at), F.substring(sig, F.lit(1), (at - 1).cast("int"))
    )


def signed_link_audit(
    requests: DataFrame, tenants: DataFrame, global_secret: str, message: str = "url", sig: str = "sig"
) -> DataFrame:
    """Adds ``status``: valid, invalid or unknown_tenant.

    A prefixed signature is checked with that tenant's secret, any other with the global
    one. ``message`` is the signed text: the destination, or the link id for short links.
    """
    ipad, opad = crypto.pad_columns(F.col("hmac_secret"))
    secrets = tenants.select(
        F.col("key_prefix").alias("sig_prefix"), ipad.alias("_ipad"), opad.alias("_opad")
    )
    g_ipad, g_opad = crypto.literal_pads(global_secret)
    prefixed = F.col("sig_prefix").isNotNull()
    rest = F.substring(F.col(sig), F.length("sig_prefix") + 2, F.length(F.col(sig)))
    expected = crypto.hmac_hex(
        F.when(prefixed, F.col("_ipad")).otherwise(g_ipad),
        F.when(prefixed, F.col("_opad")).otherwise(g_opad),
        F.col(message),
    )
    given = F.lower(F.when(prefixed, rest).otherwise(F.col(sig)))
    return (
        requests.withColumn("sig_prefix", signature_prefix(F.col(sig)))
        .join(secrets, "sig_prefix", "left")
        .withColumn(
            "status",
            F.when(prefixed & F.col("_ipad").isNull(), "unknown_tenant")
            .when(F.coalesce(given == expected, F.lit(False)), "valid")
            .otherwise("invalid"),
        )
        .drop("_ipad", "_opad")
    )
