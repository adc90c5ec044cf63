"""On-site activity stitched to the ad click that sent it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.filters import select_events
from eventloom.operators.skew import ordinal

KEY = ["tenant_id", "ad_click_id"]


def _steps(events: DataFrame, click_type: str, *fields: str) -> DataFrame:
    """Events by the click they belong to, in one scan: a click to itself, a hit to the click
    it names. ``after`` is 0 for the click's own row."""
    own = F.when(
        F.col("event_type") == click_type,
        F.struct(F.col("event_id").alias("ad_click_id"), F.lit(0).alias("after")),
    )
    named = F.col("params")["ad_click_id"]
    hit = F.when(named.isNotNull(), F.struct(named.alias("ad_click_id"), F.lit(1).alias("after")))
    return events.select(
        "tenant_id", *fields, F.explode(F.array_compact(F.array(own, hit))).alias("s")
    ).select("tenant_id", "s.ad_click_id", "s.after", *fields)


def attribution_journey(
    events: DataFrame, click_type: str = "click", tenant: str | None = None
) -> DataFrame:
    """Every step of every ad click in time order, the click itself as its first step.

    A click that led to nothing is a journey of one step; a hit whose click is unknown is
    in none. Steps stay rows and are numbered by time slice, so one click may own any
    share of the hits.
    """
    fields = ["event_id", "event_type", "timestamp_ms", "page", "href"]
    rows = select_events(events, tenant=tenant).withColumns(
        {"page": F.col("params")["page"], "href": F.col("params")["href"]}
    )
    return ordinal(
        _steps(rows, click_type, *fields), KEY, "timestamp_ms", ["after", "event_id"], "step",
        require=F.col("after") == 0,
    ).drop("after")


def attribution_funnel(
    events: DataFrame, click_type: str = "click", tenant: str | None = None
) -> DataFrame:
    """Per tenant and hit type: hits, clicks that led to one, and their share of all clicks.

    Rows are counted per click and type first; all that follows works on those counts.
    """
    steps = _steps(select_events(events, tenant=tenant), click_type, "event_type")
    per_click = steps.groupBy(*KEY, "event_type", "after").agg(F.count("*").alias("n"))
    known = F.min("after").over(Window.partitionBy(*KEY)) == 0
    per_type = (
        per_click.withColumn("known", known)
        .where("known")
        .groupBy("tenant_id", "event_type", "after")
        .agg(F.sum("n").alias("hits"), F.count("*").alias("clicks_with"))
    )
    own = F.when(F.col("after") == 0, F.col("clicks_with"))
    return (
        per_type.withColumn("clicks", F.sum(own).over(Window.partitionBy("tenant_id")))
        .where("after = 1")
        .select(
            "tenant_id", "event_type", "hits", "clicks_with", "clicks",
            (F.col("clicks_with") / F.col("clicks")).alias("rate"),
        )
    )
