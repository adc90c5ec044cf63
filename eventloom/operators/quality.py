"""Quality filter: empty and bot user agents, tenant rules, IP rate, drop statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.crypto import CMS_DEPTH, sketch_slots

# User-agent substrings that mark a bot, tried in this order.
BOT_UA_PATTERNS = (
    "bot", "crawler", "spider", "scraper", "wget", "curl",
    "headlesschrome", "phantomjs", "selenium", "puppeteer",
    "python-requests", "python-urllib", "go-http-client",
    "java/", "apache-httpclient", "okhttp", "libwww-perl",
    "mechanize", "scrapy", "httpclient", "feedfetcher",
    "facebookexternalhit", "twitterbot", "linkedinbot",
    "slackbot", "discordbot", "telegrambot", "whatsapp",
    "googlebot", "bingbot", "yandexbot", "baiduspider",
    "duckduckbot", "sogou", "exabot", "ia_archiver",
    "semrushbot", "ahrefsbot", "mj12bot", "dotbot",
    "rogerbot", "seznambot", "archive.org_bot",
)

# What a rule may test and how.
RULE_FIELDS = (
    "user_agent", "referer", "ip", "event_type", "request_path", "request_host",
)
RULE_OPERATORS = ("contains", "equals", "is_empty", "not_empty", "starts_with")
RULE_ACTIONS = ("drop", "flag")

IP_RATE_LIMIT = 200
IP_WINDOW_SECS = 60
WINDOW_SLICES = 16


def _first_matches() -> list[str]:
    """Patterns that can be the first to match: one holding an earlier pattern never is."""
    return [
        p
        for i, p in enumerate(BOT_UA_PATTERNS)
        if not any(earlier in p for earlier in BOT_UA_PATTERNS[:i])
    ]


def ua_drop_reason(user_agent: Column, lowered: Column) -> Column:
    """Why the user agent is refused, NULL when it is not."""
    bots = [F.when(F.contains(lowered, F.lit(p)), F.lit(f"bot_ua:{p}")) for p in _first_matches()]
    return F.when(user_agent == "", "empty_user_agent").otherwise(F.coalesce(*bots))


def with_builtin_reason(events: DataFrame) -> DataFrame:
    return (
        events.withColumn("_ua", F.lower("user_agent"))
        .withColumn("drop_reason", ua_drop_reason(F.col("user_agent"), F.col("_ua")))
        .drop("_ua")
    )


# --- tenant rules ---------------------------------------------------------------------


def rules_valid(rules: DataFrame) -> DataFrame:
    """Rules with ``problem``: NULL for one the engine can run, else what is wrong."""
    field = F.col("field")
    return rules.withColumn(
        "problem",
        F.when(~(field.isin(*RULE_FIELDS) | field.startswith("param:")), "field")
        .when(~F.col("operator").isin(*RULE_OPERATORS), "operator")
        .when(~F.col("action").isin(*RULE_ACTIONS), "action"),
    )


def active_rules(rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """Runnable rules with the tenant row id replaced by the prefix events carry."""
    ids = tenants.select(F.col("id").alias("tenant_id"), "key_prefix")
    named = rules_valid(rules).where("active and problem is null").join(ids, "tenant_id", "left")
    return named.where("tenant_id = '*' or key_prefix is not null").select(
        "rule_order",
        F.when(F.col("tenant_id") == "*", "*").otherwise(F.col("key_prefix")).alias("tenant_id"),
        "field", "operator", "value", "action",
    )


def _value_matches(value: Column, operator: str, wanted: Column) -> Column:
    if operator == "is_empty":
        return F.coalesce(value, F.lit("")) == ""
    if operator == "not_empty":
        return F.coalesce(value, F.lit("")) != ""
    if operator == "equals":
        test = value == wanted
    elif operator == "contains":
        test = F.contains(F.lower(value), F.lower(wanted))
    else:
        test = F.startswith(F.lower(value), F.lower(wanted))
    return F.coalesce(test, F.lit(False))


def _reason(field: Column, operator: Column, value: Column) -> Column:
    return F.concat_ws(":", F.lit("rule"), field, operator, value)


def _matching(rules: Column) -> Column:
    """The rules of an array column that match the event, in rule order."""

    def test(r: Column) -> Column:
        value = reduce(
            lambda acc, name: acc.when(r["field"] == name, F.col(name)),
            RULE_FIELDS[1:],
            F.when(r["field"] == RULE_FIELDS[0], F.col(RULE_FIELDS[0])),
        ).when(
            r["field"].startswith("param:"),
            F.col("params")[F.substring(r["field"], F.lit(7), F.length(r["field"]))],
        )
        return reduce(
            lambda acc, op: acc.when(r["operator"] == op, _value_matches(value, op, r["value"])),
            RULE_OPERATORS[1:],
            F.when(
                r["operator"] == RULE_OPERATORS[0],
                _value_matches(value, RULE_OPERATORS[0], r["value"]),
            ),
        )

    return F.filter(rules, test)


def apply_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``drop_reason`` (first matching drop rule) and ``flags`` (matching flag rules).

    ``rules`` comes from ``active_rules``. Rules are gathered into one array per tenant and joined
    on the tenant: no row multiplies, and any number of rules takes the same path. Rules for all
    tenants are a one-value subquery. Spark sizes the join side itself; a hot tenant's events are
    split by the skew join when it is not broadcast.
    """
    row = F.struct("rule_order", "field", "operator", "value", "action")
    own = (
        rules.where("tenant_id <> '*'")
        .groupBy("tenant_id")
        .agg(F.array_sort(F.collect_list(row)).alias("_own"))
    )
    shared = rules.where("tenant_id = '*'").select(F.array_sort(F.collect_list(row))).scalar()
    joined = events.join(own, "tenant_id", "left").withColumn("_all", shared)
    merged = F.array_sort(
        F.concat(
            F.coalesce(_matching(F.col("_own")), F.array().cast(dict(own.dtypes)["_own"])),
            _matching(F.col("_all")),
        )
    )

    def reasons(action: str) -> Column:
        return F.transform(
            F.filter("_hits", lambda r: r["action"] == action),
            lambda r: _reason(r["field"], r["operator"], r["value"]),
        )

    return (
        joined.withColumn("_hits", merged)
        .withColumns({"drop_reason": F.get(reasons("drop"), 0), "flags": reasons("flag")})
        .drop("_own", "_all", "_hits")
        .select(*events.columns, "drop_reason", "flags")
    )


# --- IP rate --------------------------------------------------------------------------


def _windowed(events: DataFrame, window_secs: int) -> DataFrame:
    return events.withColumn("wid", F.expr(f"timestamp_ms div {window_secs * 1000}"))


def ip_rate_exact(
    events: DataFrame, limit: int = IP_RATE_LIMIT, window_secs: int = IP_WINDOW_SECS,
    carried: DataFrame | None = None, eligible: Column | None = None,
) -> DataFrame:
    """Running count of the IP in its window plus its total in the window before, against
    the limit; 0 switches the check off. Windows are epoch-aligned. Only ``eligible`` events
    (all, without it) are counted and limited; the others pass with counts of 0.

    A window is numbered in slices of its time, so a hot IP spreads over tasks. ``carried`` holds
    (ip, wid, count) of events that came before, for a table that arrives in batches.
    """
    slice_ms = max(window_secs * 1000 // WINDOW_SLICES, 1)
    rows = _windowed(events, window_secs).withColumns(
        {
            "_ip": F.coalesce("ip", F.lit("")), "_slice": F.expr(f"timestamp_ms div {slice_ms}"),
            "_in": F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)),
        }
    )
    key = ["_ip", "wid", "_slice"]
    counts = rows.where("_in").groupBy(*key).agg(F.count("*").alias("_n"))
    if carried is not None:
        # What came before stands ahead of all slices of its window.
        earlier = F.lit(None).cast("long").alias("_slice")
        counts = counts.unionByName(
            carried.select(F.coalesce("ip", F.lit("")).alias("_ip"), "wid", earlier, F.col("count").alias("_n"))
        )
    inside = Window.partitionBy("_ip", "wid").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("_ip").orderBy("wid").rangeBetween(-1, -1)
    none = F.lit(0).cast("long")
    slices = counts.withColumn("prev_count", F.coalesce(F.sum("_n").over(back), none)).withColumn(
        "_before", F.coalesce(F.sum("_n").over(inside), none)
    )
    order = Window.partitionBy(*key).orderBy("timestamp_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_pos", F.sum(F.col("_in").cast("long")).over(order)).join(slices.drop("_n"), key, "left")
    ours = lambda count: F.when(F.col("_in"), count).otherwise(none)
    counted = placed.withColumns(
        {"cur_count": ours(F.col("_before") + F.col("_pos")), "prev_count": ours(F.col("prev_count"))}
    ).select(*events.columns, "wid", "cur_count", "prev_count")
    return _limited(counted, limit)


def ip_window_counts(events: DataFrame, window_secs: int = IP_WINDOW_SECS) -> DataFrame:
    """(ip, wid, count) of the events, for a later batch to carry on from."""
    return _windowed(events, window_secs).groupBy("ip", "wid").count()


def ip_rate_sketch(
    events: DataFrame, limit: int = IP_RATE_LIMIT, window_secs: int = IP_WINDOW_SECS
) -> DataFrame:
    """``ip_rate_exact`` with the counts a 4 x 65,536 count-min sketch would give.

    Each sketch row is one window and one join on (wid, slot); a window is a short time
    slice, so no group outgrows one window of traffic.
    """
    rows = _windowed(events, window_secs)
    names = [f"_slot{i}" for i in range(CMS_DEPTH)]
    out = (
        rows.withColumn("_slots", sketch_slots(F.col("ip")))
        .withColumns({n: F.col("_slots")[i] for i, n in enumerate(names)})
        .drop("_slots")
    )
    per_ip = out.groupBy("wid", *names).agg(F.count("*").alias("_n"))
    for i, slot in enumerate(names):
        order = Window.partitionBy("wid", slot).orderBy("timestamp_ms", "event_id")
        previous = (
            per_ip.groupBy("wid", slot)
            .agg(F.sum("_n").alias(f"_prev{i}"))
            .withColumn("wid", F.col("wid") + 1)
        )
        out = out.withColumn(f"_cur{i}", F.row_number().over(order)).join(
            previous, ["wid", slot], "left"
        )
    spans = range(CMS_DEPTH)
    estimated = out.withColumns(
        {
            "cur_count": F.least(*[f"_cur{i}" for i in spans]).cast("long"),
            "prev_count": F.least(
                *[F.coalesce(F.col(f"_prev{i}"), F.lit(0)) for i in spans]
            ).cast("long"),
        }
    ).drop(*names, *[f"_cur{i}" for i in spans], *[f"_prev{i}" for i in spans])
    return _limited(estimated, limit)


def _limited(counted: DataFrame, limit: int) -> DataFrame:
    over = F.col("cur_count") + F.col("prev_count") > limit if limit else F.lit(False)
    return counted.withColumn("limited", over)


def cms_ip_counts(events: DataFrame) -> DataFrame:
    """Exact and sketched count of every IP. Events are counted per IP first, so only
    distinct IPs are hashed and shuffled again."""
    per_ip = events.groupBy("ip").agg(F.count("*").alias("exact"))
    cells = per_ip.select(
        "ip", "exact", F.posexplode(sketch_slots(F.col("ip"))).alias("row", "slot")
    )
    # At most 4 x 65,536 rows, whatever the number of IPs: a proven bound to broadcast.
    table = cells.groupBy("row", "slot").agg(F.sum("exact").alias("total"))
    return (
        cells.join(F.broadcast(table), ["row", "slot"])
        .groupBy("ip")
        .agg(F.max("exact").alias("exact"), F.min("total").alias("estimate"))
    )


# --- the whole filter and its statistics ------------------------------------------------


def quality_filter(
    events: DataFrame,
    rules: DataFrame | None = None,
    ip_limit: int = IP_RATE_LIMIT,
    window_secs: int = IP_WINDOW_SECS,
    sketch: bool = False,
) -> DataFrame:
    """All checks in order: user agent, IP rate, tenant rules. Adds ``drop_reason`` and ``flags``.

    IPs are counted exactly, in one shuffle. ``sketch`` counts as a fixed-size sketch would,
    collisions included, which takes a shuffle per sketch row.
    """
    if rules is None:
        judged = events.withColumns(
            {"drop_reason": F.lit(None).cast("string"), "flags": F.array().cast("array<string>")}
        )
    else:
        judged = apply_rules(events, rules)
    judged = with_builtin_reason(judged.withColumnRenamed("drop_reason", "_rule"))
    limited = F.when(F.col("limited"), F.concat(F.lit("ip_rate_limit:"), F.col("ip")))
    reason = F.coalesce("drop_reason", limited, "_rule")
    columns = [*events.columns, "drop_reason", "flags"]
    if not sketch:
        counted = ip_rate_exact(judged, ip_limit, window_secs, eligible=F.col("drop_reason").isNull())
        return counted.withColumn("drop_reason", reason).select(*columns)
    refused = judged.where("drop_reason is not null")
    counted = ip_rate_sketch(judged.where("drop_reason is null"), ip_limit, window_secs)
    return refused.select(*columns).unionByName(counted.withColumn("drop_reason", reason).select(*columns))


def drop_reasons(judged: DataFrame, top: int = 5) -> DataFrame:
    return (
        judged.where("drop_reason is not null")
        .groupBy("drop_reason")
        .count()
        .orderBy(F.desc("count"), "drop_reason")
        .limit(top)
    )


def drop_rate(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count("*").alias("total"),
        F.count("drop_reason").alias("dropped"),
        F.coalesce(F.try_divide(F.count("drop_reason"), F.count("*")), F.lit(0.0)).alias(
            "drop_rate"
        ),
    )
