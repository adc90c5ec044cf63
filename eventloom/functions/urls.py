"""URL pieces as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_params(query: Column) -> Column:
    """A query string as a decoded map; a repeated key keeps its last value.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                _decode(F.substring_index(p, "=", 1)).alias("key"),
                F.when(
                    F.instr(p, F.lit("=")) > 0,
                    _decode(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))),
                )
                .otherwise(F.lit(""))
                .alias("value"),
            ),
        )
    )


def without_keys(params: Column, keys: list[str]) -> Column:
    return F.map_filter(params, lambda k, _: ~k.isin(keys))


def encode_query(params: Column) -> Column:
    """A map as a form-encoded query string, keys in order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(params)),
            lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])),
        ),
        "&",
    )


def append_param(url: Column, key: str, value: Column) -> Column:
    """Add a parameter with ``&`` where the URL has a query already, else with ``?``."""
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, joiner, F.lit(f"{key}="), value)
