"""Feeds into the vulnerability table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from lynceus.operators.vulnerabilities import feed_order, flatten_nvd, flatten_osv, upsert


def sync_advisories(
    table: DataFrame,
    now: datetime,
    nvd: DataFrame | None = None,
    osv: DataFrame | None = None,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """The table after an NVD feed and then an OSV feed."""
    feeds = []
    if nvd is not None:
        feeds.append(flatten_nvd(nvd))
    if osv is not None:
        feeds.append(flatten_osv(osv, seeds))
    return upsert(table, feed_order(*feeds), now) if feeds else table
