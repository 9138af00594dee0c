"""Expiry timestamps from the ways in which a time to live can be given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LARGEST = (1 << 63) - 1


def expire_ts(kind: Column, value: Column, now_ms: Column, default_ttl_ms: int | None = None) -> Column:
    """kind: default, no_expiry, after_ms or at_ms. What overflows a long never expires."""

    def after(ms: Column) -> Column:
        return F.when(ms <= F.lit(_LARGEST) - now_ms, now_ms + ms)

    default = F.lit(None).cast("long") if default_ttl_ms is None else after(F.lit(default_ttl_ms))
    return F.when(kind == "default", default).when(kind == "after_ms", after(value)).when(kind == "at_ms", value)


def not_expired(expire: Column, now_ms: Column) -> Column:
    """For applications that hide expired rows themselves; reads never do."""
    return expire.isNull() | (expire > now_ms)
