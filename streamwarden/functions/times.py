"""Event-time helpers. Timestamps without an offset are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, NULL when it cannot be read."""
    zoned = (
        F.when(text.rlike(_DATE_ONLY), F.concat(text, F.lit("T00:00:00Z")))
        .when(F.substring(text, 11, 100).rlike(_OFFSET), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.when(text.rlike(_ISO), zoned.try_cast("timestamp"))


def hour_as_written(text: Column) -> Column:
    """Hour of day in the offset the text was written in, NULL when unreadable."""
    hour = F.when(text.rlike(_DATE_ONLY), F.lit(0)).otherwise(F.substring(text, 12, 2).try_cast("int"))
    return F.when(parse_iso(text).isNotNull(), hour)


def seconds_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
