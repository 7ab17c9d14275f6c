"""Date and time strings of payloads and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted forms, in the order in which they are tried; without a zone they are UTC.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)


def parsed(value: Column) -> Column:
    """A timestamp, or null for a string in none of the forms."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in FORMATS])
