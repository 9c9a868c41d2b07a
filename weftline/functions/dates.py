"""Publication dates of feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four patterns, tried in this order, with hours of 24 (the 12-hour letter would make noon midnight).
PATTERNS = ["EEE, dd MMM yyyy HH:mm Z", "dd MMM yyyy HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss Z"]


def parse_pub_date(text: Column, fallback: Column) -> Column:
    """The timestamp of a publication date; ``fallback`` where it is null or fits no pattern.

    Day names are dropped before parsing (they add nothing), "GMT" and "UTC" are +0000.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "(GMT|UTC|Z)$", "+0000"), "^[A-Za-z]{3}, *", "")
    plain = F.regexp_replace(plain, "([0-9])\\+", "$1 +")
    tries = [F.try_to_timestamp(plain, F.lit(p.removeprefix("EEE, "))) for p in PATTERNS]
    return F.coalesce(*tries, fallback)
