"""Text functions, all built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An address inside a text: the last label of its domain is letters, so a full stop behind it stays.
EMAIL_PATTERN = r"(?i)\b[a-z0-9][\w.+%-]*+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}\b"

IN_PLACE = {"upper": F.upper, "lower": F.lower, "reverse": F.reverse}


def has_at_sign(c: Column) -> Column:
    return c.contains("@")


def mask_emails(c: Column, mask: str) -> Column:
    return F.regexp_replace(c, EMAIL_PATTERN, mask)
