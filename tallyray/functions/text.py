"""Error-message classification (retryable / provider error) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case fragments that mark a message as retryable.
RETRYABLE_PATTERNS = [
    "timeout", "connection", "rate limit", "too many requests", "503", "502",
    "504", "temporary", "transient", "unavailable", "try again", "backend",
    "block range",
]

# Lower-case fragments that mark a provider (endpoint) error.
PROVIDER_PATTERNS = [
    "rate limit", "too many requests", "429", "timeout", "connection", "502",
    "503", "504", "unavailable", "backend", "-32603", "no response", "-32005",
    "-32701", "less number of addresses",
]


def _contains_any(text: Column, patterns: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(F.contains(low, F.lit(p)), F.lit(False))
    return out


def is_retryable(text) -> Column:
    return _contains_any(F.col(text) if isinstance(text, str) else text, RETRYABLE_PATTERNS)


def is_provider_error(text) -> Column:
    return _contains_any(F.col(text) if isinstance(text, str) else text, PROVIDER_PATTERNS)


def first_match(text, patterns: list[str]) -> Column:
    """The first pattern (list order) contained in the message, else null."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.contains(low, F.lit(p)), F.lit(p)).otherwise(out)
    return out
