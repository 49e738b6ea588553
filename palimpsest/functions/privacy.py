"""Masking of personal data and of sensitive settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Personal-data patterns, applied in this order, and their replacements.
PII_PATTERNS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[CARD]"),
)
# Parameter names whose values are dropped, and words that mark a setting sensitive.
REDACTED_PARAMS = ("password", "api_key", "secret", "token")
SENSITIVE_WORDS = ("key", "secret", "token", "password")


def pii_mask(text: Column) -> Column:
    for pattern, label in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, label)
    return text


def redact_params(params: Column, sanitize: bool = True) -> Column:
    clean = pii_mask if sanitize else (lambda c: c)
    return F.transform_values(
        params,
        lambda k, v: F.when(F.lower(k).isin(*REDACTED_PARAMS), F.lit("[REDACTED]")).otherwise(clean(v)),
    )


def summarize_output(output: Column, max_chars: int = 1000, summarize: bool = True,
                     sanitize: bool = True) -> Column:
    """Cut a long output (saying so if ``summarize``), then mask it; null reads ``None``."""
    text = F.coalesce(output, F.lit("None"))
    head = F.substring(text, 1, max_chars)
    if summarize:
        head = F.concat(head, F.lit("... [truncated, total length: "),
                        F.length(text).cast("string"), F.lit("]"))
    short = F.when(F.length(text) > max_chars, head).otherwise(text)
    return pii_mask(short) if sanitize else short


def mask_sensitive(value: Column) -> Column:
    """First four and last six characters of a long value, else only asterisks."""
    return F.when(
        F.length(value) > 10,
        F.concat(F.substring(value, 1, 4), F.lit("***"), F.right(value, F.lit(6))),
    ).otherwise(F.lit("***"))


def infer_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE_WORDS))
