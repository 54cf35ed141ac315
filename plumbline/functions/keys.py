"""Hashes, ranks and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def finding_id(file: Column, title: Column, line: Column) -> Column:
    text = F.concat(file, F.lit("|"), title, F.lit("|"), F.coalesce(line.cast("string"), F.lit("")))
    return F.concat(F.lit(fv.FINDING_ID_PREFIX), F.substring(F.sha2(text, 256), 1, fv.FINDING_ID_HEX))


def line_free_id(file: Column, title: Column) -> Column:
    """Optional identity that survives a shift of lines."""
    return finding_id(file, title, F.lit(None).cast("int"))


def cache_key(id_: Column, snippet: Column, detail: Column) -> Column:
    blank, nul = F.lit(""), F.lit("\u0000")
    return F.sha2(
        F.concat(id_, nul, F.coalesce(snippet, blank), nul, F.coalesce(detail, blank)), 256
    )


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def token_prefix(token: Column) -> Column:
    return F.substring(token, 1, fv.TOKEN_DISPLAY_CHARS)


def bearer_token(header: Column) -> Column:
    """The one token after ``Bearer``, or null when the header or the token's prefix is wrong."""
    token = F.regexp_extract(header, fv.BEARER_PATTERN, 1)
    return F.when(token.startswith(fv.TOKEN_PREFIX), token)


def severity_rank(severity: Column) -> Column:
    """3..0; unknown severities rank 0."""
    ranked = F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1)
    return ranked.otherwise(0)


def annotation_level(severity: Column) -> Column:
    return F.when(severity == "HIGH", "failure").when(severity == "MEDIUM", "warning").otherwise("notice")


def requirement_confidence(confidence: Column) -> Column:
    return F.when(confidence == "definitive", "high").otherwise("medium")


def window_index(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_millis(ts.cast("timestamp")) / F.lit(seconds * 1000))


def window_end_millis(ts: Column, seconds: int) -> Column:
    return (window_index(ts, seconds) + 1) * F.lit(seconds * 1000)


def retry_seconds(ts: Column, seconds: int) -> Column:
    left = window_end_millis(ts, seconds) - F.unix_millis(ts.cast("timestamp"))
    return F.ceil(left / F.lit(1000))


def retry_ready_at(claimed_at: Column, attempts: Column) -> Column:
    wait = fv.BACKOFF_BASE_SECONDS * F.pow(F.lit(2), F.least(attempts, F.lit(fv.BACKOFF_MAX_EXPONENT)))
    return claimed_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)


def lease_expires_at(claimed_at: Column) -> Column:
    return claimed_at + F.expr(f"INTERVAL {fv.LEASE_SECONDS} SECONDS")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def category_key(label_or_key: Column) -> Column:
    """Key of a category label; keys pass through, anything else is null (and shows in the audit)."""
    keys = {label: key for key, label in fv.CATEGORY_LABEL.items()}
    keys.update({key: key for key in fv.CATEGORIES})
    return F.try_element_at(literal_map(keys), label_or_key)


def category_label(key: Column) -> Column:
    return F.try_element_at(literal_map(fv.CATEGORY_LABEL), key)
