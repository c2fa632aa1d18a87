"""Repository URLs, store keys and badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import regex
from toolguard.functions.capabilities import lookup

SSH_PREFIX = "git@github.com:"
HOST_PREFIX = "github.com/"


def normalized(url: Column) -> Column:
    """One spelling per repository; other URLs stay as they are, empty ones are NULL."""
    trimmed = regex.strip(url)
    rest = F.substring(trimmed, F.lit(len(SSH_PREFIX) + 1), F.length(trimmed))
    full = (
        F.when(trimmed.startswith(SSH_PREFIX), F.concat(F.lit("https://github.com/"), rest))
        .when(trimmed.startswith("http://") | trimmed.startswith("https://"), trimmed)
        .when(trimmed.startswith(HOST_PREFIX), F.concat(F.lit("https://"), trimmed))
        .when(trimmed.rlike(regex.java(rules.URL_SHORT)), F.concat(F.lit("https://github.com/"), trimmed))
        .otherwise(trimmed)
    )
    pattern = regex.java(rules.URL_REPO)
    repo = F.regexp_replace(F.regexp_extract(full, pattern, 1), "^http://", "https://")
    return F.when(url != "", F.when(full.rlike(pattern), repo).otherwise(full))


def is_valid(normalized_url: Column) -> Column:
    """True for a normalized URL of a repository."""
    return F.coalesce(normalized_url.rlike(regex.java(rules.URL_VALID)), F.lit(False))


def repo_key(url: Column) -> Column:
    """Key of the result store: no scheme, no trailing slash, no ``.git``, lowercase."""
    key = F.regexp_replace(F.lower(regex.strip(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(key, "/+$", ""), r"\.git$", "")


def text_width(text: Column) -> Column:
    """Estimated pixel width of a badge text."""
    return F.greatest(F.floor(F.length(text) * F.lit(6.5)).cast("int") + 10, F.lit(20))


def badge(score: Column, title: Column) -> Column:
    """Message, color and widths of a badge."""
    message = lookup(score, rules.BADGE_LABELS, rules.BADGE_FALLBACK_LABEL)
    color = lookup(score, rules.BADGE_COLORS, rules.BADGE_COLORS["UNKNOWN"])
    return F.struct(
        message.alias("message"),
        color.alias("color"),
        text_width(title).alias("label_width"),
        text_width(message).alias("message_width"),
        (text_width(title) + text_width(message)).alias("total_width"),
    )
