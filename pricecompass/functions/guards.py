"""Requests before they are read: their client, their size and kind; and how failures are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import web
from .answers import stripped

# Limits of a request's body, and what a shopper reads of a failure.
BODY_BYTES, BODY_MS = 4 * 1024, 5_000
FAILURE_LABEL = {
    "blocked": "blocks bots", "unreachable": "unreachable", "no-search-endpoint": "no readable search", "js-rendered": "needs JavaScript",
    "no-listings": "nothing found", "no-match": "no matches", "unsafe-url": "invalid website", "response-too-large": "page too large",
    "timeout": "timed out",
}
ANONYMOUS = "anonymous"


def is_ip(text: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address (of the latter, those written in groups alone)."""
    group = "[0-9A-Fa-f]{1,4}"
    some = f"(?:{group}(?::{group})*)?"
    full = text.rlike(f"^(?:{group}:){{7}}{group}$")
    gap = text.rlike(f"^{some}::{some}$") & (F.size(F.filter(F.split(text, ":"), lambda x: x != "")) <= 7)
    return F.coalesce(web.ipv4_number(text).isNotNull() | full | gap, F.lit(False))


def client_key(*headers: Column) -> Column:
    """The first address that the trusted headers, in their order, name first; else "anonymous"."""
    named = (stripped(F.get(F.split(h, ","), F.lit(0))) for h in headers)
    return F.coalesce(*(F.when(is_ip(n), n) for n in named), F.lit(ANONYMOUS))


def request_status(content_type: Column, declared: Column, body: Column, took_ms: Column) -> Column:
    """HTTP status of a request that can't be read, NULL for one that can; the first reason counts."""
    kind = stripped(F.get(F.split(content_type, ";"), F.lit(0)))
    text = stripped(declared)
    size = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    whole = F.coalesce((size >= 0) & (size == F.floor(size)), F.lit(False))
    return (
        F.when(~F.coalesce(kind.rlike(r"(?i)^application/(?:json|[\w.+-]+\+json)$"), F.lit(False)), 415)
        .when(declared.isNotNull() & ~whole, 400)
        .when(size > BODY_BYTES, 413)
        .when(body.isNull(), 400)
        .when(took_ms > BODY_MS, 408)
        .when(F.octet_length(body) > BODY_BYTES, 413)
        .when(F.try_parse_json(body).isNull(), 400)
    )


def failure_label(failure: Column) -> Column:
    """What a shopper reads of a failure; NULL for one that isn't known."""
    return F.get(F.array(*map(F.lit, FAILURE_LABEL.values())), F.array_position(F.array(*map(F.lit, FAILURE_LABEL)), failure).cast("int") - 1)
