"""What a shopper reads beside deals: the discount, doubts about a match, an empty result, what was covered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this confidence a match is doubted; the texts of this module are fixed as well, they are what is shown.
DOUBTED = 0.6


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def discount_badge(price: Column, old_price: Column) -> Column:
    """The discount in whole percent, however small; NULL where the old price isn't higher or isn't known."""
    return F.when(old_price > price, _said("−", F.floor((1 - price / old_price) * 100 + 0.5), "%"))


def low_confidence_hint(confidence: Column) -> Column:
    """Doubt about a weak match; NULL for others."""
    percent = F.floor(confidence * 100 + 0.5)
    return F.when(confidence < DOUBTED, _said("Low match confidence (", percent, "%) — this may be a different variant."))


def shown_time(ms: Column) -> Column:
    """Milliseconds under a second, else seconds with one decimal, half up."""
    return F.when(ms < 1000, _said(ms, " ms")).otherwise(F.format_string("%.1fs", ms / 1000))


def empty_text(verdict: Column, domains: Column, listings: Column, request: Column) -> Column:
    """Why no product is shown: the verdict, or what was checked in vain."""
    return F.coalesce(
        verdict,
        _said(
            "Checked ", domains, " retailer site", _plural(domains), " near you and read ", listings, " listing", _plural(listings),
            ', but none matched "', F.coalesce(request, F.lit("")), '".',
        ),
    )


def coverage_text(stores: Column, domains: Column, took_ms: Column, listings: Column, matched: Column) -> Column:
    """The footnote on what a search covered."""
    return _said(
        "Searched ", stores, " mapped shop", _plural(stores), " across ", domains, " retailer site", _plural(domains), " in ", shown_time(took_ms),
        ". Read ", listings, " listing", _plural(listings), ", ", matched, " matched after filtering out accessories and other models.",
    )
