"""Does a listing sell what was asked for? A ladder of rejections, then a confidence."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .query import Request, capacities, stems
from .text import has, java, let, named_in, normalise, signatures, tokens_of


def _any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def _bundled(title: Column, source: str, ask: Request) -> Column:
    """The accessory comes with the thing asked for, which the title names first."""
    before = F.regexp_extract(title, rf"^(?s)(.+?){java(source)}", 1)
    named = _any_of([has(before, re.escape(t) + "$") for t in ask.tokens])
    return title.rlike(f"(?iu){V.BUNDLED}") & (before != "") & named


def _prefix_of(token: str) -> Callable[[Column], Column]:
    return lambda t: (t.startswith(token) | F.lit(token).startswith(t)) & (F.least(F.length(t), F.lit(len(token))) >= 4)


def _attached(variant: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(rf"\d{variant}$|^{variant}\d")


def coverage(tokens: Column, signs: Column, asked: tuple[str, ...]) -> Column:
    """Share of the asked tokens that a title has: alone or joined with a neighbour 1, as a prefix
    relation of four characters or more 0.75."""
    total = F.lit(0.0)
    for i, token in enumerate(asked):
        joined = [asked[k] + asked[k + 1] for k in (i - 1, i) if 0 <= k < len(asked) - 1]
        whole = _any_of([F.array_contains(signs, s) for s in [token, *joined]])
        near = F.exists(tokens, _prefix_of(token))
        total = total + F.when(whole, 1.0).when(near, 0.75).otherwise(0.0)
    return total / len(asked)


def _ladder(ask: Request, title: Column, low: Column, tokens: Column, signs: Column, brands: Column, cover: Column) -> Column:
    """(before, after, confidence) of a title: the first rule that rejects it names the reason, of those
    that come before the bounds on the price and of those after."""
    category = ask.category or "other"
    rules: list[tuple[Column, Column]] = []

    def reject(when: Column, why: Column | str) -> None:
        rules.append((when, F.lit(why) if isinstance(why, str) else why))

    reject(F.length(title) < 3, "title too short")
    if ask.accessory is None:
        for label, (source, _) in V.ACCESSORIES.items():
            found = has(low, source)
            if label in V.BUNDLED_LABELS and ask.tokens:
                found = found & ~_bundled(low, source, ask)
            reject(found, f"accessory: {label}")
    else:
        reject(~has(low, V.ACCESSORIES[ask.accessory][0]), f"not the requested {ask.accessory}")
    for label, (source, asked) in V.CONDITIONS.items():
        if not stems(asked).search(ask.raw):
            reject(has(low, source), label)
    if ask.brand and category != "component":
        reject((F.size(brands) > 0) & ~F.array_contains(brands, ask.family), f"wrong brand (wanted {ask.brand})")
    elif ask.brand and ask.family in V.COMPONENT_FAMILIES:
        others = [b for b in V.COMPONENT_FAMILIES if b != ask.family]
        reject(_any_of([F.array_contains(brands, b) for b in others]), f"wrong component family (wanted {ask.brand})")
    early = len(rules)
    for i, token in enumerate(ask.tokens):
        if any(c.isdigit() for c in token):
            forms = [token] + ([ask.tokens[i - 1] + token] if i else [])
            reject(~_any_of([F.array_contains(signs, f) for f in forms]), f'missing model identifier "{token}"')
    wanted = [t for t in ask.tokens if t in V.VARIANTS]
    for v in wanted:
        reject(~(F.array_contains(tokens, v) | F.exists(tokens, _attached(v))), f'missing variant "{v}"')
    if category == "smartphone" and any(c.isdigit() for t in ask.tokens for c in t):
        odd = F.filter(tokens, lambda t: t.isin(*(v for v in V.STRICT_VARIANTS if v not in wanted)))
        reject(F.size(odd) > 0, F.concat(F.lit('unexpected variant "'), F.get(odd, F.lit(0)), F.lit('"')))
    confidence = F.lit(0.4)
    if ask.tokens:
        reject(cover < 0.66, "title does not match query")
        confidence = 0.5 + 0.4 * cover
        for name, label, want, more, less in (("storage", "storage", ask.storage, 0.1, 0.1), ("ram", "RAM", ask.ram, 0.05, 0.08)):
            if want is not None:
                have = F.col(f"_size.{name}")
                reject(F.coalesce(have != want, F.lit(False)), F.format_string(f"wrong {label} (%dGB, wanted {want}GB)", have))
                confidence = F.when(have.isNull(), confidence - less).otherwise(F.least(F.lit(1.0), confidence + more))
        if ask.brand:
            confidence = confidence - F.when(F.array_contains(brands, ask.family), 0.0).otherwise(0.08)

    def first(some: list[tuple[Column, Column]]) -> Column:
        reason = F.when(F.lit(False), F.lit(""))
        for when, why in some:
            reason = reason.when(when, why)
        return reason

    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.struct(first(rules[:early]).alias("before"), first(rules[early:]).alias("after"), sure.alias("confidence"))


def judged_titles(titles: DataFrame, ask: Request) -> DataFrame:
    """(_title, before, after, confidence) of each row of titles (_title).

    Capacities are read only if the request states one.
    """
    title = F.trim("_title")
    sized = ask.tokens and (ask.storage is not None or ask.ram is not None)
    frame = titles.withColumn("_size", capacities(title, ask.category)) if sized else titles
    no_cover = F.lit(0.0)

    def with_cover(r: Column) -> Column:
        cover = coverage(r["tokens"], r["signs"], ask.tokens) if ask.tokens else no_cover
        return let(cover, lambda c: _ladder(ask, title, r["low"], r["tokens"], r["signs"], r["brands"], c))

    def with_signs(r: Column) -> Column:
        brands = named_in(r["low"]) if ask.brand else F.array().cast("array<string>")
        parts = F.struct(r["low"].alias("low"), r["tokens"].alias("tokens"), signatures(r["tokens"]).alias("signs"), brands.alias("brands"))
        return let(parts, with_cover)

    judged = let(
        F.lower(normalise(title)), lambda low: let(F.struct(low.alias("low"), tokens_of(low).alias("tokens")), with_signs)
    )
    # as a generator's column, which filters stay above: the ladder is gone through once a title
    return frame.select("_title", F.explode(F.array(judged)).alias("j")).select("_title", "j.before", "j.after", F.col("j.confidence").alias("_sure"))


def match(listings: DataFrame, ask: Request) -> DataFrame:
    """listings (title, price, ...) with confidence, rejected and reject_reason.

    All but the price is a matter of the title, so each distinct title is judged once and its verdict
    joined. A NULL title is too short; a NULL price is neither too low nor too high.
    """
    category = ask.category or "other"
    floor, ceiling, _ = V.CATEGORIES[category]
    keyed = listings.withColumn("_title", F.coalesce("title", F.lit("")))
    verdicts = judged_titles(keyed.select("_title").distinct(), ask)
    low = F.when(F.col("price") < (V.ACCESSORY_FLOOR if ask.accessory else floor), f"price below {category} floor")
    price = low.when(F.col("price") > ceiling, f"price above {category} ceiling")
    rejected = F.col("reject_reason").isNotNull()
    return keyed.join(verdicts, "_title").withColumn("reject_reason", F.coalesce("before", price, "after")).withColumns(
        {"rejected": rejected, "confidence": F.when(rejected, 0.0).otherwise(F.col("_sure"))}
    ).drop("_title", "before", "after", "_sure")


def accepted(matched: DataFrame) -> DataFrame:
    return matched.where(~F.col("rejected") & (F.col("confidence") >= V.MIN_CONFIDENCE))
