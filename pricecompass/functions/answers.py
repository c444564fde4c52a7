"""Answers of a language model, which may fill gaps and phrase a verdict but not invent facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import let

# Limits of a verdict, how numbers and money read, what must be said of stock.
VERDICT_CHARS, VERDICT_WORDS, COMPARED = 320, 50, 6
BLANK = r"[\s\p{Z}]"
NUMBER = r"(\d{1,3}(?:[\s\p{Z}.,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
MONEY = rf"(?iu){NUMBER}[\s\p{{Z}}]*(?:₸|KZT|тенге)"
SAYS_OUT = "(?i)out of stock|unavailable"
SAYS_UNKNOWN = "(?i)unverified|unknown|confirm|verify"
#: Most storage and memory, in gigabytes, that an answer may state.
MOST_STORAGE, MOST_RAM = 16_384, 512


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def json_object(answer: Column) -> Column:
    """The object in an answer, fenced or between its outer braces, as a VARIANT; NULL without one."""
    fenced = "(?is)```(?:json)?(.*?)```"
    text = F.when(answer.rlike(fenced), F.regexp_extract(answer, fenced, 1)).otherwise(answer)

    def cut(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substr(t, first, last - first + 1))

    return F.try_parse_json(let(text, cut))


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def _text(v: Column, name: str) -> Column:
    value = F.lower(stripped(F.try_variant_get(v, f"$.{name}", "string")))
    return F.when((_kind(v, name) == "STRING") & (value != ""), value)


def _whole(v: Column, name: str, most: int) -> Column:
    n = F.try_variant_get(v, f"$.{name}", "double")
    return F.when(_kind(v, name).rlike("^(?:BIGINT|DOUBLE|DECIMAL)") & (n > 0) & (n <= most) & (n == F.floor(n)), n.cast("int"))


def enriched(base: dict[str, Column], answer: Column) -> dict[str, Column]:
    """base (search_term, brand, model, storage_gb, ram_gb, category, required_tokens) with gaps filled
    from an answer: strings lower-case, whole sizes within bounds, known categories. A search term
    counts if it has every required token. via tells whether there was an object to fill from."""
    v = json_object(answer)
    term = _text(v, "searchTerm")
    words = F.split(F.regexp_replace(term, r"([\p{L}\p{N}])\+", "$1 plus "), r"[^\p{L}\p{N}]+")
    whole = F.forall(base["required_tokens"], lambda t: F.array_contains(words, F.replace(t, F.lit("+"), F.lit("plus"))))
    said = F.try_variant_get(v, "$.category", "string")
    category = F.when(said.isin(*V.CATEGORIES), said)
    return {
        "search_term": F.when(term.isNotNull() & whole, term).otherwise(base["search_term"]),
        "brand": F.coalesce(base["brand"], _text(v, "brand")),
        "model": F.coalesce(base["model"], _text(v, "model")),
        "storage_gb": F.coalesce(base["storage_gb"], _whole(v, "storageGb", MOST_STORAGE)),
        "ram_gb": F.coalesce(base["ram_gb"], _whole(v, "ramGb", MOST_RAM)),
        "category": F.coalesce(base["category"], category),
        "via": F.when(v.isNull(), "rules").otherwise("llm"),
    }


def numbers(text: Column) -> Column:
    """Digits of each number of a text, its thousands joined."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda n: F.regexp_replace(n, r"\D", ""))


def _plain(n: Column) -> Column:
    """A number as it is written: no decimals where there are none."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def grounded(answer: Column, deals: Column) -> Column:
    """Whether a verdict names the best shop and its price, and no other number than its deals hold.

    deals: at most six structs (name, title, price, in_stock, and km, minutes, travel, time_cost, total,
    NULL where there is no trip), best first. Numbers said to be money must be prices, parts of a cost
    or gaps between totals. Stock that is missing or unknown must be said to be. NULL or no deals: false.
    """
    deals = F.slice(deals, 1, COMPARED)
    best = F.get(deals, F.lit(0))
    whole = lambda n: F.round(n).cast("long").cast("string")
    money = F.flatten(
        F.transform(
            deals,
            lambda d: F.array(*map(whole, (d["price"], d["travel"], d["time_cost"], d["total"], d["travel"] + d["time_cost"]))),
        )
    )
    gaps = F.flatten(F.transform(deals, lambda a: F.transform(deals, lambda b: whole(F.abs(a["total"] - b["total"])))))
    # a total less itself is a gap of nothing, which only two equal totals may state
    totals = F.filter(F.transform(deals, lambda d: d["total"]), lambda t: t.isNotNull())
    tie = F.size(totals) > F.size(F.array_distinct(totals))
    gaps = F.filter(gaps, lambda g: (g != "0") | tie)
    stated = F.flatten(
        F.transform(
            deals,
            lambda d: F.flatten(F.array(*(numbers(F.coalesce(x, F.lit(""))) for x in (d["name"], d["title"], _plain(d["km"]), _plain(d["minutes"]))))),
        )
    )
    claims = F.transform(F.regexp_extract_all(answer, F.lit(MONEY), F.lit(1)), lambda n: F.regexp_replace(n, r"\D", ""))
    sums = F.array_compact(F.concat(money, gaps))
    said = numbers(answer)
    fine = (
        (F.length(answer) <= VERDICT_CHARS)
        & (F.size(F.split(stripped(answer), f"{BLANK}+")) <= VERDICT_WORDS)
        & F.contains(F.lower(answer), F.lower(best["name"]))
        & F.array_contains(said, whole(best["price"]))
        & (F.size(F.array_except(said, F.concat(sums, stated))) == 0)
        & (F.size(F.array_except(claims, sums)) == 0)
        & (F.coalesce(best["in_stock"], F.lit(True)) | answer.rlike(SAYS_OUT))
        & (best["in_stock"].isNotNull() | answer.rlike(SAYS_UNKNOWN))
    )
    return F.coalesce(fine, F.lit(False))
