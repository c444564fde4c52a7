"""Listings from retailers' pages: JSON-LD, microdata, embedded JSON, and prices next to links.

Pages have page_id, url, domain and html. Markup is cut by the lexer of functions/markup.py, which is
linear in a page whatever it holds; blocks, prices and links become rows, and what belongs together is
found by joins and grouping.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, web
from ..functions.text import let
from .chunks import staged
from .listings import deduped, sane

PAGE = ["page_id", "url", "domain"]
#: A strategy with so many rows is trusted; strategies in order of trust.
ENOUGH = 2
STRATEGIES = ("jsonld", "microdata", "embedded-json", "proximity")
#: Characters that a price and its title may lie apart; what a link after the price, and a point of a
#: title's score, weigh in characters.
REACH, AFTER, POINT = 2200, 1.6, 180
MOST_NODES = 100_000
# Listings of a page and strategy, links of a page that may be titles, characters of an item of microdata.
MOST_LISTINGS, MOST_LINKS, MOST_ITEM = 1_000, 5_000, 4_000
#: Characters of a page's tile: above what lies between a link's beginning, its price and what is read around them.
TILE = 6_144
# Currencies, words before a range, words of facets, furniture of cards, product and other addresses.
PRICE = r"(?iu)(\d[\d\x{A0}\x{202F}\x{2009} .,]{2,14}?)[\s\x{A0}\x{202F}\x{2009}]*(?:₸|〒|тг(?!\p{L})|тенге|KZT)"
RANGE = r"(?iu)(?:до|от|from|to|más|свыше|менее|более)\s*$"
FACET = "(?iu)filter|facet|range|slider|vueform|диапазон"
BEFORE_RATE = r"(?iu)(?:рассрочк|кредит|installment|monthly)(?:\s+от|\s+from)?\s*$"
AFTER_RATE = r"(?iu)^[\s()\[\]·,:–—-]*(?:/\s*мес|в\s+месяц|ежемесячно|per\s+month|monthly|по\s+рассрочке)"
FURNITURE = (
    r"(?iu)^(?:нет отзывов|\d+\s*отзыв[A-Za-z0-9_]*|в корзину|купить|купить в кредит|сравнить|в сравнение|в избранное|подробнее|подробно|заказать|"
    r"оформить|показать (?:ещё|еще|все)|все товары|быстрый просмотр|рассрочка|доставка|в наличии|нет в наличии|add to cart|buy now|compare|"
    r"quick view|no reviews|\d+\s*reviews?)$"
)
BAD_LINK = (
    r"(?i)cart|basket|login|register|compare|favou?rite|wishlist|javascript:|#$|\.(?:jpg|png|webp|svg|css|js)$|"
    r"/(?:blog|news|article|articles|category|categories|review|reviews|search|tag)(?:/|[?#]|$)"
)
PRODUCT_LINK = "(?i)/(?:product|products|p|tovar|tovary|item|goods|catalog|shop)/"
CHROME = ("script", "style", "noscript", "nav", "footer", "svg")


def without_chrome(html: Column) -> Column:
    """Markup without elements that carry prices but no products; what is never closed stays."""
    for tag in CHROME:
        html = markup.without_elements(html, tag)
    return html


def absolute(href: Column, base: Column) -> Column:
    """Address of a link on its page's own host; NULL for others, other schemes, user names and what is
    too long. Addresses are tidied (RFC 3986), so that one product has one."""
    return let(
        markup.resolved(href, base),
        lambda url: F.when((web.normalised_domain(url) == web.normalised_domain(base)) & (F.length(url) <= markup.MOST_URL), url),
    )


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of JSON texts in the order they are visited: arrays from the front, members of an object
    from the back. Currency and stock of the objects around come along, nearest first, and the places of
    the named products around."""
    text = lambda x: x if isinstance(x, str) else None if x is None or isinstance(x, (dict, list)) else json.dumps(x)
    first = lambda o, *names: next((o[n] for n in names if o.get(n) is not None), None)
    for b in batches:
        out: dict[str, list] = {n: [] for n in _NODE}
        for row, content in enumerate(b.column("content").to_pylist()):
            try:
                todo = [(json.loads(content), None, (), ())]
            except (ValueError, RecursionError):
                continue
            for pos in range(MOST_NODES):
                if not todo:
                    break
                node, currency, stock, within = todo.pop()
                if isinstance(node, list):
                    todo += [(x, currency, stock, within) for x in reversed(node) if isinstance(x, (dict, list))]
                if not isinstance(node, dict):
                    continue
                kind = node.get("@type")
                currency = text(first(node, "priceCurrency", "currencyCode", "currency")) or currency
                flag = next((node[n] for n in ("inStock", "available") if isinstance(node.get(n), bool)), None)
                said = ("InStock" if flag else "OutOfStock") if flag is not None else text(first(node, "availability", "stockStatus"))
                stock = (said, *stock) if said else stock
                offers = node.get("offers")
                offers = [o for o in (offers[:100] if isinstance(offers, list) else [offers]) if isinstance(o, dict)] or [node]
                out["row"].append(row)
                out["pos"].append(pos)
                product = kind == "Product" or isinstance(kind, list) and "Product" in kind
                out["product"].append(product)
                out["within"].append(list(within))
                if product and isinstance(node.get("name"), str):
                    within = (*within, pos)
                out["name"].append(next((node[n] for n in ("name", "title", "productName") if isinstance(node.get(n), str) and node[n]), None))
                out["own_name"].append(node["name"] if isinstance(node.get("name"), str) else None)
                out["price"].append(text(first(node, "price", "salePrice", "currentPrice", "minPrice", "priceValue")))
                out["old"].append(text(first(node, "oldPrice", "listPrice", "priceOld")))
                out["link"].append(next((node[n] for n in ("url", "slug") if isinstance(node.get(n), str) and node[n]), None))
                out["currency"].append(currency)
                out["stock"].append(list(stock))
                out["offers"].append(
                    [
                        {"price": text(first(o, "price", "lowPrice")), "own": text(o.get("priceCurrency")), "currency": text(first(o, "priceCurrency")) or text(node.get("priceCurrency")),
                         "availability": text(o.get("availability")), "link": text(o.get("url"))}
                        for o in offers
                    ]
                )
                todo += [(v, currency, stock, within) for v in node.values() if isinstance(v, (dict, list))]
        rows = pa.array(out.pop("row"), pa.int32())
        kept = [b.column(c).take(rows) for c in (*PAGE, "block")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, _NODE[n]) for n, v in out.items())], [*PAGE, "block", *out])


_OFFER = pa.struct([(n, pa.string()) for n in ("price", "own", "currency", "availability", "link")])
_NODE = {
    "row": pa.int32(), "pos": pa.int32(), "product": pa.bool_(), "within": pa.list_(pa.int32()), "name": pa.string(), "own_name": pa.string(), "price": pa.string(), "old": pa.string(),
    "link": pa.string(), "currency": pa.string(), "stock": pa.list_(pa.string()), "offers": pa.list_(_OFFER),
}


def json_nodes(pages: DataFrame, kind: str, least: int = 0) -> DataFrame:
    """Objects of the scripts whose attributes match `kind` and whose content is longer than `least`."""
    cut = pages.select(*PAGE, F.posexplode(markup.elements(F.col("html"), "script")).alias("block", "b"))
    cut = cut.select(*PAGE, "block", "b.attributes", F.trim("b.content").alias("content")).where("attributes is not null")
    wanted = cut.where(F.col("attributes").rlike(kind) & (F.length("attributes") <= 4096) & (F.length("content") > least)).drop("attributes")
    offers = "array<struct<price:string,own:string,currency:string,availability:string,link:string>>"
    page = ", ".join(f"{c} {dict(pages.dtypes)[c]}" for c in PAGE)
    schema = (
        f"{page}, block int, pos int, product boolean, within array<int>, name string, own_name string, price string, old string, link string, "
        f"currency string, stock array<string>, offers {offers}"
    )
    return wanted.mapInArrow(_nodes, schema)


def _first_of_page(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each page; a page has a bounded size, so its rows may meet."""
    place = Window.partitionBy("page_id").orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most).drop("_place")


def _listed(rows: DataFrame, via: str, at: Column, title: Column, price: Column, old: Column, link: Column, stock: Column) -> DataFrame:
    rows = rows.select(
        "page_id", "domain", F.lit(via).alias("via"), at.alias("at"), title.alias("title"), price.alias("price"), old.alias("old_price"), link.alias("url"),
        stock.alias("in_stock"),
    )
    return _first_of_page(rows, ["at"], MOST_LISTINGS)


def from_jsonld(pages: DataFrame) -> DataFrame:
    """Products of JSON-LD with their best usable offer: not out of stock, then in tenge by name, then
    cheapest. One without a usable offer hides what it holds."""
    nodes = json_nodes(pages, "(?i)type=[\"']application/ld\\+json[\"']").where("product and own_name is not null")
    best = F.array_min(
        F.filter(
            F.transform(
                "offers",
                lambda o, i: F.struct(
                    web.availability(o["availability"]).eqNullSafe(F.lit(False)).alias("out"),
                    (~F.coalesce(o["own"], F.lit("")).rlike("(?i)^\\s*(?:KZT|₸)\\s*$")).alias("other"),
                    web.parse_price(F.coalesce(o["price"], F.lit(""))).alias("price"),
                    i.alias("i"),
                    web.supports_kzt(o["currency"]).alias("supported"),
                    web.availability(o["availability"]).alias("stock"),
                    o["link"].alias("link"),
                ),
            ),
            lambda c: c["supported"] & (c["price"] > 0),
        )
    )
    judged = staged(nodes.withColumn("best", best).drop("offers", "stock"), "products")
    place = ["page_id", "block", "pos"]
    useless = judged.where("best is null").select("page_id", "block", F.col("pos").alias("outer"))
    inner = judged.where("best is not null and size(within) > 0").select(*place, F.explode("within").alias("outer"))
    hidden = inner.join(useless, ["page_id", "block", "outer"], "left_semi").select(*place)
    rows = judged.where("best is not null").join(hidden, place, "left_anti")
    link = absolute(F.coalesce("link", "best.link"), F.col("url"))
    no = F.lit(None).cast("long")
    at = F.struct(F.col("block").cast("long").alias("a"), F.col("pos").cast("long").alias("b"))
    return _listed(rows, "jsonld", at, web.strip_tags(F.col("own_name")), F.col("best.price"), no, link, F.col("best.stock"))


def from_embedded(pages: DataFrame) -> DataFrame:
    """Records of embedded JSON with a name and a price above 100; currency and stock may be those of an
    object around."""
    nodes = json_nodes(pages, "(?i)id=[\"']__NEXT_DATA__[\"']|type=[\"']application/json[\"']", 200)
    rows = nodes.where(F.col("name").isNotNull() & F.col("price").isNotNull() & web.supports_kzt(F.col("currency")))
    price = web.parse_price(F.col("price"))
    stock = F.get(F.filter(F.transform("stock", web.availability), lambda x: x.isNotNull()), F.lit(0))
    at = F.struct(F.col("block").cast("long").alias("a"), F.col("pos").cast("long").alias("b"))
    return _listed(rows.where(price > 100), "embedded-json", at, web.strip_tags(F.col("name")), price, web.parse_price(F.col("old")), absolute(F.col("link"), F.col("url")), stock)


def from_microdata(pages: DataFrame) -> DataFrame:
    """Items of microdata with a name and a price; one with more than MOST_ITEM characters after its type is
    left out. A price's attribute counts if it is made of digits, commas and dots, else the text in its
    element."""
    item = "itemtype=[\"'][^\"']{0,500}/Product[\"']"
    cut = pages.select(*PAGE, F.posexplode(F.slice(F.split("html", f"(?i)(?={item})"), F.lit(1), F.lit(1 << 30))).alias("n", "b"))
    cut = cut.where(F.col("b").rlike(f"(?i)^{item}") & (F.length("b") - F.length(F.regexp_extract("b", f"(?i)^{item}", 0)) <= MOST_ITEM))

    def prop(name: str, written: str = "[^\"']+") -> Column:
        head = rf"(?is)itemprop=[\"']{name}[\"'][^>]*"
        said = F.regexp_extract("b", head + f"content=[\"']({written})[\"']", 1)
        return F.nullif(F.when(said != "", said).otherwise(F.regexp_extract("b", head + ">([^<]+)<", 1)), F.lit(""))

    price, name = web.parse_price(prop("price", "[\\d.,]+")), web.strip_tags(prop("name"))
    rows = cut.where((price > 0) & name.isNotNull() & web.supports_kzt(web.strip_tags(prop("priceCurrency"))))
    link = F.nullif(F.regexp_extract("b", "(?is)<a\\b[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    at = F.struct(F.col("n").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return _listed(rows, "microdata", at, name, price, F.lit(None).cast("long"), absolute(link, F.col("url")), web.availability(F.col("b")))


def _placed(found: DataFrame, gap: str, whole: str) -> DataFrame:
    """found (page_id, n, ...) with start: matches in turn, `gap` characters after the one before."""
    before = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col(gap) + F.coalesce(F.length(whole), F.lit(0))
    return found.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col(gap))


def tiles(pages: DataFrame) -> DataFrame:
    """(page_id, tile, text): pages cut into pieces of TILE characters, each with the pieces before and
    after it, so that what lies around a place is read from one row and not from the page's head."""
    cut = F.regexp_extract_all("html", F.lit(rf"(?s).{{1,{TILE}}}"), F.lit(0))
    around = lambda x, i: F.concat(
        F.coalesce(F.when(i > 0, F.get(F.col("cut"), i - 1)), F.lit("")), x, F.coalesce(F.get(F.col("cut"), i + 1), F.lit(""))
    )
    return pages.select("page_id", cut.alias("cut")).select("page_id", F.posexplode(F.transform("cut", around)).alias("tile", "text"))


def _piece(start: Column, end: Column) -> Column:
    """Characters from start to end (places in the page) of the row's text around its tile."""
    first = F.greatest(F.col("tile") - 1, F.lit(0)) * TILE
    lo = F.greatest(start - first, F.lit(0))
    return F.substr(F.col("text"), (lo + 1).cast("int"), F.greatest(end - first - lo, F.lit(0)).cast("int"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, n, start, end, href, text) of the closed links of pages, chrome included: as they are
    written, href NULL where there is none, text without tags. Links with more than 2,000 characters of
    attributes or 400 of content are left out."""
    found = pages.select("page_id", "url", F.posexplode(markup.elements(F.col("html"), "a")).alias("n", "x")).select("page_id", "url", "n", "x.*")
    placed = _placed(found, "gap", "whole").where("attributes is not null and unclosed = ''")
    short = (F.length("attributes") <= 2000) & (F.length("content") <= 400)
    href = F.nullif(F.regexp_extract("attributes", "(?i)href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return placed.where(short).select(
        "page_id", "url", "n", "start", (F.col("start") + F.length("whole")).alias("end"), href.alias("href"), web.strip_tags(F.col("content")).alias("text")
    )


def plausible(title: Column) -> Column:
    words = F.size(F.split(title, r"\s+"))
    model = title.rlike(r"^(?=[\p{L}\p{N}._+-]*\p{L})(?=[\p{L}\p{N}._+-]*\d)[\p{L}\p{N}._+-]+$")
    plain = F.length(title).between(3, 220) & title.rlike(r"\p{L}") & ~title.rlike(r"^\d[\d\s.,₸〒]*$") & ~title.rlike(FURNITURE)
    return plain & ((words >= 2) | model)


def title_score(title: Column, href: Column) -> Column:
    """How much a link reads like a product's title; its points and bounds, as those of plausible(), are fixed values."""
    words = F.size(F.split(title, r"\s+"))
    return (
        F.when(href.rlike(PRODUCT_LINK), 3.0).otherwise(0.0)
        + F.when(href.rlike("(?i)[a-z0-9]+(?:-[a-z0-9]+){2,}"), 2.0).otherwise(0.0)
        + F.when(words >= 3, 2.0).when(words == 2, 0.5).otherwise(0.0)
        + F.when(title.rlike(r"\d"), 1.0).otherwise(0.0)
        + F.when(F.length(title) >= 25, 1.0).otherwise(0.0)
    )


def _prices(clean: DataFrame, tiled: DataFrame) -> DataFrame:
    """(page_id, tile, start, stop, price, old) of the prices to pay: no facets, ranges or rates."""
    surface = F.concat("surface", F.lit(""))
    found = F.arrays_zip(
        F.transform(F.split(surface, PRICE), F.length).alias("gap"),
        F.regexp_extract_all(surface, F.lit(PRICE), F.lit(0)).alias("m"),
        F.regexp_extract_all(surface, F.lit(PRICE), F.lit(1)).alias("raw"),
    )
    rows = clean.select("page_id", markup.masked(F.col("html")).alias("surface")).select("page_id", F.posexplode(found).alias("n", "x"))
    prices = _placed(rows.select("page_id", "n", "x.*"), "gap", "m").where("m is not null")
    last = Window.partitionBy("page_id").orderBy("start")
    price = web.parse_price(F.col("raw"))
    prices = prices.select(
        "page_id", "start", (F.col("start") + F.length("m")).alias("stop"), price.alias("price"), F.floor(F.col("start") / TILE).cast("int").alias("tile")
    ).withColumn("old", F.when(F.lag("start").over(last) >= F.col("start") - 260, F.lag("price").over(last)))
    near = prices.where(F.col("price").between(300, 200_000_000)).join(tiled.hint("merge"), ["page_id", "tile"])
    start, stop = F.col("start"), F.col("stop")
    faceted = let(_piece(start - 220, start), lambda head: web.strip_tags(head).rlike(RANGE) | head.rlike(FACET))
    before, after = web.strip_tags(_piece(start - 100, start)), web.strip_tags(_piece(stop, stop + 100))
    fine = ~faceted & ~before.rlike(BEFORE_RATE) & ~after.rlike(AFTER_RATE)
    return near.where(fine).select("page_id", "tile", "start", "stop", "price", "old")


def _title_links(clean: DataFrame) -> DataFrame:
    """(page_id, start, end, href, text, score) of the first MOST_LINKS links of a page that may be titles."""
    links = page_links(clean).where(F.col("href").isNotNull() & ~F.col("href").rlike(BAD_LINK))

    def titled(text: Column) -> Column:
        as_title = lambda href: F.when(href.isNotNull(), F.struct(href.alias("href"), text.alias("text"), title_score(text, href).alias("score")))
        return F.when(plausible(text), let(absolute(F.col("href"), F.col("url")), as_title))

    # a generator's rows: a filter on them isn't pushed down, so that a link's text and address are read once
    title = F.explode(F.array_compact(F.array(let(F.col("text"), titled)))).alias("title")
    return _first_of_page(links.select("page_id", "start", "end", title).select("page_id", "start", "end", "title.*"), ["start"], MOST_LINKS)


def from_proximity(pages: DataFrame) -> DataFrame:
    """Prices with the link within REACH that is near and reads like a title: a band join of offsets by
    buckets. The price before, if higher, is the old one; of a link the lowest price stays.

    A page's text goes into tiles once; prices and chosen pairs read what lies around them from those.
    Joins are merges by hint: files of pages are so much smaller than their rows that Spark would
    broadcast what doesn't fit a driver.
    """
    clean = staged(pages.select(*PAGE, without_chrome(F.col("html")).alias("html")), "clean")
    tiled = staged(tiles(clean), "tiles")
    prices, links = staged(_prices(clean, tiled), "prices"), _title_links(clean)
    bucket = lambda c: F.floor(F.col(c) / REACH)
    spots = prices.withColumn("bucket", F.explode(F.sequence(bucket("start") - 3, bucket("start") + 1)))
    a = links.select("page_id", bucket("start").alias("bucket"), F.struct("start", "end", "href", "text", "score").alias("a"))
    pairs = spots.join(a.hint("merge"), ["page_id", "bucket"]).where((F.col("a.end") >= F.col("start") - REACH) & (F.col("a.start") <= F.col("start") + REACH))
    gap = F.when(F.col("a.end") <= F.col("start"), F.col("start") - F.col("a.end")).otherwise((F.col("a.start") - F.col("start")) * AFTER)
    cost = pairs.where((F.col("a.end") <= F.col("start")) | (F.col("a.start") >= F.col("start"))).withColumn("cost", gap - F.col("a.score") * POINT)
    best = cost.groupBy("page_id", "tile", "start", "stop", "price", "old").agg(F.min_by("a", F.struct("cost", F.col("a.start"))).alias("a"))
    best = _first_of_page(best, ["start"], MOST_LISTINGS)
    row = F.struct("tile", "start", "stop", "price", "old", "a")
    first = best.groupBy("page_id", F.col("a.href").alias("_href")).agg(F.min_by(row, F.struct("price", "start")).alias("x"))
    rows = first.select("page_id", "x.*").join(tiled.hint("merge"), ["page_id", "tile"])
    stock = web.availability(_piece(F.least(F.col("a.start"), F.col("start")) - 100, F.greatest(F.col("a.end"), F.col("stop")) + 160))
    at = F.struct(F.col("start").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    old = F.when(F.col("old") > F.col("price"), F.col("old"))
    rows = rows.join(clean.select("page_id", "domain").hint("merge"), "page_id")
    return _listed(rows, "proximity", at, F.col("a.text"), F.col("price"), old, F.col("a.href"), stock)


def extract_listings(pages: DataFrame) -> DataFrame:
    """(page_id, domain, via, at, title, price, old_price, url, in_stock): of each page the rows of the
    first strategy with ENOUGH, else of the one with most.

    NULL and empty pages give no rows; page_id names a page. Broken JSON is no block. A product without
    a usable offer is none and hides what it holds. At most MOST_LISTINGS rows of a page and strategy count.
    """
    found = None
    for rank, read in enumerate((from_jsonld, from_microdata, from_embedded, from_proximity)):
        rows = staged(sane(read(pages)).withColumn("rank", F.lit(rank)), "listed")
        found = rows if found is None else found.unionByName(rows)
    place = F.struct("page_id", "rank", "at")
    keyed = found.withColumn("place", place).withColumn("url_", F.col("url")).withColumn("url", F.concat_ws(" ", F.col("page_id").cast("string"), "via", F.coalesce("url", F.lower("title"))))
    rows = deduped(keyed, "place").withColumn("url", F.col("url_")).drop("url_", "place")
    counts = rows.groupBy("page_id", "rank").agg(F.count("*").alias("n"))
    trust = F.struct(F.when(F.col("n") >= ENOUGH, 0).otherwise(1).alias("weak"), F.when(F.col("n") < ENOUGH, -F.col("n")).alias("few"), "rank")
    chosen = counts.groupBy("page_id").agg(F.min(trust).alias("t")).select("page_id", F.col("t.rank").alias("rank"))
    return rows.join(chosen, ["page_id", "rank"], "left_semi").drop("rank")


def listings_by_domain(pages: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Columns of extract_listings, read by the parser of a page's domain where it has one.

    A parser takes pages and gives (page_id, at, title, price, old_price, url, in_stock), at a number. A page of which it
    makes nothing is read like any other, so one that its retailer has redesigned still gives rows. Pages
    of a domain without a parser, or of none, don't pass the join that finds this out; parsers are few.
    """
    if not parsers:
        return extract_listings(pages)
    known = F.coalesce(F.col("domain").isin(*parsers), F.lit(False))
    own = None
    for domain, read in parsers.items():
        rows = read(pages.where(F.col("domain") == domain)).withColumns({"domain": F.lit(domain), "via": F.lit("parser")})
        own = rows if own is None else own.unionByName(rows)
    own = own.withColumn("at", F.struct(F.col("at").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    own = staged(own.select("page_id", "domain", "via", "at", "title", "price", "old_price", "url", "in_stock"), "parsed")
    unread = pages.where(known).join(own.select("page_id").distinct(), "page_id", "left_anti").select(pages.columns)
    return own.unionByName(extract_listings(pages.where(~known).unionByName(unread)).select(own.columns))
