"""Extraction queries: pages written from part, whose listings must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, web
from ..functions.text import quoted
from ..operators import extraction
from ..sources import bindings as B
from .search import ORACLES, QUERIES, registered  # noqa: F401

#: Products on a page.
ON_PAGE = 10
_SHOP = "https://shop.example"


def _pages(spark, sf_dir, product: Column, before: str, between: str, after: str) -> DataFrame:
    """A page for each ON_PAGE parts."""
    rows = B.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / ON_PAGE).alias("page_id"), "p_partkey", product.alias("x"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "x"))), lambda s: s["x"]), between)
    rows = B.spread(rows, "page_id").groupBy("page_id").agg(F.concat(F.lit("<html><body>" + before), html, F.lit(after + "</body></html>")).alias("html"))
    return rows.select("page_id", F.lit(_SHOP + "/search").alias("url"), F.lit("shop.example").alias("domain"), "html")


def _text(form: str) -> Column:
    """A product's markup: {k} key, {t} title, {p} price in whole tenge."""
    price = (F.round("p_retailprice").cast("long") * 100).cast("string")
    out = F.lit(form)
    for name, value in (("{k}", F.col("p_partkey").cast("string")), ("{t}", F.concat("p_brand", F.lit(" "), "p_name")), ("{p}", price)):
        out = F.replace(out, F.lit(name), value)
    return out


def _want(via: str, old: str = "NULL::BIGINT", stock: str = "NULL::BOOLEAN", price: str = "round(p_retailprice)::BIGINT * 100") -> str:
    return f"""SELECT p_partkey // {ON_PAGE} AS page_id, '{via}' AS via, p_brand || ' ' || p_name AS title, {price} AS price, {old} AS old_price,
  '{_SHOP}/product/' || p_partkey AS url, {stock} AS in_stock FROM part"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "via", "title", "price", "old_price", "url", "in_stock")


#: A product with offers of all kinds, and one without a usable offer, which hides the one it holds.
JSONLD = """{"@type": "Product", "name": "no offer", "offers": [], "isRelatedTo": {"@type": "Product", "name": "hidden {k}", "offers": {"price": 500}}},
  {"@type": ["Thing", "Product"], "name": "{t}", "url": "./x/../product/{k}", "offers": [{"price": "1.00", "priceCurrency": "USD"},
  {"price": "{p}.00", "priceCurrency": "KZT", "availability": "https://schema.org/InStock"}, {"price": "1", "priceCurrency": "KZT", "availability": "OutOfStock"}]}"""


def jsonld_pages(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, _text(JSONLD), '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [', ",", "]}</script>")


@registered(_want("jsonld", stock="true"))
def jsonld_roundtrip(spark, sf_dir):
    return _shown(extraction.from_jsonld(jsonld_pages(spark, sf_dir)))


#: A product whose price is in an attribute or, where that says more than a number, in the text.
MICRODATA = """<div itemscope itemtype="https://schema.org/Product"><a href="/product/{k}"><span itemprop="name">{t}</span></a>
%s<meta itemprop="priceCurrency" content="KZT">нет в наличии</div>"""
MICRODATA_PRICES = ('<meta itemprop="price" content="{p}">', '<b itemprop="price" content="from 1 tenge">{p} ₸</b>')
#: A product that goes on for too long, and one in another currency.
NOT_ITEMS = (
    """<div itemtype="https://schema.org/Product"><b itemprop="name">too long</b><b itemprop="price">5000</b>"""
    + "x" * extraction.MOST_ITEM
    + """</div><div itemtype='https://schema.org/Product'><b itemprop="name">dear one</b><b itemprop="price">500</b><i itemprop="priceCurrency">USD</i></div>"""
)


def microdata_pages(spark, sf_dir) -> DataFrame:
    forms = [_text(MICRODATA % price) for price in MICRODATA_PRICES]
    return _pages(spark, sf_dir, F.when(F.col("p_partkey") % 2 == 0, forms[0]).otherwise(forms[1]), NOT_ITEMS, "\n", "")


@registered(_want("microdata", stock="false"))
def microdata_roundtrip(spark, sf_dir):
    return _shown(extraction.from_microdata(microdata_pages(spark, sf_dir)))


EMBEDDED = '{"id": {k}, "title": "{t}", "pricing": {"note": 1}, "price": {p}, "oldPrice": "{p}5", "slug": "/product/{k}"}'


@registered(_want("embedded-json", old="(round(p_retailprice)::BIGINT * 1000 + 5)", stock="true"))
def embedded_roundtrip(spark, sf_dir):
    head = '<script id="__NEXT_DATA__" type="application/json">{"currency": "KZT", "inStock": true, "items": ['
    return _shown(extraction.from_embedded(_pages(spark, sf_dir, _text(EMBEDDED), head, ",", f'], "pad": "{"x" * 200}"}}</script>')))


#: Cards one after the other, each within reach of its neighbours' prices: quoted ">", furniture, an old price, a rate.
CARD = """<div class="card" data-note="a > b"><a href="./product/{k}" title='{t} > "more"'><b>{t}</b></a><a href="/r/{k}">Нет отзывов</a>
<s>{p}9 ₸</s> <span>{p}</span>&#x202f;₸ <i>в наличии</i><em>Рассрочка от {p} ₸ в месяц</em>""" + '<i title="x">.</i>' * 12 + "</div>"
#: Menu and facets before the cards, whose prices aren't for sale.
FACETS = (
    """<nav title="a > b"><a href="/product/0">menu of this shop</a> 5 000 ₸</nav><div class="facet-wrapper slider"><span>50 000 ₸</span> - <span>90 000 ₸</span>"""
    """<i>до 10 000 ₸</i></div>"""
    + " " * 230
)


def card_pages(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, _text(CARD), FACETS, "\n", "")


@registered(_want("proximity", old="(round(p_retailprice)::BIGINT * 1000 + 9)", stock="true"))
def proximity_roundtrip(spark, sf_dir):
    return _shown(extraction.from_proximity(card_pages(spark, sf_dir)))


_INSIDE_RE2 = """(?:[\\s/](?:[^>"\'\']|"[^"]*"|\'\'[^\'\']*\'\')*)?"""
_A_RE2 = f"(?is)<a({_INSIDE_RE2})>(.*?)</a{_INSIDE_RE2}>"


def _decoded_sql(text: str) -> str:
    for entity, plain in web.ENTITIES.items():
        text = f"regexp_replace({text}, '(?i){entity}', {quoted(plain)}, 'g')"
    return text


_TAG_SQL = quoted(markup.TAG_RE2)


@registered(
    f"""WITH m AS (SELECT page_id, html, regexp_extract_all(html, '{_A_RE2}', 1) AS a, regexp_extract_all(html, '{_A_RE2}', 2) AS c FROM pages),
u AS (SELECT page_id, generate_subscripts(a, 1) AS place, unnest(a) AS attributes, unnest(c) AS content FROM m)
SELECT page_id, place, CASE WHEN regexp_matches(attributes, '(?i)href=["''][^"'']+["'']') THEN regexp_extract(attributes, '(?i)href=["'']([^"'']+)["'']', 1) END AS href,
  trim(regexp_replace({_decoded_sql(f"regexp_replace(content, {_TAG_SQL}, ' ', 'g')")}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS text
FROM u WHERE length(attributes) <= 2000 AND length(content) <= 400"""
)
def page_links(spark, sf_dir):
    """Links of the raw web pages, in turn."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.page_links(pages).select("page_id", (F.col("n") + 1).cast("long").alias("place"), "href", "text")


#: Links from https://shop.example/a/b/list;v?page=2 by the number of a part, and the addresses they have there.
LINKS = [
    ("p/{k}", "/a/b/p/{k}"), ("./p/{k}/.", "/a/b/p/{k}/"), ("../p/{k}", "/a/p/{k}"), ("../../../p/{k}", "/p/{k}"), ("/x/./y/../p/{k}", "/x/p/{k}"),
    ("?id={k}", "/a/b/list;v?id={k}"), ("#part{k}", "/a/b/list;v?page=2#part{k}"), (" /p/{k}\t", "/p/{k}"), ("//SHOP.example:443/p/{k}", "/p/{k}"),
    ("https://www.other.example/p/{k}", None), ("mailto:{k}@shop.example", None), ("p/синий {k}?q=a b", "/a/b/p/%D1%81%D0%B8%D0%BD%D0%B8%D0%B9%20{k}?q=a%20b"),
    ("https:p/{k}", "/a/b/p/{k}"), ("http:p/{k}", None), ("p/{k}/../../q?x=/../y", "/a/b/q?x=/../y"), ("https://u@shop.example/{k}", None), ("p\\{k}", "/a/b/p/{k}"),
]


@registered(
    f"""SELECT p_partkey, replace([{", ".join("NULL" if w is None else quoted(_SHOP + w) for _, w in LINKS)}][(p_partkey % {len(LINKS)} + 1)::INT],
  '{{k}}', p_partkey::VARCHAR) AS url FROM part"""
)
def link_addresses(spark, sf_dir):
    k = F.col("p_partkey")
    href = F.replace(F.get(F.array(*(F.lit(h) for h, _ in LINKS)), (k % len(LINKS)).cast("int")), F.lit("{k}"), k.cast("string"))
    return B.table(spark, sf_dir, "part").select("p_partkey", extraction.absolute(href, F.lit(_SHOP + "/a/b/list;v?page=2")).alias("url"))


@registered(
    f"""SELECT page_id, via, count(*) AS n FROM (
  SELECT p_partkey // {ON_PAGE} AS page_id, CASE p_partkey // {ON_PAGE} % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'microdata' ELSE 'proximity' END AS via FROM part) GROUP BY ALL"""
)
def strategy_choice(spark, sf_dir):
    """Pages of three kinds, each with a lone JSON-LD product that must not win over the kind's own rows."""
    lone = '<script type="application/ld+json">{"@type": "Product", "name": "lone one", "price": 5}</script>'
    kinds = [jsonld_pages(spark, sf_dir), microdata_pages(spark, sf_dir), card_pages(spark, sf_dir)]
    pages = None
    for k, of in enumerate(kinds):
        of = of.where(F.col("page_id") % 3 == k)
        of = of if k == 0 else of.withColumn("html", F.concat("html", F.lit(lone)))
        pages = of if pages is None else pages.unionByName(of)
    return extraction.extract_listings(pages).groupBy("page_id", "via").agg(F.count("*").alias("n"))


ITEM = "<!--item 7|Own thing|5000-->"


def _items(pages: DataFrame) -> DataFrame:
    """Listings that a shop writes into comments: key, title, price."""
    found = F.regexp_extract_all("html", F.lit(r"<!--item ([^|>]*\|[^|>]*\|\d+)-->"), 1)
    rows = pages.select("page_id", F.posexplode(found).alias("at", "item")).withColumn("part", F.split("item", r"\|"))
    return rows.select(
        "page_id", F.col("at").cast("long").alias("at"), F.col("part")[1].alias("title"), F.col("part")[2].cast("long").alias("price"), F.lit(None).cast("long").alias("old_price"),
        F.concat(F.lit(f"{_SHOP}/product/"), F.col("part")[0]).alias("url"), F.lit(None).cast("boolean").alias("in_stock"),
    )


@registered(
    f"""WITH w AS ({_want("jsonld", stock="true")})
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own.example' ELSE 'shop.example' END AS domain, via, title, price, url, in_stock FROM w WHERE page_id % 4 <> 0
UNION ALL SELECT DISTINCT page_id, 'own.example', 'parser', 'Own thing', 5000, '{_SHOP}/product/7', NULL FROM w WHERE page_id % 4 = 0"""
)
def parser_fallback(spark, sf_dir):
    """Every second page is of a shop with a parser, and every second of those isn't as it expects."""
    k = F.col("page_id")
    pages = jsonld_pages(spark, sf_dir).withColumns(
        {
            "domain": F.when(k % 2 == 0, "own.example").otherwise(F.col("domain")),
            "html": F.when(k % 2 == 0, F.concat("html", F.when(k % 4 == 0, ITEM).otherwise(""))).otherwise(F.concat("html", F.lit(ITEM))),
        }
    )
    rows = extraction.listings_by_domain(pages, {"own.example": _items})
    return rows.select("page_id", "domain", "via", "title", "price", "url", "in_stock")
