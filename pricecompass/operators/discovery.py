"""Search pages of retailers: templates from their forms, addresses, and whether a page has results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, web
from ..functions import values as V
from ..functions.text import let, normalise
from .extraction import absolute

# Limits of links, forms and templates; links that lead to no product and those that may; marks of a page that shows results.
LINK_CHARS, FORM_ATTRIBUTES, FORM_CHARS, TEMPLATE_CHARS = 300, 2_000, 6_000, 2_048
NO_PRODUCT = r"(?i)^#|javascript:|/(?:blog|news|article|help|about|search|tag)(?:/|$)"
PRODUCT_PATH = "(?i)/(?:product|products|p|tovar|tovary|item|goods)/"
PRICED = r"(?iu)\d[\d\x{A0}\x{202F}\x{2009} .,]{2,14}(?:<[^>]{0,200}>|[\s\p{Z}]|&nbsp;)*+(?:₸|〒|тг(?![\p{L}\p{N}])|тенге)"
CHROME = (
    'class="filter', "class='filter", 'class="facet', "class='facet", "product-list", "search-result", "найдено", "результат поиска",
    "search results",
)
SEARCH_NAME = "(?i)^(?:q|s|query|search|text|keyword|term)$"
ENOUGH_PRICES, ENOUGH_TITLES = 3, 2
# Templates that shops commonly have, most common first; how many of a shop's own are tried, how many
# at a time, and after how many dead answers a shop is given up.
COMMON_TEMPLATES = (
    "/search?q={q}", "/search/?q={q}", "/search?query={q}", "/search/?query={q}", "/Search?query={q}", "/search?text={q}", "/catalog/search?q={q}", "/?s={q}",
    "/index.php?route=product/search&search={q}", "/search/index.php?q={q}",
)
MOST_DECLARED, AT_A_TIME, DEAD = 4, 2, 2
# What is told of a shop's search.
FOUND, BLOCKED, CLIENT_RENDERED, NO_SEARCH = "found", "blocked", "js-rendered", "no-search-endpoint"
# What an address leaves as it is, though the encoder writes it as hexadecimal.
PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def uri_component(text: Column) -> Column:
    """A text as a part of an address."""
    out = F.url_encode(text)
    for written, plain in PLAIN.items():
        out = F.replace(out, F.lit(written), F.lit(plain))
    return out


def search_url(origin: Column, template: Column, query: Column) -> Column:
    """The address of a search: the template's first {q} is the request."""
    head = F.substring_index(template, "{q}", 1)
    tail = F.substr(template, F.length(head) + 4)
    return F.when(template.contains("{q}"), F.concat(origin, head, uri_component(query), tail)).otherwise(F.concat(origin, template))


def usable_template(template: Column) -> Column:
    fine = template.startswith("/") & template.contains("{q}") & (F.length(template) <= TEMPLATE_CHARS)
    return F.coalesce(fine, F.lit(False))


def relevance_terms(tokens: Column, search_term: Column) -> Column:
    """Three tokens at most that a fitting title holds; else two words of the search term."""
    long = F.filter(tokens, lambda t: (F.length(t) >= 3) | ((F.length(t) == 2) & t.rlike(r"\d")))
    words = F.filter(F.split(F.lower(search_term), r"\s+"), lambda t: F.length(t) >= 3)
    return F.when(F.size(long) > 0, F.slice(long, 1, 3)).otherwise(F.slice(words, 1, 2))


def count_prices(html: Column) -> Column:
    return F.coalesce(F.regexp_count(html, F.lit(PRICED)), F.lit(0))


def _attribute(tag: Column, name: str, least: str = "*") -> Column:
    """A quoted attribute; NULL where it isn't there."""
    pattern = f"(?i){name}=[\"']([^\"']{least})[\"']"
    return F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _path(url: Column) -> Column:
    """A path, "/" where there is none."""
    return let(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), lambda path: F.when(path == "", "/").otherwise(path))


def relevant_titles(html: Column, terms: tuple[str, ...], url: Column) -> Column:
    """Links to products of the page's host that name the terms: all with a digit and one of the others
    that is no variant. Without terms every page has enough."""
    if not terms:
        return F.lit(ENOUGH_TITLES)
    numbered = [t for t in terms if any(c.isdigit() for c in t)]
    family = [t for t in terms if t not in numbered and t not in V.VARIANTS]

    def names(low: Column) -> Column:
        compact = F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")

        def has(term: str) -> Column:
            t = F.lower(normalise(F.lit(term)))
            return F.contains(low, t) | F.contains(compact, F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))

        ok = F.lit(True)
        for term in numbered:
            ok = ok & has(term)
        some = F.lit(not family)
        for term in family:
            some = some | has(term)
        return ok & some

    def fits(link: Column) -> Column:
        attributes, content = link["attributes"], link["content"]
        closed = attributes.isNotNull() & (link["unclosed"] == "")
        href = _attribute(attributes, "href", "+")

        def leads(url_of: Column) -> Column:
            return (_host(url_of) == _host(url)) & let(_path(url_of), to_product)

        def to_product(path: Column) -> Column:
            last = F.regexp_extract(path, "([^/]+)/*$", 1)
            return path.rlike(PRODUCT_PATH) | last.rlike(r"\d") | last.rlike("(?i)[a-z0-9]+(?:-[a-z0-9]+){2,}")

        # a link's address and title are read once, the address only of those whose title fits
        titled = let(web.strip_tags(content), lambda title: (F.length(title) >= 3) & let(F.lower(normalise(title)), names))
        fine = closed & (F.length(content) <= LINK_CHARS) & ~href.rlike(NO_PRODUCT)
        return F.coalesce(fine & titled & let(absolute(href, url), leads), F.lit(False))

    return F.least(F.size(F.filter(markup.elements(html, "a"), fits)), F.lit(ENOUGH_TITLES))


def judged(html: Column, landed: Column, requested: Column, terms: tuple[str, ...]) -> Column:
    """(accepted, client_rendered) of a page that a search came to.

    A page of another host, or a home page that wasn't asked for, is neither. Accepted: three prices and
    two fitting titles. Rendered by the client: the marks of results, but fewer prices.
    """
    bounced = (_path(landed) == "/") & (_path(requested) != "/") & F.try_parse_url(landed, F.lit("QUERY")).isNull()
    there = F.coalesce((_host(landed) == _host(requested)) & ~bounced, F.lit(False))
    prices = count_prices(html)
    low, chrome = F.lower(html), F.lit(False)
    for mark in CHROME:
        chrome = chrome | low.contains(mark)
    accepted = there & (prices >= ENOUGH_PRICES) & (relevant_titles(html, terms, landed) >= ENOUGH_TITLES)
    return F.struct(
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
        F.coalesce(there & chrome & (prices < ENOUGH_PRICES), F.lit(False)).alias("client_rendered"),
    )


def templates(html: Column, origin: Column) -> Column:
    """Search templates of a page, each once: its published search action, then inputs of its GET forms
    that are for searching by their name, their tag or the form's address."""
    published = r"(?i)\"target\"\s*:\s*\"([^\"]*\{search_term_string\}[^\"]*)\""
    target = F.when(html.rlike(published), F.regexp_extract(html, published, 1))
    # braces aren't allowed in an address, so a word stands for the request until it is parsed
    target = absolute(F.replace(target, F.lit("{search_term_string}"), F.lit("SEARCHTERM")), origin)
    action = F.replace(_file(target), F.lit("SEARCHTERM"), F.lit("{q}"))

    def of_form(form: Column) -> Column:
        attributes, content = form["attributes"], form["content"]
        closed = attributes.isNotNull() & (form["unclosed"] == "")
        goes_to = F.coalesce(_attribute(attributes, "action"), F.lit(""))
        get = F.lower(F.coalesce(_attribute(attributes, "method"), F.lit("get"))) == "get"
        fine = closed & get & (F.length(attributes) <= FORM_ATTRIBUTES) & (F.length(content) <= FORM_CHARS)

        def of_inputs(url: Column) -> Column:
            def of_input(tag: Column) -> Column:
                kind = F.lower(F.coalesce(_attribute(tag, "type"), F.lit("text")))
                name = _attribute(tag, "name", "+")
                searchy = name.rlike(SEARCH_NAME) | tag.rlike("(?iu)search|поиск|искать") | goes_to.rlike("(?iu)search|поиск")
                mark = F.when(url.contains("?"), "&").otherwise("?")
                return F.when(kind.isin("search", "text", "") & searchy, F.concat(url, mark, uri_component(name), F.lit("={q}")))

            return F.transform(F.regexp_extract_all(content, F.lit(r"(?i)<input\b[^>]*>"), F.lit(0)), of_input)

        # a form's address is resolved once, for all its inputs
        address = _file(absolute(F.when(goes_to == "", "/").otherwise(goes_to), origin))
        return F.when(fine, let(address, of_inputs)).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(markup.elements(html, "form"), of_form))
    return F.array_distinct(F.array_compact(F.concat(F.array(action), found)))


def _file(url: Column) -> Column:
    """Path and query of an address."""

    def joined(url: Column) -> Column:
        query = F.try_parse_url(url, F.lit("QUERY"))
        return F.when(url.isNotNull(), F.concat(_path(url), F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))

    return let(url, joined)


def candidates(homes: DataFrame) -> DataFrame:
    """(domain, place, template) of homes (domain, failure, html): the common templates, then the first few that
    the home page declares beyond those. A home page that failed, or is NULL, declares none."""
    common = F.array(*map(F.lit, COMMON_TEMPLATES))
    own = F.when(F.col("failure").isNull(), templates(F.col("html"), F.concat(F.lit("https://"), "domain")))
    own = F.slice(F.array_except(F.coalesce(own, F.array().cast("array<string>")), common), 1, MOST_DECLARED)
    return homes.select("domain", F.posexplode(F.concat(common, own)).alias("place", "template"))


def endpoints(probes: DataFrame, homes: DataFrame) -> DataFrame:
    """(domain, outcome, template, tried): what comes of trying the candidates of each of homes.

    probes (domain, place, template, failure, accepted, client_rendered) say how each candidate would answer.
    They are tried AT_A_TIME by place, the common ones first, then the home page, then its own. A refusal, also
    by the home page, ends the search as blocked, even beside a candidate that is accepted; else the first one
    accepted ends it. After DEAD timeouts or unreachable answers no more are tried. If nothing was found
    and a page was drawn by the client, that is told. NULL flags are false; a domain without probes has no
    search; a domain's probes are few, so they may meet in a window.
    """
    common = len(COMMON_TEMPLATES)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) & F.col("failure").isNull()
    turn = F.when(F.col("place") < common, F.floor(F.col("place") / AT_A_TIME)).otherwise(common + F.floor((F.col("place") - common) / AT_A_TIME))
    asked = probes.groupBy("domain", turn.cast("int").alias("turn")).agg(
        F.coalesce(F.bool_or(F.col("failure") == BLOCKED), F.lit(False)).alias("refused"),
        F.count_if(F.col("failure").isin("timeout", "unreachable")).alias("dead"),
        F.min_by("template", F.when(yes("accepted"), F.col("place"))).alias("hit"),
        F.bool_or(yes("client_rendered")).alias("drawn"),
        F.count("*").alias("n"),
    )
    no = F.lit(None).cast("string")
    refused = F.coalesce(F.col("failure") == BLOCKED, F.lit(False))
    home = homes.select("domain", F.lit(common - 1).alias("turn"), refused.alias("refused"), F.lit(0).cast("long").alias("dead"), no.alias("hit"), F.lit(False).alias("drawn"), F.lit(0).cast("long").alias("n"))
    before = Window.partitionBy("domain").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    is_home = F.col("turn") == common - 1
    # candidates are left alone once too many were dead; the home page is asked all the same
    rows = asked.unionByName(home).withColumn("open", is_home | (F.coalesce(F.sum("dead").over(before), F.lit(0)) < DEAD))
    ends = F.col("open") & (F.col("refused") | F.col("hit").isNotNull())
    rows = rows.withColumn("ends", ends).withColumn("over", F.coalesce(F.bool_or("ends").over(before), F.lit(False)))
    done = rows.where("open and not over").groupBy("domain").agg(
        F.bool_or("refused").alias("refused"), F.max("hit").alias("hit"), F.bool_or("drawn").alias("drawn"), F.sum("n").alias("tried")
    )
    outcome = F.when(F.col("refused"), BLOCKED).when(F.col("hit").isNotNull(), FOUND).when(F.col("drawn"), CLIENT_RENDERED).otherwise(NO_SEARCH)
    return done.select("domain", outcome.alias("outcome"), F.when(~F.col("refused"), F.col("hit")).alias("template"), "tried")
