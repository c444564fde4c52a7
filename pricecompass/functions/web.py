"""Prices, availability, addresses, requests and fetch outcomes as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup
from . import values as V
from .text import let

# Entities that pages use in prices and titles, and what they stand for.
ENTITIES = {
    "&nbsp;|&#160;": " ", "&amp;|&#38;": "&", "&quot;|&#34;": '"', "&#39;|&apos;": "'", "&lt;|&#60;": "<", "&gt;|&#62;": ">",
    "&laquo;|&raquo;": '"',
}
# Phrases that deny and that state availability; denials come first, for they may hold a statement.
UNAVAILABLE = (
    r"OutOfStock|SoldOut|Discontinued|(?:нет|не)\s+в\s+наличии|not\s+available|(?:data-)?available\s*[:=]\s*[\"']?false|распродан|"
    r"закончился|unavailable"
)
AVAILABLE = r"InStock|LimitedAvailability|в\s+наличии|(?:data-)?available\s*[:=]\s*[\"']?true|\bavailable\b"
# Bounds of a request, and how its errors read.
RADIUS = (300, 25_000)
ITEM = (2, 120)
REQUEST_ERRORS = (
    "Invalid latitude", "Invalid longitude", "Radius must be between 300 and 25000 metres", "Item is required",
    "Item description is too long", "Item must include letters or numbers",
)
#: Bytes of a page that is read at most; characters in which a challenge is sought.
PAGE_BYTES, CHALLENGE_CHARS = 6 * 1024 * 1024, 4_000


def decode_entities(text: Column) -> Column:
    def decoded(raw: Column) -> Column:
        out = raw
        for entity, plain in ENTITIES.items():
            out = F.regexp_replace(out, f"(?i){entity}", plain)
        return F.when(raw.contains("&"), out).otherwise(raw)  # most texts have none

    return let(text, decoded)


def strip_tags(html: Column) -> Column:
    """Text of a piece of markup: tags are spaces, entities decoded, runs of white space one space."""
    text = decode_entities(markup.without_tags(html))
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def parse_price(raw: Column) -> Column:
    """Whole tenge: a last group of one or two digits is decimals, rounded half up; all other signs
    separate thousands. NULL without digits or beyond a long."""
    compact = F.regexp_replace(decode_entities(raw), "[^0-9.,]", "")
    pattern = r"^(\d{1,3}(?:[.,]\d{3})*|\d+)[.,](\d{1,2})$"
    whole = F.regexp_replace(F.regexp_extract(compact, pattern, 1), "[.,]", "")
    rounded = F.floor(F.concat(whole, F.lit("."), F.regexp_extract(compact, pattern, 2)).try_cast("double") + 0.5)
    return F.when(compact.rlike(pattern), rounded).otherwise(F.regexp_replace(compact, "[.,]", "").try_cast("long"))


def availability(raw: Column) -> Column:
    """True, false, or NULL where a text says nothing of it."""
    text = F.coalesce(raw, F.lit(""))
    return F.when(text.rlike(f"(?iu){UNAVAILABLE}"), False).when(text.rlike(f"(?iu){AVAILABLE}"), True)


def supports_kzt(currency: Column) -> Column:
    """Prices without a currency are taken for tenge."""
    return F.coalesce(currency, F.lit("")).rlike("(?i)^\\s*(?:KZT|₸)?\\s*$")


def normalised_domain(raw: Column) -> Column:
    """Host of a website tag, lower-case and without www; NULL for other schemes, user names and what
    is no address."""

    def of(text: Column) -> Column:
        url = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
        return let(F.when(F.length(text) <= 4096, url), host_of)

    def host_of(url: Column) -> Column:
        ours = url.rlike("(?i)^https?://") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        host = F.nullif(F.when(ours, F.lower(F.try_parse_url(url, F.lit("HOST")))), F.lit(""))
        return F.regexp_replace(host, r"^www\.", "")

    return let(F.trim(raw), of)


def ipv4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; NULL for anything else."""
    part = [F.get(F.split(ip, r"\."), F.lit(k)).try_cast("long") for k in range(4)]
    ok = ip.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    for p in part:
        ok = ok & (p <= 255)
    return F.when(ok, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def reserved_v4(ip: Column) -> Column:
    """Whether an address is private or reserved; what is no IPv4 address counts as such."""

    def among(n: Column) -> Column:
        hit = F.lit(False)
        for net in V.RESERVED_V4:
            base, bits = net.split("/")
            a, b, c, d = map(int, base.split("."))
            low = ((a * 256 + b) * 256 + c) * 256 + d
            hit = hit | n.between(low, low + (1 << (32 - int(bits))) - 1)
        return F.coalesce(hit, F.lit(True))

    return let(ipv4_number(ip), among)


def ipv6_digits(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, NULL for what is none. The last two groups may be an IPv4 address."""
    dotted = F.regexp_extract(ip, r"^[0-9A-Fa-f:]*:(\d+\.\d+\.\d+\.\d+)$", 1)
    tail = F.lpad(F.hex(ipv4_number(dotted)), 8, "0")
    text = F.when(dotted == "", ip).otherwise(
        F.concat(F.regexp_replace(ip, r"[\d.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
    )
    group = "[0-9A-Fa-f]{1,4}"
    some = f"(?:{group}(?::{group})*)?"
    digits = lambda part: F.aggregate(
        F.filter(F.split(part, ":"), lambda x: x != ""), F.lit(""), lambda acc, x: F.concat(acc, F.lpad(x, 4, "0"))
    )
    head, rest = digits(F.substring_index(text, "::", 1)), digits(F.substring_index(text, "::", -1))
    full = F.when(text.rlike(f"^(?:{group}:){{7}}{group}$"), digits(text))
    gap = F.when(text.rlike(f"^{some}::{some}$") & (F.length(head) + F.length(rest) <= 28), F.concat(F.rpad(head, 32 - F.length(rest), "0"), rest))
    return F.lower(F.coalesce(full, gap))


def reserved_ip(ip: Column) -> Column:
    """Whether an address of either kind is private or reserved; brackets and zone don't count. An IPv4
    address written as IPv6 and what is no address count as such."""

    def among(digits: Column, hit: Column) -> Column:
        for net in map(ipaddress.IPv6Network, V.RESERVED_V6):
            whole, some = divmod(net.prefixlen, 4)
            want = f"{int(net.network_address):032x}"
            same = F.substring(digits, 1, whole) == want[:whole]
            if some:
                digit = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int")
                same = same & (F.shiftright(digit, 4 - some) == int(want[whole], 16) >> (4 - some))
            hit = hit | same
        return F.coalesce(hit, F.lit(True))

    def judged(bare: Column) -> Column:
        v6 = let(ipv6_digits(bare), lambda digits: among(digits, bare.rlike("(?i)^::ffff:")))
        return F.when(bare.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & ipv4_number(bare).isNotNull(), reserved_v4(bare)).otherwise(v6)

    return let(F.get(F.split(F.regexp_replace(ip, r"^\[|\]$", ""), "%"), F.lit(0)), judged)


def public_url(url: Column) -> Column:
    """Whether an address may be fetched: http(s), no user name, the scheme's own port, a public host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    own = F.when(url.rlike("(?i)^https://"), "443").otherwise("80")
    local = (host == "localhost") | host.rlike(r"\.(?:localhost|local|internal)$") | ~(host.contains(".") | host.startswith("["))
    address = host.rlike(r"^(?:[0-9.]+|\[.*\])$")
    fine = (
        (F.length(url) <= 4096)
        & url.rlike("(?i)^https?://")
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & ((port == "") | (port == own))
        & (host != "")
        & ~local
        & ~(address & reserved_ip(host))
    )
    return F.coalesce(fine, F.lit(False))


def fetch_outcome(status: Column, content_type: Column, size: Column, body: Column) -> Column:
    """Failure of a fetch, NULL for a page that is fine; the first reason counts."""
    blocked = F.lit("blocked")
    return (
        F.when(status.isNull(), "unreachable")
        .when(status.isin(403, 429, 503), blocked)
        .when(~F.coalesce(content_type, F.lit("")).rlike("(?i)text/html|application/xhtml|application/json"), "no-listings")
        .when(size > PAGE_BYTES, "response-too-large")
        .when(F.substring(F.coalesce(body, F.lit("")), 1, CHALLENGE_CHARS).rlike(f"(?i){V.CHALLENGE}"), blocked)
        .when(~status.between(200, 299), "unreachable")
    )


def validated(body: Column) -> Column:
    """(error, lat, lon, radius_m, item) of a request's JSON body; error NULL for a good one, else the
    first check that fails. Numbers must be JSON numbers; the radius is rounded to 100 m."""
    v = F.try_parse_json(body)

    def number(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double"))

    kind = F.schema_of_variant(F.try_variant_get(v, "$.item", "variant"))
    item = F.trim(F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, "$.item", "string")), F.lit("")))
    lat, lon, radius = number("lat"), number("lon"), number("radiusM")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    checks = (lat.between(-90, 90), lon.between(-180, 180), radius.between(*RADIUS), F.length(item) >= ITEM[0], F.length(item) <= ITEM[1], item.rlike(r"[\p{L}\p{N}]"))
    error = F.when(bad(F.schema_of_variant(v).startswith("OBJECT")), "Body must be a JSON object")
    for ok, why in zip(checks, REQUEST_ERRORS, strict=True):
        error = error.when(bad(ok), why)
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(
        error.alias("error"), good(lat).alias("lat"), good(lon).alias("lon"),
        good((F.round(radius / 100) * 100).cast("long")).alias("radius_m"), good(item).alias("item"),
    )


def sse_data(record: Column) -> Column:
    """Data of a server-sent record: its data lines without one leading space, joined; NULL without any."""
    lines = F.split(record, "\r\n|\r|\n")
    data = F.filter(lines, lambda x: (x == "data") | x.startswith("data:"))
    values = F.transform(data, lambda x: F.regexp_replace(F.substr(x, F.lit(6)), "^ ", ""))
    return F.when(F.size(data) > 0, F.array_join(values, "\n"))


def sse_records(stream: Column) -> Column:
    """Records of a stream, parted by empty lines."""
    return F.filter(F.split(stream, r"(?:\r\n|\r|\n){2}"), lambda x: x != "")


def sse_frame(event: Column) -> Column:
    """An event (a struct) as a server-sent record."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))
