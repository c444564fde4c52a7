"""Markup as a lexer sees it: text, tags and quoted values in tags; and addresses of links.

The lexer is one regular expression. Its repeats never give anything back, and a tag that is never
closed takes the rest of the text, so each character is looked at a fixed number of times whatever a
page holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Inside of a tag: what is quoted may hold ">".
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: A tag up to its ">", or to the end of the text.
TAG = rf"<{_INSIDE}(?:>|[\s\S]*+)"
#: The same for engines without possessive repeats.
TAG_RE2 = r"""<(?:[^>"']|"[^"]*"|'[^']*')*(?:>|["'](?:.|\n)*|$)"""
# Entities of blanks that may stand between the digits of a price.
BLANK_ENTITY = "(?i)&(?:nbsp|#160|#x0*a0|#8239|#x202f);"
#: Characters of a link at most, as written and as an address.
MOST_HREF, MOST_URL = 8192, 2048


def without_tags(html: Column) -> Column:
    """Tags as one blank each."""
    return F.regexp_replace(html, TAG, " ")


def blanked(text: Column, pattern: str) -> Column:
    """text with matches as blanks: the places of all other characters stay."""
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    blank = lambda piece, m: F.concat(piece, F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(F.split(text, pattern), found, blank), "")


def masked(html: Column) -> Column:
    """Tags and entities of blanks as blanks, the length kept."""
    return blanked(blanked(html, TAG), BLANK_ENTITY)


def element(tag: str) -> str:
    """Pattern of a closed element (groups: attributes, content). What opens one and isn't closed takes
    the rest of the text; what is closed by a longer name (`<nav>` by `</navigation>`) goes up to there."""
    ends = r"(?=[\s/>]|\z)"
    opened, closed = rf"<(?i:{tag}){ends}", rf"</(?i:{tag})"
    content = rf"(?:[^<]++|<(?!/(?i:{tag})))*+"
    return rf"{opened}({_INSIDE})>({content}){closed}{ends}{_INSIDE}>|({opened}{_INSIDE}>{content}{closed}(?![\s/>]|\z)|{opened}[\s\S]*+)"


def without_elements(html: Column, tag: str) -> Column:
    """html with closed elements of a tag as a blank; what isn't closed stays."""
    return F.regexp_replace(html, element(tag), " $3")


def elements(html: Column, tag: str) -> Column:
    """Array of (gap, whole, attributes, content): the closed elements of a tag, and the characters between
    one and the end of the one before it; a last one without attributes is what follows them."""
    pattern = element(tag)
    part = lambda k: F.concat(F.regexp_extract_all(html, F.lit(pattern), F.lit(k)), F.array(F.lit(None).cast("string")))
    gaps = F.transform(F.split(html, pattern), F.length)
    return F.arrays_zip(gaps.alias("gap"), part(0).alias("whole"), part(1).alias("attributes"), part(2).alias("content"), part(3).alias("unclosed"))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, "." and ".." taken out; the last one leaves its slash."""
    up, stay = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$"
    step = lambda acc, x: (
        F.when(x.rlike(up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(stay), acc).otherwise(F.concat(acc, F.array(x)))
    )

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        last = F.element_at(parts, -1)
        ends = F.when(last.rlike(up) | last.rlike(stay), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))

    # most paths have no part that begins with a dot
    dotted = path.rlike(r"(?i)/(?:\.|%2e)")
    return F.when(dotted, let(F.slice(F.split(path, "/"), F.lit(2), F.lit(1 << 20)), joined)).otherwise(path)


#: What must be percent-encoded in a path or a query: blanks, quotes, angles and all that isn't ASCII.
_ODD = r"[^!#-;=?-_a-z{|}~]+"


def _encoded(part: Column) -> Column:
    """part with what must be percent-encoded so; what is encoded stays."""

    def joined(text: Column) -> Column:
        odd = F.transform(F.regexp_extract_all(text, F.lit(_ODD), F.lit(0)), lambda m: F.replace(F.url_encode(m), F.lit("+"), F.lit("%20")))
        both = F.zip_with(F.split(text, _ODD), F.concat(odd, F.array(F.lit(""))), lambda plain, code: F.concat(plain, code))
        return F.when(text.rlike(_ODD), F.array_join(both, "")).otherwise(text)

    return let(part, joined)


def resolved(href: Column, base: Column) -> Column:
    """Address that a link has on the page at base (http or https); NULL for other schemes, user names
    and what is no address. Blanks around it and line ends in it don't count."""
    bare = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    parts = r"^(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?"

    def bare_of(h: Column) -> Column:
        """Without the scheme where it is the page's own and no host follows, and with slashes as they go."""
        same = F.lower(F.regexp_extract(h, r"^(?i)(https?):(?![/\\])", 1)) == F.lower(F.regexp_extract(base, parts, 1))
        plain = F.when(same, F.regexp_replace(h, r"^(?i)https?:", "")).otherwise(h)
        return let(plain, lambda p: F.concat(F.translate(F.regexp_extract(p, r"^([^?#]*)", 1), "\\", "/"), F.regexp_extract(p, r"^[^?#]*(.*)$", 1)))

    def absolute(h: Column) -> Column:
        page = F.struct(
            F.lower(F.regexp_extract(base, parts, 1)).alias("scheme"), F.regexp_extract(base, parts, 2).alias("host"),
            F.translate(F.regexp_extract(base, parts, 3), "\\", "/").alias("path"), F.regexp_extract(base, parts, 4).alias("query"),
        )
        return let(page, lambda b: onto(h, b))

    def onto(h: Column, b: Column) -> Column:
        origin = F.concat(b["scheme"], F.lit("://"), b["host"])
        path = F.when(b["path"] == "", "/").otherwise(b["path"])
        return (
            F.when(h.rlike(r"^(?i)https?:/"), h)
            .when(h.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, path, h))
            .when(h.startswith("#") | (h == ""), F.concat(origin, path, b["query"], h))
            .otherwise(F.concat(origin, F.regexp_extract(path, "^(.*/)", 1), h))
        )

    def tidy(url: Column) -> Column:
        fields = r"^(?i)(https?):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
        names = ("scheme", "host", "path", "query", "fragment")
        return let(F.struct(*(F.regexp_extract(url, fields, k).alias(name) for k, name in enumerate(names, 1))), whole)

    def whole(u: Column) -> Column:
        scheme = F.lower(u["scheme"])
        host = F.regexp_replace(F.lower(u["host"]), F.when(scheme == "https", ":(?:443)?$").otherwise(":(?:80)?$"), "")
        path = F.when(u["path"] == "", "/").otherwise(u["path"])

        def at(host: Column) -> Column:
            fine = (host != "") & ~host.contains("@") & host.rlike(r"^(?:[^\s:\[\]]+|\[[0-9a-f:.]+\])(?::\d{1,5})?$")
            return F.when(fine, F.concat(scheme, F.lit("://"), host, _encoded(_without_dots(path)), _encoded(u["query"]), u["fragment"]))

        return let(host, at)

    fine = base.rlike(r"^(?i)https?:[/\\]*[^/\\?#]") & (F.length(href) <= MOST_HREF)
    return F.when(fine, let(let(let(bare, bare_of), absolute), tidy))
