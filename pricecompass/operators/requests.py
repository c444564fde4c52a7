"""Many requests at once against many titles: an inverted index, then the ladder with the request as a row.

A title can only be taken for a request if it covers LEAST_COVER of its tokens, so of n tokens it lacks
0.34 n at most, and holds one at least of the 1 + 0.34 n rarest: whole (among its signatures), joined
with a neighbour, or by a prefix relation of four characters. Those few tokens are joined to the titles' index;
what meets is judged by expressions that look at arrays read off title and request once each.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.query import capacities, parsed
from ..functions.text import LETTER, has, java, let, named_in, normalise, signatures, tokens_of
from .chunks import staged

# Share of a request's tokens that a title covers; what a prefix relation counts, and its characters.
LEAST_COVER, NEAR, PREFIX = 0.66, 0.75, 4


def read_titles(titles: DataFrame) -> DataFrame:
    """Each distinct title with what the ladder looks at: low, tokens, signs, brands, accessories, conditions,
    and before: what stands before the stem of an accessory that may be bundled."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rows = titles.select(F.coalesce("title", F.lit("")).alias("title"), title.alias("_t")).distinct()
    low = rows.withColumn("low", F.lower(normalise(F.col("_t"))))
    found = lambda table: F.array_compact(F.array(*(F.when(has(F.col("low"), s), label) for label, (s, _) in table.items())))
    before = lambda label: F.regexp_extract("low", rf"^(?s)(.+?){java(V.ACCESSORIES[label][0])}", 1)
    bundled = F.when(F.col("low").rlike(f"(?iu){V.BUNDLED}"), F.map_from_arrays(F.array(*map(F.lit, V.BUNDLED_LABELS)), F.array(*map(before, V.BUNDLED_LABELS))))
    parts = low.withColumns({"tokens": tokens_of(F.col("low")), "brands": named_in(F.col("low"))})
    return parts.select(
        "title", F.length("_t").alias("chars"), F.col("_t").alias("trimmed"), "tokens", signatures(F.col("tokens")).alias("signs"), "brands",
        found(V.ACCESSORIES).alias("accessories"), found(V.CONDITIONS).alias("conditions"), bundled.alias("before"),
    )


def read_requests(requests: DataFrame) -> DataFrame:
    """Each distinct request text, parsed, with its family, the conditions it asks for and the forms of its tokens."""
    rows = requests.select(F.coalesce("request", F.lit("")).alias("request")).distinct().withColumn("q", parsed(F.col("request")))
    rows = rows.select("request", "q.*")
    family = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in V.BRAND_FAMILY.items() for x in kv)), F.col("brand")), F.col("brand"))
    asked = F.array_compact(F.array(*(F.when(has(F.col("raw"), a), label) for label, (_, a) in V.CONDITIONS.items())))
    # a token's forms: alone, joined with the one before it, with the one after it
    previous = lambda t, i: F.when(i > 0, F.concat(F.get("tokens", i - 1), t))
    form = lambda t, i: F.struct(
        t.alias("token"), F.array_compact(F.array(t, previous(t, i), F.concat(t, F.get("tokens", i + 1)))).alias("whole"),
        F.array_compact(F.array(t, previous(t, i))).alias("model"),
    )
    return rows.select(
        "request", "raw", "brand", family.alias("family"), "storage", "ram", F.coalesce("category", F.lit("other")).alias("category"), F.col("category").alias("_category"),
        "accessory", F.col("tokens").alias("asked"), F.transform("tokens", form).alias("forms"), asked.alias("wanted_conditions"),
    )


def candidates(requests: DataFrame, titles: DataFrame) -> DataFrame:
    """(request, title) that share one of the request's rarest tokens; each pair once."""
    prefix = lambda t: F.concat(F.lit("~"), F.substring(t, 1, PREFIX))
    long = lambda ts: F.transform(F.filter(ts, lambda t: F.length(t) >= PREFIX), prefix)
    index = titles.select("title", F.explode(F.array_distinct(F.concat("signs", long(F.col("tokens"))))).alias("key"))
    each = requests.select("request", F.size("asked").alias("n"), F.posexplode("forms").alias("at", "form"))
    keys = each.select("request", "n", "at", F.explode(F.array_distinct(F.concat("form.whole", long(F.array("form.token"))))).alias("key"))
    frequency = index.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("titles"))
    weighed = keys.join(frequency, "key", "left").groupBy("request", "n", "at").agg(F.sum(F.coalesce("titles", F.lit(0))).alias("titles"))
    # a request has few tokens: they meet in an array, the rarest first
    order = weighed.groupBy("request", "n").agg(F.array_sort(F.collect_list(F.struct("titles", "at"))).alias("rare"))
    chosen = order.select("request", F.explode(F.slice("rare", F.lit(1), (F.floor(F.col("n") * (1 - LEAST_COVER) + 1e-9) + 1).cast("int"))).alias("r"))
    chosen = chosen.select("request", F.col("r.at").alias("at")).join(keys, ["request", "at"]).select("request", "key").distinct()
    return chosen.join(index, "key").select("request", "title").distinct()


def _cover() -> Column:
    """Share of the asked tokens that a title has."""
    related = lambda t: F.exists(
        "tokens", lambda x: (x.startswith(t) | t.startswith(x)) & (F.least(F.length(x), F.length(t)) >= PREFIX)
    )
    worth = lambda f: F.when(F.arrays_overlap(F.col("signs"), f["whole"]), 1.0).when(related(f["token"]), NEAR).otherwise(0.0)
    return F.aggregate("forms", F.lit(0.0), lambda acc, f: acc + worth(f)) / F.size("forms")


def _reason(cover: Column, size: Column) -> Column:
    """The first rule that rejects a pair, but for its price."""
    none = F.col("accessory").isNull()
    named = lambda label: F.exists(
        "asked", lambda t: F.regexp_like(F.element_at("before", label), F.concat(F.lit(rf"(?iu)(?<!{LETTER})\Q"), t, F.lit(rf"\E(?!{LETTER})")))
    )
    belongs = lambda label: label.isin(*V.BUNDLED_LABELS) & F.coalesce(F.element_at("before", label) != "", F.lit(False)) & named(label)
    odd_accessory = F.get(F.filter("accessories", lambda label: ~belongs(label)), F.lit(0))
    condition = F.get(F.array_except("conditions", "wanted_conditions"), F.lit(0))
    others = F.array_except(F.array(*map(F.lit, V.COMPONENT_FAMILIES)), F.array("family"))
    plain = F.col("category") != "component"
    lacks = lambda f: f["token"].rlike(r"\p{N}") & ~F.arrays_overlap(F.col("signs"), f["model"])
    model = F.get(F.filter("forms", lacks), F.lit(0))["token"]
    wanted = F.filter("asked", lambda t: t.isin(*V.VARIANTS))
    attached = lambda v: F.exists("tokens", lambda t: (t == v) | F.regexp_like(t, F.concat(F.lit(r"\d"), v, F.lit("$|^"), v, F.lit(r"\d"))))
    variant = F.get(F.filter(wanted, lambda v: ~attached(v)), F.lit(0))
    phone = (F.col("category") == "smartphone") & F.exists("asked", lambda t: t.rlike(r"\p{N}"))
    unasked = F.get(F.filter("tokens", lambda t: t.isin(*V.STRICT_VARIANTS) & ~F.array_contains("asked", t)), F.lit(0))
    mismatch = lambda name: F.coalesce(size[name] != F.col(name), F.lit(False))
    says = lambda name, label: F.concat(F.lit(f"wrong {label} ("), size[name].cast("string"), F.lit("GB, wanted "), F.col(name).cast("string"), F.lit("GB)"))
    return (
        F.when(F.col("chars") < 3, "title too short")
        .when(none & odd_accessory.isNotNull(), F.concat(F.lit("accessory: "), odd_accessory))
        .when(~none & ~F.array_contains("accessories", F.col("accessory")), F.concat(F.lit("not the requested "), "accessory"))
        .when(condition.isNotNull(), condition)
        .when(F.col("brand").isNotNull() & plain & (F.size("brands") > 0) & ~F.array_contains("brands", F.col("family")), F.concat(F.lit("wrong brand (wanted "), "brand", F.lit(")")))
        .when(
            ~plain & F.col("family").isin(*V.COMPONENT_FAMILIES) & F.arrays_overlap("brands", others),
            F.concat(F.lit("wrong component family (wanted "), "brand", F.lit(")")),
        )
        .when(model.isNotNull(), F.concat(F.lit('missing model identifier "'), model, F.lit('"')))
        .when(variant.isNotNull(), F.concat(F.lit('missing variant "'), variant, F.lit('"')))
        .when(phone & unasked.isNotNull(), F.concat(F.lit('unexpected variant "'), unasked, F.lit('"')))
        .when((F.size("asked") > 0) & (cover < LEAST_COVER), "title does not match query")
        .when((F.size("asked") > 0) & mismatch("storage"), says("storage", "storage"))
        .when((F.size("asked") > 0) & mismatch("ram"), says("ram", "RAM"))
    )


def _confidence(cover: Column, size: Column) -> Column:
    """Confidence of a pair that no rule rejects."""
    sure = 0.5 + 0.4 * cover
    for name, more, less in (("storage", 0.1, 0.1), ("ram", 0.05, 0.08)):
        sure = F.when(F.col(name).isNull(), sure).when(size[name].isNull(), sure - less).otherwise(F.least(F.lit(1.0), sure + more))
    sure = sure - F.when(F.col("brand").isNotNull() & ~F.array_contains("brands", F.col("family")), 0.08).otherwise(0.0)
    return F.when(F.size("asked") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.4)


def judged(requests: DataFrame, titles: DataFrame) -> DataFrame:
    """(request, title, reason, confidence) of the pairs of requests (request) and titles (title) that share a
    rare token: reason is NULL where a title fits. All that fits is there, for any number of requests; of what
    doesn't, only what came near. A request without tokens fits nothing.

    Texts are taken once each. NULL texts are empty ones, which fit nothing; no rows give none.
    """
    asks, read = staged(read_requests(requests), "requests"), staged(read_titles(titles), "titles")
    pairs = candidates(asks, read).join(read, "title").join(asks, "request")
    stated = F.col("storage").isNotNull() | F.col("ram").isNotNull()
    size = F.when(stated, capacities(F.col("trimmed"), F.col("_category")))
    parts = let(F.struct(_cover().alias("cover"), size.alias("size")), lambda p: F.struct(_reason(p["cover"], p["size"]).alias("reason"), _confidence(p["cover"], p["size"]).alias("confidence")))
    return pairs.select("request", "title", F.explode(F.array(parts)).alias("j")).select(
        "request", "title", "j.reason", F.when(F.col("j.reason").isNull(), F.col("j.confidence")).otherwise(0.0).alias("confidence")
    )


def match_requests(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """(request, title, price, domain, confidence) of the listings that fit each request: the ladder with its
    bounds on prices and its least confidence."""
    fits = judged(requests, listings.select("title")).where(F.col("reason").isNull() & (F.col("confidence") >= V.MIN_CONFIDENCE))
    asks = read_requests(requests).select("request", "category", "accessory")
    bound = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, c in V.CATEGORIES.items() for x in (name, c[k]))), F.col("category"))
    floor = F.when(F.col("accessory").isNotNull(), V.ACCESSORY_FLOOR).otherwise(bound(0))
    bounds = asks.select("request", floor.alias("floor"), bound(1).alias("ceiling"))
    priced = listings.where("price is not null").select(F.coalesce("title", F.lit("")).alias("title"), "price", "domain")
    met = fits.join(bounds, "request").join(priced, "title")
    return met.where((F.col("price") >= F.col("floor")) & (F.col("price") <= F.col("ceiling"))).select("request", "title", "price", "domain", "confidence")
