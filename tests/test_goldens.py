"""Single cases of expressions, with the answers that a shopper must get."""

import pytest
from pyspark.sql import functions as F

from pricecompass.functions import answers, guards, query, web
from pricecompass.operators import discovery

AVAILABILITY = [
    ("https://schema.org/InStock", True), ("OutOfStock", False), ("нет в наличии", False), ("Есть в наличии", True), ("data-available='false'", False),
    ("available: true", True), ("unavailable", False), ("now available", True), ("", None), (None, None), ("не в наличии", False), ("soon", None),
]
DOMAINS = [
    ("https://www.Shop.example/path?x=1", "shop.example"), ("shop.example", "shop.example"), ("http://user@shop.example", None), ("ftp://shop.example", None),
    ("HTTPS://A.B.example", "a.b.example"), (None, None), ("", None), ("www.www.example", "www.example"),
]
URLS = [
    ("https://shop.example/a", True), ("http://shop.example:80/", True), ("https://shop.example:8443/", False), ("http://localhost/", False),
    ("http://x.internal/", False), ("http://router/", False), ("http://10.1.2.3/", False), ("http://8.8.8.8/", True), ("https://u:p@shop.example/", False),
    ("file:///etc/passwd", False), (None, False), ("http://172.20.0.1/x", False), ("http://172.32.0.1/x", True),
    ("https://[2606:4700:4700::1111]/", True), ("https://[2606:4700:4700::1111]:443/", True), ("https://[::1]/", False), ("http://[fd00::1]/x", False),
]
RECORDS = [
    ('data: {"a": 1}', '{"a": 1}'), ("data:x\ndata:  y", "x\n y"), (": comment", None), ("event: tick\r\ndata: z\r\nid: 4", "z"), ("data", ""), ("database: 1", None),
]
IPS = [
    ("8.8.8.8", False), ("10.0.0.1", True), ("2606:4700:4700::1111", False), ("::1", True), ("::", True), ("fd00::1", True), ("fe80::1%eth0", True),
    ("febf::1", True), ("fec0::1", False), ("ff02::1", True), ("2001::5", True), ("2001:1::5", False), ("2001:db8::1", True), ("2001:DB9::1", False),
    ("2002:808:808::", True), ("64:ff9b::8.8.8.8", True), ("64:ff9b:1:ffff::", True), ("64:ff9b:2::1", False), ("100::1", True), ("100:0:0:1::", False),
    ("::ffff:8.8.8.8", True), ("::FFFF:808:808", True), ("::192.168.1.1", True), ("[2a00:1450:4001:800::200e]", False), ("2a00:1450", True), ("shop", True),
    ("1:2:3:4:5:6:7:8", False), ("1:2:3:4:5:6:7:8:9", True), ("1::2::3", True), ("fbff::1", False), ("1:2:3:4:5:6:8.8.8.8", False), ("", True), (None, True),
    ("100.63.255.255", False), ("100.127.0.1", True),
]
ASKED = [
    ("iPhone 15 Pro 256GB", ("iphone 15 pro", "apple", 256, None, "smartphone", "iphone 15 pro", None)),
    ("Samsung Galaxy S24 12/256", ("samsung galaxy s24", "samsung", 256, 12, "smartphone", "samsung galaxy s24", None)),
    ("чехол для iPhone 15", ("чехол iphone 15", "apple", None, None, "other", "чехол iphone 15", "case")),
    ("RTX 4070 12GB", ("rtx 4070", None, 12, None, "component", "rtx 4070", None)),
    ("ноутбук Lenovo 16GB 512GB", ("ноутбук lenovo", "lenovo", 512, 16, "laptop", "ноутбук lenovo", None)),
    ("iphone 12/128", ("iphone 12", "apple", 128, None, "smartphone", "iphone 12", None)),
    ("  PS5 ", ("ps5", None, None, None, "console", "ps5", None)),
    ("робот пылесос", ("робот пылесос", None, None, None, None, "робот пылесос", None)),
    (None, ("", None, None, None, None, "", None)),
]
PRICES = [
    ("<b>12 990</b><i>&nbsp;</i>₸ 5 000 тг, 700 тенге", "3"), ("5 000 тгк", "0"), ("12 ₸", "1"), ("7₸", "0"), ("1.000 KZT", "0"), ("", "0"), (None, "0"),
    ("100 000 〒", "1"),
]
FORMS = [
    ('<form action="/find"><input name="q"><input type="hidden" name="search"></form>', "/find?q={q}"),
    ('<form method="POST"><input name="q"></form><form><input name="s" type=""></form>', "/?s={q}"),
    ('{"target": "https://shop.example/s?text={search_term_string}"} <form action="/s"><input name="text"></form>', "/s?text={q}"),
    ('<form action="/a?b=1"><input name="what now" placeholder="Поиск"><input name="mail"></form>', "/a?b=1&what%20now={q}"),
    ('<form action="/search"><input name="one"><input name="two"></form>', "/search?one={q}|/search?two={q}"),
    ('<form action="/find"><input name="q">', ""), ("", ""), (None, ""),
]


def _cards(link: str, *titles: str) -> str:
    return "".join(f'<div><a href="{link}{k}">{t}</a> {k + 1}0 000 ₸</div>' for k, t in enumerate(titles))


_THREE = ("Red Widget 15", "Widget-15 blue", "widget 16")

LANDED = [
    (_cards("/product/", *_THREE), "https://shop.example/search?q=x", "accepted"), (_cards("/product/", *_THREE), "https://other.example/search", ""),
    (_cards("/product/", *_THREE), "https://shop.example/", ""), ('<div class="filter">', "https://shop.example/search", "client_rendered"),
    (_cards("/blog/", *_THREE), "https://shop.example/search", ""), (_cards("/product/", "Widget 15", "Gadget 15", "15"), "https://shop.example/search", ""),
    (_cards("https://www.shop.example/p/", *_THREE), "https://shop.example/search", "accepted"), (_cards("https://far.example/p/", *_THREE), "https://shop.example/search", ""),
]
CLIENTS = [
    ("8.8.8.8, 10.0.0.1", "8.8.8.8"), (" 2001:db8::1 ", "2001:db8::1"), ("::1", "::1"), ("256.1.1.1", "anonymous"), ("host", "anonymous"), ("", "anonymous"),
    (None, "anonymous"), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("1::2::3", "anonymous"), ("1:2:3:4:5:6:7::8", "anonymous"),
]
ANSWERS = [
    '{"searchTerm": " iPhone 15 PRO ", "brand": "Apple", "storageGb": 128, "ramGb": 1024, "category": "smartphone"}',
    'Sure: ```json {"searchTerm": "iphone", "storageGb": 1.5, "category": "spaceship", "ramGb": 8}``` {done}',
    "no object",
    'so {"brand": 7, "model": " A1 ", "storageGb": "128", "ramGb": 12.0} it is',
    None,
    "} {",
]
FILLED = {
    "search_term": ["iphone 15 pro", "phone", "phone", "phone", "phone", "phone"],
    "model": [None, None, None, "a1", None, None],
    "storage_gb": ["128", None, None, None, None, None],
    "ram_gb": [None, "8", None, "12", None, None],
    "category": ["smartphone", None, None, None, None, None],
    "via": ["llm", "llm", "rules", "llm", "rules", "rules"],
}


GOLDEN = {
    "availability": (AVAILABILITY, web.availability),
    "domains": (DOMAINS, web.normalised_domain),
    "addresses": (URLS, web.public_url),
    "records": (RECORDS, web.sse_data),
    "reserved": (IPS, web.reserved_ip),
    "prices": (PRICES, lambda raw: discovery.count_prices(raw).cast("string")),
    "forms": (FORMS, lambda raw: F.array_join(discovery.templates(F.coalesce(raw, F.lit("")), F.lit("https://shop.example")), "|")),
    "clients": (CLIENTS, lambda raw: guards.client_key(raw, F.lit("not an address"))),
    "labels": ([*guards.FAILURE_LABEL.items(), ("odd", None), (None, None)], guards.failure_label),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_expression(spark, name):
    cases, expression = GOLDEN[name]
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, raw string")
    found = {r.k: r.found for r in rows.select("k", expression(F.col("raw")).alias("found")).collect()}
    assert [found[k] for k in range(len(cases))] == [want for _, want in cases]


def test_requests(spark):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(ASKED)], "k int, raw string")
    for r in rows.select("k", query.parsed(F.col("raw")).alias("r")).collect():
        got = r.r
        assert (got.search_term, got.brand, got.storage, got.ram, got.category, " ".join(got.tokens), got.accessory) == ASKED[r.k][1]


def test_landings(spark):
    rows = spark.createDataFrame([(k, html, url) for k, (html, url, _) in enumerate(LANDED)], "k int, html string, url string")
    v = discovery.judged(F.col("html"), F.col("url"), F.lit("https://www.shop.example/search?q=x"), ("widget", "15"))
    shown = F.when(v["accepted"], "accepted").when(v["client_rendered"], "client_rendered").otherwise("")
    found = {r.k: r.shown for r in rows.select("k", shown.alias("shown")).collect()}
    assert [found[k] for k in range(len(LANDED))] == [want for *_, want in LANDED]


def test_enrichment(spark):
    none = F.lit(None)
    base = {
        "search_term": F.lit("phone"), "brand": none.cast("string"), "model": none.cast("string"), "storage_gb": none.cast("int"),
        "ram_gb": none.cast("int"), "category": none.cast("string"), "required_tokens": F.array(F.lit("iphone"), F.lit("15")),
    }
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "k int, answer string")
    for r in rows.select("k", *(c.alias(n) for n, c in answers.enriched(base, F.col("answer")).items())).collect():
        assert r.brand == ("apple" if r.k == 0 else None)
        for name, want in FILLED.items():
            assert (None if r[name] is None else str(r[name])) == want[r.k]
