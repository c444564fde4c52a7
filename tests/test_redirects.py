"""Redirect chains and kept files, on odd cases."""

import json

from pyspark.sql import functions as F

from pricecompass.operators import redirects
from pricecompass.sources import envelopes

RESPONSES = "url string, status int, location string, content_type string, size long, body string"


def page(url, status=200, location=None, kind="text/html", size=10, body="<p>shop</p>"):
    return (url, status, location, kind, size, body)


def test_redirect_chains(spark):
    rows = [
        page("http://a.example/", 301, "/b"), page("http://a.example/b", 302, "HTTPS://www.b.example:443/c?x=1#top"), page("https://www.b.example/c?x=1#top"),
        page("http://loop.example/1", 307, "2"), page("http://loop.example/2", 308, "./1"), page("http://in.example/", 301, "http://192.168.0.1/"),
        page("http://none.example/", 301), page("http://busy.example/", 429), page("http://pic.example/", 200, kind="image/png"), page("http://far.example/0", 301, "1"),
        *(page(f"http://far.example/{k}", 303, str(k + 1)) for k in range(1, 6)), page("http://far.example/6"), page("http://ftp.example/", 302, "ftp://ftp.example/x"),
    ]
    asked = ["http://a.example", "http://loop.example/1", "http://in.example/", "http://none.example/", "http://busy.example/", "http://pic.example/", "http://far.example/0",
             "http://far.example/1", "http://nowhere.example/", "http://10.0.0.1/", "http://ftp.example/", None, "http://a.example"]
    found = redirects.follow(spark.createDataFrame([(u,) for u in asked], "url string"), spark.createDataFrame(rows * 2, RESPONSES)).collect()
    assert {r.url: (r.final_url, r.hops, r.failure) for r in found} == {
        "http://a.example": ("https://www.b.example/c?x=1#top", 2, None),
        "http://loop.example/1": ("http://loop.example/2", 5, "unreachable"),
        "http://in.example/": ("http://in.example/", 0, "unsafe-url"),
        "http://none.example/": ("http://none.example/", 0, "unreachable"),
        "http://busy.example/": ("http://busy.example/", 0, "blocked"),
        "http://pic.example/": ("http://pic.example/", 0, "no-listings"),
        "http://far.example/0": ("http://far.example/5", 5, "unreachable"),
        "http://far.example/1": ("http://far.example/6", 5, None),
        "http://nowhere.example/": ("http://nowhere.example/", 0, "unreachable"),
        "http://10.0.0.1/": (None, 0, "unsafe-url"),
        "http://ftp.example/": ("http://ftp.example/", 0, "unsafe-url"),
    }
    assert len(found) == 11
    assert redirects.follow(spark.createDataFrame([], "url string"), spark.createDataFrame([], RESPONSES)).count() == 0


def test_kept_files(spark, tmp_path):
    now = 1_700_000_000_000
    rows = [("a", now - 5, '{"x": [1, "ü"]}'), ("a", now - 9, "0"), ("b", now + 61_000, "1"), ("c", -1, "1"), ("d", now + 59_000, "null"), ("e", 5, "{"), (None, 5, "1"), ("f", 1, None)]
    folder = f"file://{tmp_path}/kept"
    written = envelopes.write(spark.createDataFrame(rows, "key string, saved_ms long, value string"), folder).collect()
    assert len(written) == 5
    for name, body in (("0" * 20, b"\xff\xfe{"), ("1" * 20, b"[1]"), ("2" * 20, b'{"savedAt": "5", "value": 1}'), ("3" * 20, b'{"savedAt": 7, "value": "%s"}' % (b"x" * envelopes.MOST_BYTES))):
        (tmp_path / "kept" / f"{name}.json").write_bytes(body)
    (tmp_path / "kept" / "other.json").write_text("{}")
    (tmp_path / "kept" / f"{'4' * 20}.json.part").write_text("{}")
    got = {r.name: r for r in envelopes.read(spark, folder, now).collect()}
    name = lambda key: spark.range(1).select(envelopes.file_name(F.lit(key))).first()[0]
    assert len(got) == 9
    assert (got[name("a")].age_ms, json.loads(got[name("a")].value), got[name("a")].problem) == (5, {"x": [1, "ü"]}, None)
    assert (got[name("d")].age_ms, got[name("d")].problem) == (0, None)
    problems = {k: got[k].problem for k in (name("b"), name("c"), name("e"), *(f"{c * 20}.json" for c in "0123"))}
    assert list(problems.values()) == ["no-time", "no-time", "not-json", "not-json", "not-json", "no-time", "too-large"]
