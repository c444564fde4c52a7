"""Search endpoints, gaps and reports against their sequential reading and odd rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricecompass.operators import coverage, discovery, extraction
from pricecompass.plans import outcomes

HOME = "domain string, failure string, html string"
PROBE = "domain string, place int, template string, failure string, accepted boolean, client_rendered boolean"
TRIED = "domain string, outcome string, template string, tried long"


def one_by_one(probes: list[tuple], home: str | None) -> tuple:
    """What comes of a domain's probes, a batch at a time."""
    dead, tried, drawn = 0, 0, False
    common = len(discovery.COMMON_TEMPLATES)
    for of in ([p for p in probes if p[1] < common], None, [p for p in probes if p[1] >= common]):
        if of is None:
            if home == "blocked":
                return "blocked", None, tried
            continue
        for at in range(0, len(of), 2):
            if dead >= 2:
                break
            batch = of[at : at + 2]
            tried += len(batch)
            if any(p[3] == "blocked" for p in batch):
                return "blocked", None, tried
            dead += sum(p[3] in ("timeout", "unreachable") for p in batch)
            drawn = drawn or any(p[5] and p[3] is None for p in batch)
            for p in batch:
                if p[4] and p[3] is None:
                    return "found", p[2], tried
    return "js-rendered" if drawn else "no-search-endpoint", None, tried


def test_endpoints_against_trying_them_in_turn(spark):
    r = random.Random(5)
    homes, probes, want = [], [], {}
    for k in range(300):
        of = [
            (f"d{k}", place, f"/{place}", r.choice([None] * 12 + ["blocked", "timeout", "unreachable", "no-listings"]), r.choice([None, False, False, False, True]), r.choice([None, False, True]))
            for place in range(10 + r.randint(0, 4))
        ]
        home = r.choice([None, None, None, "blocked", "timeout"])
        homes.append((f"d{k}", home, None))
        probes += of
        want[f"d{k}"] = one_by_one(of, home)
    assert {x[0] for x in want.values()} == {"found", "blocked", "js-rendered", "no-search-endpoint"}
    r.shuffle(probes)
    got = discovery.endpoints(spark.createDataFrame(probes, PROBE), spark.createDataFrame(homes, HOME)).collect()
    assert {x.domain: (x.outcome, x.template, x.tried) for x in got} == want


def test_candidates_beyond_the_common_ones(spark):
    form = '<form action="{}"><input name="q"></form>'
    own = "".join(map(form.format, ("/search", "/a", "/search/", "/b", "/a", "/c", "/d", "/e")))
    homes = [("a.example", None, own), ("b.example", "timeout", own), ("c.example", None, None), ("d.example", None, "")]
    found = discovery.candidates(spark.createDataFrame(homes, HOME)).orderBy("domain", "place").collect()
    said = {d: [x.template for x in found if x.domain == d] for d, *_ in homes}
    common = list(discovery.COMMON_TEMPLATES)
    assert said == {"a.example": common + [f"/{c}?q={{q}}" for c in "abcd"], "b.example": common, "c.example": common, "d.example": common}
    none = discovery.endpoints(spark.createDataFrame([], PROBE), spark.createDataFrame(homes[:1], HOME))
    assert [tuple(x) for x in none.collect()] == [("a.example", "no-search-endpoint", None, 0)]
    assert discovery.endpoints(spark.createDataFrame([], PROBE), spark.createDataFrame([], HOME)).count() == 0


def test_a_page_of_forms_is_written_into_the_plan_once(spark):
    pages = spark.createDataFrame([], "html string, origin string").select(discovery.templates(F.col("html"), F.col("origin")))
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_") < 250


def test_a_judged_page_has_its_links_addresses_in_the_plan_once(spark):
    page = spark.createDataFrame([], "html string, landed string").select(discovery.judged(F.col("html"), F.col("landed"), F.lit("https://shop.example/s"), ("widget", "15")))
    plan = page._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("%2e") < 12, plan.count("%2e")


def test_pages_written_from_few_rows_are_many_tasks(spark):
    plan = outcomes.search_endpoints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan


def test_gaps(spark):
    domains = spark.createDataFrame([(f"d{k}", k) for k in range(6)], "domain string, place int")
    known = [("d0", "Zero", True, False, "told"), ("d1", "One", False, True, None), ("d2", "Two", False, False, "note")]
    adapters = spark.createDataFrame(known, "domain string, label string, blocked boolean, client_rendered boolean, note string")
    fetched = spark.createDataFrame([("d0", None), ("d1", "timeout"), ("d2", "timeout"), ("d3", None), ("d4", "no-listings")], "domain string, failure string")
    states = coverage.states(domains, adapters, fetched)
    assert {r.domain: r.failure for r in states.collect()} == {"d0": "blocked", "d1": "js-rendered", "d2": "timeout", "d3": None, "d4": "no-listings", "d5": "unreachable"}
    skipped = spark.range(53).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("label"), F.col("id").alias("place"))
    rows = [tuple(r) for r in coverage.gaps(states, skipped).collect()]
    assert rows[:4] == [("Zero", "told"), ("One", "shows prices only after running JavaScript"), ("Two", "note"), ("d5", "was unreachable")]
    assert len(rows) == 4 + 50 + 1 and rows[-1][0] == "3 more mapped retailers"
    assert coverage.gaps(states.limit(0), skipped.limit(0)).count() == 0


def test_report_on_matches(spark):
    rows = [("a", k, f"t{k}" * 40, 100 + k, k % 3 > 0, None if k % 6 == 1 else f"r{k % 2}", 0.5) for k in range(60)]
    rows += [(None, 1, None, None, None, None, None)]
    judged = spark.createDataFrame(rows, "domain string, at long, title string, price long, rejected boolean, reject_reason string, confidence double")
    got = coverage.match_report(judged).collect()
    of = lambda kind: sorted((r for r in got if r.kind == kind and r.domain == "a"), key=lambda r: r.place)
    assert [r.price for r in of("kept")] == [100 + 3 * k for k in range(coverage.MOST_KEPT)] and {r.reason for r in of("kept")} == {None}
    assert [r.price for r in of("sample")] == [101, 102, 104, 105, 107, 108] and all(len(r.title) == coverage.TITLE_CHARS for r in of("sample"))
    assert [(r.reason, r.n) for r in of("rejected")] == [("r0", 20), ("r1", 10), ("unknown", 10)]
    assert [(r.kind, r.place) for r in got if r.domain is None] == [("kept", 1)]
    assert coverage.match_report(judged.limit(0)).count() == 0


def test_microdata_items_that_count(spark):
    item = """<div itemtype="https://schema.org/Product"><b itemprop="name">{}</b><b itemprop="price" content="{}">{}</b>{}</div>"""
    html = "".join([item.format("digits", "5.000", "7 000 ₸", ""), item.format("words", "from 5", "7 000 ₸", ""), item.format("long", "5000", "", "x" * 4_000), item.format("last one", "9000", "", "")])
    rows = spark.createDataFrame([(1, "https://shop.example/", "shop.example", html), (2, "https://shop.example/", "shop.example", None)], "page_id long, url string, domain string, html string")
    assert sorted((r.title, r.price) for r in extraction.from_microdata(rows).collect()) == [("digits", 5000), ("last one", 9000), ("words", 7000)]
