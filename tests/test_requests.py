"""Many requests and many shoppers at once, against one at a time."""

import math
import random

from pyspark.sql import functions as F

from pricecompass.functions import matching, query
from pricecompass.operators import requests, stores

ASKS = [
    "iPhone 15", "iPhone 15 256GB", "Samsung Galaxy A17", "MacBook Air M2 16GB 512GB", "Samsung S24+", "Nvidia RTX 4090", "charger for iPhone 15", "чехол для iPhone 15",
    "used iPhone 13", "самсунг галакси а17", "робот пылесос", "PS5", "Redmi Note 12/128", "Galaxy Z Fold5", "laptop 16GB", "", "the best",
]
TITLES = [
    "Смартфон Apple iPhone 15 128GB Black", "Apple iPhone 15 Pro Max 256GB", "Чехол для iPhone 15 силиконовый", "iPhone 15 128GB с зарядным устройством в комплекте",
    "Samsung Galaxy A17 8/256GB", "Samsung Galaxy A55", "Samsung Galaxy S24 Plus 256GB", "Samsung Galaxy S24 Ultra 12/512GB", "AMD RTX 4090 Graphics Card", "Nvidia RTX 4090 24GB",
    "Premium charger for Apple iPhone 15", "Apple iPhone 13 б/у", "Apple iPhone 13 64GB", "Робот-пылесос Xiaomi S10", "Sony PS5 Console", "Redmi Note 12 128GB", "Redmi Note 13 8/256",
    "Samsung Galaxy Z Fold 5 512GB", "Apple MacBook Air M2 16GB 512GB", "Apple MacBook Air M2 8GB 512GB", "Asus laptop 16GB RAM 512GB SSD", "ab", "", None, "iPhone15 256GB копия",
]


def test_requests_as_rows_are_judged_like_one_at_a_time(spark):
    titles = spark.createDataFrame([(t,) for t in TITLES * 2], "title string")
    table = requests.judged(spark.createDataFrame([(a,) for a in [*ASKS, None]], "request string"), titles)
    got = {(r.request, r.title): (r.reason, round(r.confidence, 9)) for r in table.collect()}
    for ask in ASKS:
        want = {r._title: r for r in matching.judged_titles(spark.createDataFrame([(t or "",) for t in set(TITLES)], "_title string"), query.parse(ask)).collect()}
        for title, r in want.items():
            reason = r.before or r.after
            have = got.get((ask, title))
            if reason is None and r._sure > 0.45:
                assert have == (None, round(r._sure, 9)), (ask, title)
            elif have is not None:
                assert have[0] == reason, (ask, title, have, reason)
    assert sum(reason is None for reason, _ in got.values()) >= 12
    plan = requests.candidates(requests.read_requests(spark.createDataFrame([("a b",)], "request string")), requests.read_titles(titles))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_listings_of_requests_keep_their_bounds(spark):
    listings = spark.createDataFrame(
        [("Apple iPhone 15 128GB", p, "a.example") for p in (10_000, 443_990, 9_000_000, None)] + [(None, 5, None)], "title string, price long, domain string"
    )
    rows = requests.match_requests(spark.createDataFrame([("iphone 15",), ("iphone 15",)], "request string"), listings).collect()
    assert [(r.title, r.price) for r in rows] == [("Apple iPhone 15 128GB", 443_990)]
    assert requests.match_requests(spark.createDataFrame([], "request string"), listings).count() == 0


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(h, 1)))


def test_shoppers_and_stores_within_their_radius(spark):
    r = random.Random(4)
    middles = [(43.2, 76.9), (0.0, 179.999), (-16.5, -179.99), (89.99, 10.0), (-89.95, -170.0), (71.0, 180.0), (60.0, 0.0)]

    def spots(n):
        out = []
        for k in range(n):
            lat, lon = middles[k % len(middles)]
            lat, lon = max(min(lat + r.uniform(-0.2, 0.2), 90.0), -90.0), lon + r.uniform(-0.4, 0.4) / max(math.cos(math.radians(lat)), 0.01)
            out.append((k, lat, (lon + 180) % 360 - 180))
        return out

    a = [(*s, r.choice([300, 500, 1000, 2500, 7500, 25_000])) for s in spots(200)]
    b = spots(300)
    asking = spark.createDataFrame([*a, (900, None, 1.0, 500), (901, 95.0, 1.0, 500), (902, 43.2, 76.9, None)], "shopper long, lat double, lon double, radius_m int")
    standing = spark.createDataFrame([*b, (900, None, 1.0)], "store long, lat double, lon double").withColumn("_x", F.lit("clash"))
    met = stores.within_reach(asking, standing.drop("_x"))
    got = sorted((x.shopper, x.store, x.distance_m) for x in met.collect())
    want = sorted((i, j, d) for i, p, q, rad in a for j, s, t in b if (d := math.floor(metres(p, q, s, t) + 0.5)) <= rad)
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) > 300
    shared = stores.within_cells(asking, standing.drop("_x")).collect()
    assert sorted((x.shopper, x.store, x.distance_m) for x in shared) == got
    assert "NestedLoop" not in met._jdf.queryExecution().toString()
