import random

import pytest
from pyspark.sql import functions as F

from pricecompass.functions import geo, matching, query
from pricecompass.functions import values as V
from pricecompass.operators import chunks, ranking, stores

GOLDEN = [
    ("iPhone 15", "Смартфон Apple iPhone 15 128GB Black", 443_990, None),
    ("iPhone 15", "Чехол для iPhone 15 силиконовый черный", 3_990, "accessory: case"),
    ("Samsung Galaxy A17", "Смартфон Samsung Galaxy S24 Ultra 12/512GB Titanium Black", 450_000, 'missing model identifier "a17"'),
    ("Galaxy A5", "Смартфон Samsung Galaxy A55 8/256GB", 189_990, 'missing model identifier "a5"'),
    ("iPhone 15 256GB", "Apple iPhone 15 128GB Black", 443_990, "wrong storage (128GB, wanted 256GB)"),
    ("MacBook Air M2 16GB 512GB", "Apple MacBook Air M2 8GB 512GB Midnight", 599_990, "wrong RAM (8GB, wanted 16GB)"),
    ("Samsung S24+", "Samsung Galaxy S24 Plus 256GB", 400_000, None),
    ("iPhone 15", "Apple iPhone 15 128GB с зарядным устройством в комплекте", 450_000, None),
    ("самсунг галакси а17", "Samsung Galaxy A17 8/256GB Black", 120_000, None),
    ("Samsung Galaxy Z Fold5", "Samsung Galaxy Z Fold 5 512GB", 700_000, None),
    ("Nvidia RTX 4090", "AMD RTX 4090 Graphics Card", 900_000, "wrong component family (wanted nvidia)"),
    ("charger for iPhone 15", "Premium Case for Apple iPhone 15", 45_000, "not the requested charger"),
]


@pytest.mark.parametrize("ask,title,price,reason", GOLDEN)
def test_match(spark, ask, title, price, reason):
    rows = spark.createDataFrame([(title, price)], "title string, price long")
    row = matching.match(rows, query.parse(ask)).first()
    assert row.reject_reason == reason
    assert row.rejected == (reason is not None)


@pytest.mark.parametrize(
    "text,storage,ram,search",
    [
        ("iPhone 15 Pro 256", 256, None, "iphone 15 pro"),
        ("MacBook Air M2 16 GB RAM 1 TB SSD", 1024, 16, None),
        ("Laptop 1.5TB", 1536, None, "laptop"),
        ("iPhone 12/128", 128, None, None),
        ("MacBook Pro M3 36/512", 512, 36, None),
        ("please find the cheapest iPhone 15 near me", None, None, "iphone 15"),
        ("16GB RAM", None, 16, "ram"),
        ("laptop 99999999999999999999GB 16GB", None, 16, "laptop"),
        ("ноутбук озу 8 гб встроенная память 2тб", 2048, 8, None),
    ],
)
def test_parse(spark, text, storage, ram, search):
    found = query.parse(text)
    assert (found.storage, found.ram) == (storage, ram)
    assert search is None or found.search_term == search


def test_match_takes_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(None, None, 1), ("", 5, 2)], "title string, price long, tokens int")
    assert [r.reject_reason for r in matching.match(rows, query.parse("iphone 15")).collect()] == ["title too short"] * 2


def _fold(rows):
    best = None
    for at, c, p in rows:
        if best is None or c > best[1] + V.TOLERANCE or (abs(c - best[1]) <= V.TOLERANCE and p < best[2]):
            best = (at, c, p)
    return best


def test_fold_is_the_sequential_one(spark):
    r = random.Random(3)
    rows = [("a" if r.random() < 0.7 else "b", k, r.choice([0.5, 0.62, 0.7, 0.8, 0.9, 1.0]), r.randint(1, 400)) for k in range(3000)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "domain string, k long, confidence double, price long")
    frame = frame.select("domain", F.struct("k").alias("at"), "confidence", "price")
    found = {x.domain: x["at"].k for x in chunks.best_listings(frame, V.TOLERANCE).collect()}
    assert found == {d: _fold(sorted(x[1:] for x in rows if x[0] == d))[0] for d in "ab"}
    assert chunks.best_listings(frame.limit(0), V.TOLERANCE).count() == 0


def test_fold_of_many_confidences(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), k, r.random(), r.randint(1, 400)) for k in range(3000)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "domain string, k long, confidence double, price long").select("domain", F.struct("k").alias("at"), "confidence", "price")
    want = {d: _fold(sorted(x[1:] for x in rows if x[0] == d))[0] for d in ("a", "b", None)}
    assert {x.domain: x["at"].k for x in chunks.best_listings(frame, V.TOLERANCE).collect()} == want  # more than MOST_LEVELS of them
    few = frame.withColumn("confidence", F.round("confidence", 1))
    want = {x.domain: x["at"].k for x in chunks.best_listings(few, V.TOLERANCE).collect()}
    monkeypatch.setattr(chunks, "MOST_LEVELS", 3)
    assert {x.domain: x["at"].k for x in chunks.best_listings(few, V.TOLERANCE).collect()} == want
    assert chunks.best_listings(few.limit(0), V.TOLERANCE).count() == 0


def test_anchored_windows_are_the_sequential_ones(spark):
    r = random.Random(5)
    events = [(r.choice("aaab"), k, r.randint(0, 5000)) for k in range(2000)]
    frame = spark.createDataFrame(events, "key string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {x.id: (x.start, x.nth) for x in chunks.anchored_windows(frame, "key", "ts", "id", 60_000_000).collect()}
    want = {}
    for key in "ab":
        start = n = None
        for s, k in sorted((s, k) for key2, k, s in events if key2 == key):
            if start is None or s >= start + 60:
                start, n = s, 0
            want[k] = (start * 1_000_000, n)
            n += 1
    assert found == want


def test_pins_greedy(spark):
    r = random.Random(9)
    rows = [(k, "A" if r.random() < 0.8 else "B", 43.2 + r.random() * 0.003, 76.8 + r.random() * 0.003) for k in range(150)]
    rows += [(k, "A", 43.2, 76.8) for k in range(150, 200)]
    frame = stores.with_distance(spark.createDataFrame(rows, "pos long, name string, lat double, lon double"), (43.2, 76.8))
    data = sorted((x.distance_m, x.pos, x.name, x.lat, x.lon) for x in frame.collect())
    from math import asin, cos, floor, radians, sin, sqrt

    def metres(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * V.EARTH_M * asin(sqrt(h))

    cell = lambda x: floor(x / V.CELL_DEG)
    kept = []
    for d in data:
        near = lambda k: k[2] == d[2] and abs(cell(k[3]) - cell(d[3])) <= 2 and abs(cell(k[4]) - cell(d[4])) <= 2  # noqa: B023, E731
        if not any(near(k) and metres(k[3], k[4], d[3], d[4]) < V.SAME_PIN_M for k in kept):
            kept.append(d)
    assert {x.pos for x in stores.dedupe_pins(frame).collect()} == {k[1] for k in kept}


def test_near_and_dear_beats_cheap_and_far(spark):
    rows = spark.createDataFrame([(443_000, 700), (440_000, 22_000)], "price long, m long")
    found = rows.withColumns(geo.cost_columns(F.col("price"), F.col("m"))).collect()
    assert [(r.travel, r.time_cost, r.total) for r in found] == [(64, 339, 443_403), (2_002, 3_360, 445_362)]


def test_stock_preference(spark):
    rows = spark.createDataFrame([("a", False, 1), ("a", None, 2), ("b", False, 3)], "domain string, in_stock boolean, k int")
    assert {r.k for r in ranking.purchasable(rows).collect()} == {2, 3}
