"""Streams of a search against their batch twins: progress, deadlines, records."""

import inspect
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from pricecompass.operators import budgets, progress
from pricecompass.streaming import progress as streams

EVENTS = "search_id long, seq long, ts timestamp, kind string, domain string, state string, found long, failure string, took_ms long, message string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def told(r, searches=40):
    rows = []
    for s in range(searches):
        begun = T0 + timedelta(seconds=60 * s)
        for k in range(r.randint(1, 25)):
            ts, seq = begun + timedelta(seconds=k), s * 100 + k
            pick = r.random()
            if pick < 0.08:
                message = r.choice(["Search timed out", "no route", "TIME LIMIT hit", None])
                rows.append((s, seq, ts, r.choice(["error", "error", "results"]), None, None, None, None, None, message))
            elif pick < 0.2:
                rows.append((s, seq, ts, "status", None, None, None, None, None, "looking"))
            else:
                done = r.random() < 0.5
                rows.append((s, seq, ts, "domain", f"d{r.randint(0, 5)}", "done" if done else "start", r.randint(0, 9) if done else None, r.choice([None, "blocked"]) if done else None, 7 * k, None))
    return rows


def plain(rows):
    out, by = {}, {}
    for x in sorted(rows, key=lambda x: (x[0], x[1])):
        by.setdefault(x[0], []).append(x)
    for s, events in by.items():
        seen, ended = {}, None
        for _, _, _, kind, domain, state, found, failure, took, message in events:
            if kind in ("results", "error"):
                ended = kind
                if kind == "error":
                    why = "timeout" if message and ("timed out" in message.lower() or "time limit" in message.lower()) else "unreachable"
                    seen = {d: ("done", 0, why, None) if v[0] == "start" else v for d, v in seen.items()}
                break
            if kind == "domain":
                seen[domain] = ("start", None, None, None) if state == "start" else (state, found, failure, took)
        for place, (d, v) in enumerate(seen.items(), 1):
            out[s, d] = (place, *v, ended)
    return out


def keyed(rows):
    return {(x.search_id, x.domain): (x.place, x.state, x.found, x.failure, x.took_ms, x.ended) for x in rows}


def in_parts(frame, order, path, parts=4):
    """Files of frame, later ones later by `order`."""
    low, high = frame.agg(F.min(order), F.max(order)).first()
    step = (high - low) / parts
    for k in range(parts):
        part = frame.where((F.col(order) >= low + k * step) & ((F.col(order) < low + (k + 1) * step) | F.lit(k == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(path)


def source(spark, frame, path):
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_progress_in_batch_and_as_a_stream(spark, tmp_path):
    rows = told(random.Random(6))
    events = spark.createDataFrame(rows, EVENTS)
    want = plain(rows)
    assert keyed(progress.reduced(events).collect()) == want
    assert progress.reduced(events.limit(0)).count() == 0
    in_parts(events, "seq", f"{tmp_path}/in")
    streams.run_once(streams.reduced(source(spark, events, f"{tmp_path}/in")), f"{tmp_path}/state", "reduced")
    got = spark.table("reduced").collect()
    assert len(got) == len({(x.search_id, x.domain) for x in got})
    ended = {k: v for k, v in want.items() if v[-1] is not None}
    assert {k: v for k, v in keyed(got).items() if v[-1] is not None} == ended
    last = max(x[2] for x in rows)
    for (s, d), v in keyed(got).items():  # those that nothing ended are closed by time
        if v[-1] is None:
            was = want[s, d]
            assert v == (was[0], *(("done", 0, "unreachable", None) if was[1] == "start" else was[1:5]), None)
    over = {s for s, _ in want if want_end(rows, s) is None and T0 + timedelta(seconds=60 * s + 110) < last - timedelta(seconds=70)}
    assert over and over <= {x.search_id for x in got}


def want_end(rows, s):
    return next((x[3] for x in sorted(rows, key=lambda x: x[1]) if x[0] == s and x[3] in ("results", "error")), None)


def test_deadlines_as_a_stream_equal_partial_results(spark, tmp_path):
    r = random.Random(9)
    tries = [(s, f"d{k}", r.random() < 0.4, r.randint(0, 45_000), r.choice([None, r.randint(0, 40_000)]), r.randint(0, 9), r.choice([None, "blocked"])) for s in range(30) for k in range(r.randint(1, 6))]
    table = spark.createDataFrame(tries, "search_id long, domain string, known boolean, queued_ms long, took_ms long, found long, failure string")
    want = {(x.search_id, x.domain): x for x in budgets.partial_results(table).collect()}
    rows = []
    for s, d, known, queued, took, found, failure in tries:
        begun = T0 + timedelta(seconds=90 * s)
        rows.append((s, d, begun, begun, True, known, queued, None, None, None))
        if took is not None and queued + took < 52_000:
            rows.append((s, d, begun + timedelta(milliseconds=queued + took), None, False, None, None, took, found, failure))
    rows.append((999, "d", T0 + timedelta(days=1), T0 + timedelta(days=1), True, True, 0, None, None, None))
    schema = "search_id long, domain string, ts timestamp, begun timestamp, asked boolean, known boolean, queued_ms long, took_ms long, found long, failure string"
    frame = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts"))
    in_parts(frame.where("search_id < 999"), "us", f"{tmp_path}/in")
    frame.where("search_id = 999").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    streams.run_once(streams.deadline(source(spark, frame, f"{tmp_path}/in")), f"{tmp_path}/state", "deadlines")
    got = {(x.search_id, x.domain): x for x in spark.table("deadlines").collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        w = want[k]
        assert (x.in_time, x.search_failed, x.found, x.failure, x.took_ms) == (w.in_time, w.search_failed, w.found, w.failure, w.took_ms), k


def test_records_are_written_once_though_the_stream_is_restarted(spark, tmp_path):
    rows = told(random.Random(2), 20)
    events = spark.createDataFrame(rows, EVENTS)
    in_parts(events, "seq", f"{tmp_path}/in")
    write = streams.record_writer(f"{tmp_path}/out", ["search_id", "seq", "kind", "domain", "message"])
    calls = []

    def failing(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost after it was written")

    stream = source(spark, events, f"{tmp_path}/in").where("seq is not null")
    try:
        streams.run_once(stream, f"{tmp_path}/state", sink=failing)
        raise AssertionError("the sink should have failed")
    except Exception as e:
        assert "lost after it was written" in str(e)
    streams.run_once(stream, f"{tmp_path}/state", sink=write)
    back = streams.read_records(spark, f"{tmp_path}/out", "search_id long, seq long, kind string, domain string, message string")
    assert sorted((x.search_id, x.seq, x.kind, x.domain, x.message) for x in back.collect()) == sorted((x[0], x[1], x[3], x[4], x[9]) for x in rows)
    for file in tmp_path.glob("out/*/part-*"):
        text = file.read_text()
        places = [(k, seq) for k, seq in ((int(x.split('"search_id":')[1].split(",")[0]), int(x.split('"seq":')[1].split(",")[0])) for x in text.split("\n\n") if x)]
        assert places == sorted(places) and text.endswith("\n\n")


def test_a_search_asks_its_state_once_a_batch_and_a_stream_has_no_time_limit_of_its_own():
    class Counted:
        def __init__(self):
            self.calls, self.kept = [], {}

        def __getattr__(self, name):
            def call(*a):
                self.calls.append(name)
                if name == "updateValue":
                    self.kept[a[0]] = a[1]
                return {"exists": False, "listTimers": [], "iterator": iter(self.kept.items())}.get(name)

            return call

    def reducer():
        r = streams._Reducer()
        r.handle, r.domains, r.ended = Counted(), Counted(), Counted()
        return r

    def event(seq, kind, state="done"):
        return Row(search_id=1, seq=seq, ts=T0, ms=seq, kind=kind, domain=f"d{seq % 3}", state=state, found=seq, failure=None, took_ms=seq, message=None)

    told = [event(k, "domain") for k in range(40)]
    r = reducer()
    out = list(r.handleInputRows((1,), iter([event(40, "results"), *told]), None))
    assert [(x.domain, x.place, x.found, x.ended) for x in out] == [("d0", 1, 39, "results"), ("d1", 2, 37, "results"), ("d2", 3, 38, "results")]
    assert "updateValue" not in r.domains.calls and len(r.domains.calls) == 2
    r = reducer()
    assert not list(r.handleInputRows((1,), iter(told), None)) and r.domains.calls == ["iterator"] + ["updateValue"] * 3
    assert [x.found for x in r.handleInputRows((1,), iter([event(40, "domain", "start"), event(41, "error")]), None)] == [39, 0, 38]
    assert inspect.signature(streams.run_once).parameters["wait_s"].default is None
