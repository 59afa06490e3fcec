import random
from datetime import datetime, timedelta

import pytest

from lectern.streaming import stateful as S
from lectern.streaming import streams

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, tmp_path, files, schema, make, name, mode):
    """A stream over one file after the other."""
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return streams.drained(make(stream), spark, name, mode, str(tmp_path / "check"))


def item(i, t=0, body="x"):
    return (f"i{i}", at(t), body)


RESPONSES = [
    ("d", 1, at(0), 3, None, None, None, None),
    ("d", 1, at(0), 3, "a", at(1), True, [item(1), item(2, 5)]), ("d", 1, at(0), 3, "b", at(2), False, None), ("d", 1, at(0), 3, "c", at(3), True, [item(1, 0, "later")]),
    ("d", 2, at(20), 3, "a", at(29), True, [item(9)]), ("d", 2, at(20), 3, "b", at(21), False, None),  # a is late, c missing
    ("d", 3, at(40), 2, "a", at(41), True, []), ("d", 3, at(40), 2, "a", at(42), False, None),
    ("e", 1, at(0), 2, None, None, None, None), ("e", 2, at(20), 1, "a", at(28), True, [item(3), item(0), (None, None, "y")]),
    ("f", 1, at(100), 1, "a", at(101), True, [item(5)]),
]
WANT = {
    ("d", 1): ("complete", 3, 2, at(3), at(303), [item(2, 5), item(1, 0, "later")]), ("d", 2): ("stale", 1, 0, at(28), at(88), [item(2, 5), item(1, 0, "later")]),
    ("d", 3): ("partial", 1, 1, at(48), at(348), []), ("e", 1): ("unavailable", 0, 0, at(8), None, None), ("e", 2): ("complete", 1, 1, at(28), at(328), [item(0), item(3), (None, None, "y")]),
    ("f", 1): ("complete", 1, 1, at(101), at(401), [item(5)]),
}


def told(rows):
    return {(r.desk, r.round): (r.status, r.came, r.ok, r.closed, r.served_until, None if r["items"] is None else [tuple(i) for i in r["items"]]) for r in rows}


def test_fan_in_batch(spark):
    df = spark.createDataFrame([r for r in RESPONSES if r != RESPONSES[9]], S.RESPONSES)
    want = dict(WANT)
    want["e", 2] = ("complete", 1, 1, at(28), at(328), [item(0), item(3)])
    fixed = [r if r[0:2] != ("e", 2) else (*r[:7], r[7][:2]) for r in RESPONSES]
    assert told(S.fan_in_batch(spark.createDataFrame(fixed, S.RESPONSES)).collect()) == want
    assert S.fan_in_batch(df.limit(0)).count() == 0


def test_fan_in_stream(spark, tmp_path):
    """Late, missing and failing feeds; the rows of a round in several batches and out of order."""
    fixed = [r if r[0:2] != ("e", 2) else (*r[:7], r[7][:2]) for r in RESPONSES]
    early, rest = [r for r in fixed if r[1] == 1 and r[0] != "f"], [r for r in fixed if r[1] != 1 or r[0] == "f"]
    end = [(d, 99, at(1000), 1, None, None, None, None) for d in "def"]
    files = [early[::2], early[1::2], rest[:2], rest[2:], end]
    got = told(run(spark, tmp_path, files, S.RESPONSES, lambda s: S.fan_in_stream(s, late="30 seconds"), "fan_in", "append").collect())
    want = dict(WANT)
    want["e", 2] = ("complete", 1, 1, at(28), at(328), [item(0), item(3)])
    assert got == want  # the last round is still open


def random_events(seed, n=120):
    r = random.Random(seed)
    return [(f"u{r.randrange(6)}", k, r.choice(["start", "complete", "partial", "fail", "restart", None]), at(10 * k)) for k in range(n)]


def test_crawl_records(spark, tmp_path):
    """Events late within the watermark give what the batch form gives; state is bounded by the watermark."""
    events = random_events(4)
    r = random.Random(5)
    late = sorted(events, key=lambda e: e[1] + r.randrange(8))  # up to 80 seconds late
    files = [late[i : i + 15] for i in range(0, len(late), 15)]
    schema = "url string, seq long, event string, at timestamp"
    got = run(spark, tmp_path, files, schema, lambda s: S.crawl_records(s, "2 minutes"), "records", "update").collect()
    want = {x.url: (x.status, x.attempts) for x in streams.crawl_states_batch(spark.createDataFrame(events, schema).drop("at")).collect()}
    last = {}
    for x in got:
        last[x.url] = max(last.get(x.url, (0,)), (x.version, x.status, x.attempts))
    assert {u: v[1:] for u, v in last.items()} == want
    # 120 events of 6 records are spread over 1,200 seconds: what waits is what the watermark leaves open, not all
    assert max(x.pending for x in got) <= 27 and sum(e[0] == "u0" for e in events) > 12


def test_state_is_bounded(spark, tmp_path):
    """One record of many events: the list never holds more than the watermark's span and one batch."""
    events = [("u", k, "start", at(10 * k)) for k in range(200)]
    got = run(spark, tmp_path, [events[i : i + 20] for i in range(0, 200, 20)], "url string, seq long, event string, at timestamp", lambda s: S.crawl_records(s, "60 seconds"), "bounded", "update").collect()
    assert max(x.attempts for x in got) == 200 and max(x.pending for x in got) <= 20 + 20 + 7


def test_records_are_forgotten(spark, tmp_path):
    events = [[("u", 1, "start", at(0))], [("v", 2, "start", at(5000))], [("v", 3, "start", at(5001))], [("u", 4, "complete", at(6000))], [("v", 5, "fail", at(6001))]]
    got = run(spark, tmp_path, events, "url string, seq long, event string, at timestamp", lambda s: S.crawl_records(s, "10 seconds", keep="10 minutes"), "forgotten", "update").collect()
    assert [(x.status, x.attempts) for x in got if x.url == "u"] == [("downloading", 1), ("complete", 0)]


class Held:
    """State in memory, which counts what is read from it."""

    def __init__(self, counts):
        self.held, self.counts = {}, counts

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        self.counts["read"] += 1
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        for k, v in list(self.held.items()):
            self.counts["read"] += 1
            yield k, v

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, v):
        self.held[None] = v

    def clear(self):
        self.held.clear()


class Handle:
    def __init__(self):
        self.counts, self.timers = {"read": 0}, set()

    def getMapState(self, *_):
        return Held(self.counts)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return 10**15


def test_fan_in_reads_a_round_once_to_close_it():
    """A desk of many rounds: closing one doesn't read the others' responses."""
    handle, desk = Handle(), S.FanIn(8_000)
    desk.init(handle)
    rows = [S.Row(round=k, started=at(20 * k), expected=9, source=f"s{n}", at=at(20 * k + n), ok=True, items=[item(n)]) for k in range(40) for n in range(9)]
    assert list(desk.handleInputRows(("d",), iter(rows), handle)) == []
    got, fired = [], set()
    while due := handle.timers - fired:
        fired.add(min(due))
        got += desk.handleExpiredTimer(("d",), handle, None)
    assert [(r.round, r.status, r.came) for r in got] == [(k, "complete", 9) for k in range(40)]
    assert handle.counts["read"] <= len(rows)  # not a desk's responses for each of its rounds


def test_fan_in_keeps_microseconds(spark, tmp_path):
    late = T0 + timedelta(seconds=3, microseconds=123457)
    files = [[("d", 1, T0 + timedelta(microseconds=7), 1, "a", late, True, [item(1)]), ("d", 2, T0 + timedelta(seconds=20, microseconds=7), 1, None, None, None, None)], [("d", 99, at(1000), 1, None, None, None, None)]]
    got = told(run(spark, tmp_path, files, S.RESPONSES, lambda s: S.fan_in_stream(s, late="30 seconds"), "micros", "append").collect())
    served = late + timedelta(seconds=300)
    closed = T0 + timedelta(seconds=28, microseconds=7)
    assert got == {("d", 1): ("complete", 1, 1, late, served, [item(1)]), ("d", 2): ("stale", 0, 0, closed, closed + timedelta(seconds=60), [item(1)])}
