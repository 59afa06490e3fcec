"""Streams with state of their own and timers: a fan-in with a deadline, and crawl records folded up to the watermark.

Both work in event time: what comes too late for the watermark is dropped by Spark, timers fire when the watermark passes them, and the result
is that of the batch form, in whatever order and batches the rows come. State lives in RocksDB (:func:`with_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from lectern.streaming.streams import TRANSITIONS

#: How long what a fan-in gave is served: after a round with any source, and after one in which all failed. Fixed values.
SERVED, SERVED_STALE = "300 seconds", "60 seconds"
#: Rows that a desk folds in memory before they go to its state.
FOLDED = 50_000
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RESPONSES = "desk string, round long, started timestamp, expected int, source string, at timestamp, ok boolean, items array<struct<id:string,published:timestamp,body:string>>"
ROUNDS = "desk string, round long, status string, came int, ok int, closed timestamp, served_until timestamp, items array<struct<id:string,published:timestamp,body:string>>"


def with_rocksdb(spark: SparkSession) -> None:
    """Lets the session's streams keep their state in RocksDB, which state of several variables needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def _millis(t: datetime) -> int:
    """A timestamp as a worker gets it, naive in the process's zone or with a zone, in milliseconds."""
    return round(t.timestamp() * 1000)


def _micros(t: datetime) -> int:
    """The same in microseconds, which is as exact as Spark's timestamps."""
    return (t.astimezone(UTC) - EPOCH) // timedelta(microseconds=1)


def _time(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _item(i) -> tuple:
    """An item as rows and state give it."""
    return tuple(i[k] for k in ("id", "published", "body")) if isinstance(i, dict) else tuple(i)


def _response(r) -> tuple:
    """A response as state gives it."""
    return tuple(r[k] for k in ("source", "at", "ok", "items")) if isinstance(r, dict) else tuple(r)


def _together(known: tuple[int, int, dict] | None, new: tuple[int, int, dict]) -> tuple[int, int, dict]:
    """A round's earliest start, greatest number of expected sources, and each source's first response (at one time one that failed)."""
    if known is None:
        return new
    held = known[2]
    for source, response in new[2].items():
        old = held.get(source)
        if old is None or (response[0], bool(response[1])) < (old[0], bool(old[1])):
            held[source] = response
    return min(new[0], known[0]), max(new[1], known[1]), held


# --- fan-in ---------------------------------------------------------------------------------------


def fan_in_batch(responses: DataFrame, deadline: str = "8 seconds") -> DataFrame:
    """One row per desk and round of ``responses``: what came within the ``deadline`` after its start.

    A row without source only opens its round. A source's first response in time counts; of items of one id the last to come (then of the greatest source). ``status``:
    *complete* if all expected sources came, *partial* if not, *stale* if none that came was well and an earlier round gave
    items (those are given again), *unavailable* if there was none. Items: newest first, then by id. A round closes when the last expected
    source has come, else at its deadline.
    """
    by = ["desk", "round"]
    limit = F.col("started") + F.expr(f"INTERVAL {deadline}")
    rounds = responses.groupBy(*by).agg(F.min("started").alias("started"), F.max("expected").alias("expected"))
    came = responses.where("source IS NOT NULL").drop("started", "expected").join(rounds.select(*by, "started"), by).where(F.col("at") <= limit)
    first = came.groupBy(*by, "source").agg(F.min_by(F.struct("at", "ok", "items"), F.struct("at", F.col("ok").cast("int"))).alias("r")).select(*by, "source", "r.*")
    tally = first.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("came"), F.count_if("ok").cast("int").alias("ok"), F.max("at").alias("last"))
    item = first.where("ok").select(*by, "source", "at", F.explode("items").alias("i"))
    item = item.groupBy(*by, F.col("i.id").alias("id")).agg(F.max_by("i", F.struct("at", "source")).alias("i"))
    ordered = F.array_sort(F.collect_list("i"), _newest_first)
    lists = item.groupBy(*by).agg(ordered.alias("own"))
    told = rounds.join(tally, by, "left").join(lists, by, "left").fillna(0, ["came", "ok"])
    own = F.when(F.col("ok") > 0, F.coalesce("own", F.array().cast(_schema(ROUNDS)["items"].dataType)))
    told = told.withColumn("own", own)
    earlier = F.last("own", ignorenulls=True).over(Window.partitionBy("desk").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    items = F.coalesce("own", earlier)
    status = F.when(F.col("ok") > 0, F.when(F.col("came") >= F.col("expected"), "complete").otherwise("partial")).otherwise(F.when(items.isNotNull(), "stale").otherwise("unavailable"))
    closed = F.when(F.col("came") >= F.col("expected"), F.coalesce("last", "started")).otherwise(limit)
    until = F.when(F.col("ok") > 0, closed + F.expr(f"INTERVAL {SERVED}")).when(items.isNotNull(), closed + F.expr(f"INTERVAL {SERVED_STALE}"))
    return told.select(*by, status.alias("status"), "came", "ok", closed.alias("closed"), until.alias("served_until"), items.alias("items"))


def _newest_first(a: Column, b: Column) -> Column:
    by_time = F.when(a["published"] > b["published"], -1).when(a["published"] < b["published"], 1)
    return F.coalesce(F.when(a["published"].isNull() & b["published"].isNotNull(), 1).when(a["published"].isNotNull() & b["published"].isNull(), -1), by_time, F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1), F.lit(0))


class FanIn(StatefulProcessor):
    """State of a desk: its open rounds (start, expected, responses), the first of them, the last items given, and the last round closed.

    Rounds close in their order, at the watermark after the deadline; then nothing of them is kept. A batch's rows are folded before they meet the state, ``FOLDED``
    at most at a time, so that a round's entry is read and written once for all rows of a batch, and once more when it closes. Only the first open round has a timer. Times are in microseconds.
    """

    def __init__(self, deadline_ms: int):
        self.deadline = deadline_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getMapState("rounds", "round long", "started long, expected int, told array<struct<source:string,at:long,ok:boolean,items:array<struct<id:string,published:timestamp,body:string>>>>")
        self.first = handle.getValueState("first", "round long, due long")
        self.last = handle.getValueState("last", "items array<struct<id:string,published:timestamp,body:string>>")
        self.closed = handle.getValueState("closed", "round long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = self.closed.get()[0] if self.closed.exists() else None
        told: dict[int, tuple[int, int, dict[str, tuple]]] = {}
        n = 0
        for r in rows:
            if done is not None and r.round <= done:
                continue
            responses = {} if r.source is None else {r.source: (_micros(r.at), r.ok, [_item(i) for i in r["items"] or ()] if r.ok else [])}
            told[r.round] = _together(told.get(r.round), (_micros(r.started), r.expected or 0, responses))
            n += 1
            if n >= FOLDED:
                self._keep(told)
                told, n = {}, 0
        self._keep(told)
        yield from ()

    def _keep(self, told: dict[int, tuple[int, int, dict[str, tuple]]]) -> None:
        """Brings what rows tell of rounds into the state."""
        for round_, new in told.items():
            known = self._held(round_) if self.rounds.containsKey((round_,)) else None
            start, expected, responses = told[round_] = _together(known, new)
            self.rounds.updateValue((round_,), (start, expected, [(s, *v) for s, v in responses.items()]))
        if told:
            first = min(told)
            if not self.first.exists() or first <= self.first.get()[0]:
                self._await(first, told[first][0])

    def _held(self, round_: int) -> tuple[int, int, dict[str, tuple]]:
        start, expected, told = self.rounds.getValue((round_,))
        return start, expected, {s: (at, ok, [_item(i) for i in items or ()]) for s, at, ok, items in map(_response, told)}

    def _await(self, round_: int, start: int) -> None:
        """The first open round's timer: in whole milliseconds, not before the deadline."""
        due = -(-(start + self.deadline) // 1000)
        self.first.update((round_, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.first.exists() or self.first.get()[1] > now:
            return  # a timer of before the round's start was known better
        for (round_,) in sorted(map(tuple, self.rounds.keys())):
            start, expected, responses = self._held(round_)
            if start + self.deadline > now * 1000:
                self._await(round_, start)
                return  # later rounds wait for this one
            yield self._close(key[0], round_, start, expected, responses)
        self.first.clear()

    def _close(self, desk: str, round_: int, start: int, expected: int, responses: dict[str, tuple]) -> Row:
        came = sorted((at, s, ok, items) for s, (at, ok, items) in responses.items() if at <= start + self.deadline)
        well = [c for c in came if c[2]]
        items = None
        if well:
            found = {i[0]: i for _, _, _, own in well for i in own}
            items = sorted(sorted(found.values(), key=lambda i: i[0]), key=lambda i: (i[1] is not None, i[1] or datetime.min), reverse=True)
            items = [i for _, same in _runs(items) for i in sorted(same, key=lambda i: i[0])]
            self.last.update((items,))
        elif self.last.exists():
            items = list(map(_item, self.last.get()[0]))
        whole = len(came) >= expected
        closed = max((c[0] for c in came), default=start) if whole else start + self.deadline
        served = {"complete": 300, "partial": 300, "stale": 60, "unavailable": None}
        status = ("complete" if whole else "partial") if well else "unavailable" if items is None else "stale"
        until = None if served[status] is None else _time(closed) + timedelta(seconds=served[status])
        self.rounds.removeKey((round_,))
        self.closed.update((round_,))
        named = None if items is None else [dict(zip(("id", "published", "body"), i, strict=True)) for i in items]
        return Row(desk=desk, round=round_, status=status, came=len(came), ok=len(well), closed=_time(closed), served_until=until, items=named)

    def close(self) -> None:
        """Nothing is held outside the state."""


def _runs(items: list[tuple]) -> Iterator[tuple]:
    """Items of one time together."""
    at = 0
    while at < len(items):
        to = at
        while to < len(items) and items[to][1] == items[at][1]:
            to += 1
        yield items[at][1], items[at:to]
        at = to


def fan_in_stream(responses: DataFrame, deadline: str = "8 seconds", late: str = "10 seconds") -> DataFrame:
    """The same as a stream: a row for each round once the watermark has passed its deadline. ``late``: how much later than its time a row may come."""
    number, unit = deadline.split()
    ms = int(float(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])
    marked = responses.withColumn("seen", F.coalesce("at", "started")).withWatermark("seen", late)
    return marked.groupBy("desk").transformWithState(FanIn(ms), ROUNDS, "Append", "EventTime")


# --- crawl records ---------------------------------------------------------------------------------

STATES = "url string, status string, attempts int, seq long, version long, pending int"


def _fold(status: str, attempts: int, event: str | None) -> tuple[str, int]:
    if event in TRANSITIONS and (event != "restart" or status == "downloading"):
        status = TRANSITIONS[event]
    return status, attempts + (event == "start")


class CrawlRecord(StatefulProcessor):
    """State of a url: the record folded up to the watermark, and the events after it.

    No event of before the watermark can come any more, so those are folded for good and dropped; the events of the last ``late`` wait in order. A record
    without events for ``keep`` is forgotten, and a later event begins it anew.
    """

    def __init__(self, keep_ms: int | None):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "status string, attempts int, seq long, at long, n long")
        self.pending = handle.getListState("pending", "at long, seq long, event string")

    def _settle(self, watermark: int) -> tuple[tuple, list[tuple]]:
        """Folds what the watermark has passed; gives the folded record and what is still open."""
        record = tuple(self.folded.get()) if self.folded.exists() else ("pending", 0, -1, -1, 0)
        waiting = sorted((tuple(p) for p in self.pending.get()), key=lambda p: p[:2])
        n = sum(p[0] < watermark for p in waiting)
        for at, seq, event in waiting[:n]:
            record = (*_fold(record[0], record[1], event), max(seq, record[2]), at, record[4] + 1)
        if n:
            self.folded.update(record)
            self.pending.clear()
            if waiting[n:]:
                self.pending.put(waiting[n:])
        return record, waiting[n:]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            at = _millis(r.at)
            self.pending.appendValue((at, r.seq, r.event))
            self.handle.registerTimer(at + 1)
            if self.keep is not None:
                self.handle.registerTimer(at + 1 + self.keep)
        record, waiting = self._settle(timerValues.getCurrentWatermarkInMs())
        status, attempts = record[:2]
        for _, _, event in waiting:
            status, attempts = _fold(status, attempts, event)
        yield Row(url=key[0], status=status, attempts=attempts, seq=max([record[2], *(w[1] for w in waiting)]), version=record[4] + len(waiting), pending=len(waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        record, waiting = self._settle(now := timerValues.getCurrentWatermarkInMs())
        if self.keep is not None and not waiting and record[3] + self.keep < now:
            self.folded.clear()
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state."""


def crawl_records(events: DataFrame, late: str = "10 minutes", keep: str | None = None) -> DataFrame:
    """A record's present state at each change, from events(url, seq, event, at) whose ``seq`` grows with their time.

    The row of the highest ``version`` (how many events came so far) is the present state: that of ``crawl_states_batch`` over all events that came in time. ``pending``: how many events wait.
    """
    ms = None if keep is None else int(float(keep.split()[0]) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[keep.split()[1].rstrip("s")])
    return events.withWatermark("at", late).groupBy("url").transformWithState(CrawlRecord(ms), STATES, "Update", "EventTime")
