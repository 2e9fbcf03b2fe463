"""Long-lived sessions, results in order and progress as keyed state (ST-05, ST-06, ST-08), by ``transformWithState``.

Each rule is a small class over plain values that is fed rows in order; a stream keeps its state in the state store between micro-batches,
a batch feeds it all rows of a key. So both give the same rows. Streams need the RocksDB state store (``use_state_store``); rows of a key within
a micro-batch are put in order by ``seq``, across micro-batches they are taken as they come. Timers make Spark run batches without data; a query that is to
end with its input (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled=false, and timers then expire with the next data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import slow_threshold
from ..functions.sorted_rows import arrow, arrow_schema, by_key, stretches
from .segmenter import Segmenter

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Rows = list[tuple[Any, ...]]


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(values: Any) -> tuple[Any, ...]:
    """A row's values without the scalars and missing values of pandas."""
    return tuple(None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in values)


def _by_key(rows: DataFrame, key: str, columns: list[str], out: str, fold: Callable[[], Any]) -> DataFrame:
    """The batch form: a rule over all rows of a key, in order of ``seq``. Rows pass one after the other, so a task holds a batch and the rule's state."""
    schema = arrow_schema(out)

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
        rule = fold()
        for new, (keys, *values) in stretches(batches):
            rule = fold() if new else rule
            for r in zip(*values, strict=True):
                for x in rule.feed(*_plain(r)):
                    yield (keys[0], *x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow(fed(batches), schema)

    return by_key(rows.select(key, *columns), key, F.col("seq").asc_nulls_last()).mapInArrow(run, out)


class _Keyed(StatefulProcessor):
    """The stream form: the rule's state in a value state, and a processing-time timer ``wait`` milliseconds after the last rows."""

    def __init__(self, columns: list[str], out: str, state: str, fold: Callable[..., Any]) -> None:
        self.columns, self.names, self.kind, self.fold = columns, [c.split()[0] for c in out.split(", ")], state, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", self.kind)

    def _rule(self) -> Any:
        return self.fold(tuple(self.state.get())) if self.state.exists() else self.fold()

    def _keep(self, rule: Any, timer: Any) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rule.idle:
            self.state.clear()
            return
        self.state.update(rule.state)
        if rule.wait is not None:
            self.handle.registerTimer(int(timer.getCurrentProcessingTimeInMs() + rule.wait))

    def _frame(self, key: Any, rows: Rows) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rule = self._rule()
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        done = [x for r in pdf[self.columns].itertuples(index=False) for x in rule.feed(*_plain(r))]
        self._keep(rule, timerValues)
        if done:
            yield self._frame(key, done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rule = self._rule()
        done = rule.expire()
        self._keep(rule, timerValues)
        if done:
            yield self._frame(key, done)

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, key: str, columns: list[str], out: str, state: str, fold: Callable[..., Any]) -> DataFrame:
    use_state_store(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(_Keyed(columns, out, state, fold), out, "Append", "ProcessingTime")


# sessions

SIGNALS = ["seq", "kind", "start_s", "end_s", "speech"]
EVENTS = "session long, event string, seq long, start_s double, end_s double, frames long, detail string"
SESSION = "start_s double, end_s double, frames long, running boolean, fed_s double, segments long, seq long"


class Session:
    """ST-05: signals (seq, kind, start_s, end_s, speech) of kind start, frame, stop or cancel to events.

    A frame outside a running session is dropped, which is the only lateness rule. Stop ends the open segment and gives ``done`` with the
    seconds fed (end_s) and the number of segments (frames); then the session may start anew. Cancel ends it without result. A
    second start, and a stop of nothing, are errors and change nothing. ``wait`` milliseconds without signals count as a stop.
    """

    def __init__(self, state: tuple[Any, ...] | None = None, wait: int | None = 600_000, **rule: float) -> None:
        start, end, frames, self.running, self.fed, self.segments, self.seq = state or (None, None, 0, False, 0.0, 0, -1)
        self.open = Segmenter(**rule, state=(start, end, frames, False))
        self.wait = wait

    @property
    def idle(self) -> bool:
        return not self.running

    @property
    def state(self) -> tuple[Any, ...]:
        return *self.open.state[:3], self.running, self.fed, self.segments, self.seq

    def _segments(self, found: Rows) -> Rows:
        self.segments += len(found)
        return [("segment", self.seq, a, b, n, None) for a, b, n in found]

    def _end(self, how: str) -> Rows:
        out = [*self._segments(self.open.flush()), ("done", self.seq, None, round(self.fed, 6), self.segments, how)]
        self.running, self.fed, self.segments = False, 0.0, 0
        return out

    def feed(self, seq: int, kind: str, start: float | None, end: float | None, speech: bool | None) -> Rows:
        if not self.running:
            if kind == "stop":
                return [("error", seq, None, None, None, "not-running")]
            if kind == "start":
                self.running, self.seq = True, seq
            return []
        self.seq = seq
        if kind == "start":
            return [("error", seq, None, None, None, "already-running")]
        if kind == "stop":
            return self._end("stop")
        if kind == "cancel":
            self.open.flush()
            self.running, self.fed, self.segments = False, 0.0, 0
            return []
        self.fed += end - start
        return self._segments(self.open.feed(start, end, bool(speech)))

    def expire(self) -> Rows:
        return self._end("timeout") if self.running else []


def session_events(signals: DataFrame, **rule: Any) -> DataFrame:
    """ST-05 over complete logs of signals (session, seq, kind, start_s, end_s, speech)."""
    return _by_key(signals, "session", SIGNALS, EVENTS, lambda: Session(**rule))


def session_stream(signals: DataFrame, **rule: Any) -> DataFrame:
    """ST-05 over a stream of signals."""
    return _stream(signals, "session", SIGNALS, EVENTS, SESSION, lambda state=None: Session(state, **rule))


# results in order

RESULTS = ["seq", "start_s", "end_s", "text", "error"]
ORDERED = "session long, seq long, start_s double, end_s double, text string, error string"
WAITING = "next long, held array<struct<seq:bigint,start_s:double,end_s:double,text:string,error:string>>"


class InOrder:
    """ST-06: results (seq from 0, start_s, end_s, text, error) leave by number: one that comes early waits for those before it, one that failed
    keeps its place with its error, and an empty text takes its place but isn't shown. A number that was passed already is dropped."""

    wait = None

    def __init__(self, state: tuple[Any, ...] | None = None) -> None:
        self.next, held = state or (0, [])
        self.held = {x[0]: tuple(x) for x in held}

    idle = False  # the next number stays known

    @property
    def state(self) -> tuple[Any, ...]:
        return self.next, sorted(self.held.values())

    def feed(self, *result: Any) -> Rows:
        if result[0] >= self.next:
            self.held.setdefault(result[0], result)
        out = []
        while self.next in self.held:
            r = self.held.pop(self.next)
            self.next += 1
            if r[4] is not None or (r[3] or "").strip():
                out.append((*r[:3], r[3] if r[4] is None else None, r[4]))
        return out

    def expire(self) -> Rows:
        return []


def results_in_order(results: DataFrame) -> DataFrame:
    """ST-06 over complete results (session, seq, start_s, end_s, text, error); what follows a gap is not shown."""
    return _by_key(results, "session", RESULTS, ORDERED, InOrder)


def results_stream(results: DataFrame) -> DataFrame:
    """ST-06 over a stream of results that come in any order, a recogniser's tasks being parallel."""
    return _stream(results, "session", RESULTS, ORDERED, WAITING, InOrder)


# progress

STATUS = ["seq", "at_s", "phase", "done", "total", "limit_ms"]
PROGRESS = "job_id long, seq long, at_s double, phase string, remaining_s double, in_phase_s double, slow boolean"
JOB = "seq long, at_s double, phase string, begun double, smooth double, since double, limit_ms double, warned boolean"
WORKING = ("overlap", "recognizing", "separating")


class Progress:
    """ST-08, WN-14: status rows with the smoothed remaining time, the seconds in the running phase and whether that is slow.

    Remaining time is known in working phases after a second and before the end, and smoothed with ``keep``; queued and finalizing leave it
    as it is, other phases forget it. In a stream a job that says nothing past its phase's limit gives one row by itself (slow, at the time the limit was reached).
    """

    def __init__(self, state: tuple[Any, ...] | None = None, keep: float = 0.72) -> None:
        self.seq, self.at, self.phase, self.begun, self.smooth, self.since, self.limit, self.warned = state or (None, None, None, None, None, None, None, False)
        self.keep = keep

    idle = False

    @property
    def state(self) -> tuple[Any, ...]:
        return self.seq, self.at, self.phase, self.begun, self.smooth, self.since, self.limit, self.warned

    @property
    def wait(self) -> float | None:
        """Milliseconds from the last status to the limit of its phase."""
        return None if self.limit is None or self.warned or self.at is None else max(0.0, self.limit - (self.at - self.since) * 1000) + 1

    def _remaining(self, at: float, phase: str, done: float, total: float) -> float | None:
        if phase not in WORKING:
            if phase not in ("queued", "finalizing"):
                self.begun = self.smooth = None
            return None
        self.begun = at if self.begun is None else self.begun
        spent = max(0.0, at - self.begun)
        if not total or total <= 0 or not done or done <= 0 or spent < 1 or done >= total:
            return None
        raw = (total - done) / (done / spent)
        self.smooth = raw if self.smooth is None else self.smooth * self.keep + raw * (1 - self.keep)
        return self.smooth

    def feed(self, seq: int, at: float, phase: str, done: float, total: float, limit: float | None) -> Rows:
        if phase != self.phase or self.since is None:
            self.phase, self.since, self.warned = phase, at, False
        self.seq, self.at, self.limit = seq, at, limit
        slow = limit is not None and (at - self.since) * 1000 > limit
        self.warned |= slow
        return [(seq, at, phase, self._remaining(at, phase, done, total), at - self.since, slow)]

    def expire(self) -> Rows:
        if self.limit is None or self.warned:
            return []
        self.warned = True
        return [(self.seq, self.since + self.limit / 1000, self.phase, None, self.limit / 1000, True)]


def _limits(status: DataFrame) -> DataFrame:
    return status.withColumn("limit_ms", slow_threshold(F.col("phase"), F.col("audio_s")).cast("double"))


def progress(status: DataFrame) -> DataFrame:
    """ST-08 over complete status rows (job_id, seq, at_s, phase, done, total, audio_s)."""
    return _by_key(_limits(status), "job_id", STATUS, PROGRESS, Progress)


def progress_stream(status: DataFrame) -> DataFrame:
    """ST-08 over a stream of status rows."""
    return _stream(_limits(status), "job_id", STATUS, PROGRESS, JOB, Progress)


# caches

ACCESS = ["seq", "entry"]
CACHED = "cache long, seq long, entry string, hit boolean, evicted string"


class Recent:
    """CN-18: accesses (seq, entry) to a cache of ``capacity`` entries: whether the entry was there, and which one it drove out.

    With ``refresh`` a read makes its entry the most recent one (analyses, capacity 12); without, entries leave in the order in which they came
    (embeddings, capacity 10). The state is the entries there are, the next to go first.
    """

    wait = None
    idle = False

    def __init__(self, state: tuple[Any, ...] | None = None, capacity: int = 12, refresh: bool = True) -> None:
        self.held = dict.fromkeys(state[0] if state else [])
        self.capacity, self.refresh = capacity, refresh

    @property
    def state(self) -> tuple[Any, ...]:
        return (list(self.held),)

    def feed(self, seq: int, entry: str) -> Rows:
        hit, evicted = entry in self.held, None
        if hit and self.refresh:
            self.held.pop(entry)
        self.held.setdefault(entry)
        if len(self.held) > self.capacity:
            evicted = next(iter(self.held))
            self.held.pop(evicted)
        return [(seq, entry, hit, evicted)]

    def expire(self) -> Rows:
        return []


def cache_accesses(log: DataFrame, capacity: int = 12, refresh: bool = True) -> DataFrame:
    """CN-18 over complete logs (cache, seq, entry) of one access each."""
    return _by_key(log, "cache", ACCESS, CACHED, lambda: Recent(None, capacity, refresh))


def cache_stream(log: DataFrame, capacity: int = 12, refresh: bool = True) -> DataFrame:
    """CN-18 over a stream of accesses."""
    return _stream(log, "cache", ACCESS, CACHED, "entries array<string>", lambda state=None: Recent(state, capacity, refresh))


def cache_key(path: Column, size: Column, mtime_ms: Column, start: Column, end: Column, speakers: Column, models: Column, version: int = 2) -> Column:
    """CN-18, CF-09: what makes an analysis the same one: the file with its size and whole milliseconds of change, the range, the number of speakers,
    the models (array of structs of path, size and time) and the version of the analysis."""
    parts = F.struct(
        F.lit(version).alias("version"), path.alias("path"), size.cast("long").alias("size"), F.floor(mtime_ms).cast("long").alias("mtime"), start.cast("double").alias("start"),
        end.cast("double").alias("end"), speakers.cast("int").alias("speakers"), models.alias("models"),
    )
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)
