"""Streaming segmentation (ST-02..09): frames with a speech flag to finalised segments, by one rule for batch and stream.

A segment ends after ``silence`` seconds without speech, or at ``most`` seconds; shorter than ``least`` it is dropped. The state of a
session is the open segment alone. Frames after a session's stop marker are dropped, which is the only lateness rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import slow_threshold

SEGMENT = "session long, start_s double, end_s double, frames int"
STATE = "start_s double, end_s double, frames int, stopped boolean"


class Segmenter:
    """ST-02/03/04: feed frames in order, take finished segments; ``flush`` ends the open one."""

    def __init__(self, silence: float = 0.2, least: float = 0.15, most: float = 6.0, state: tuple[Any, ...] | None = None) -> None:
        self.silence, self.least, self.most = silence, least, most
        self.start, self.end, self.frames, self.stopped = state or (None, None, 0, False)

    @property
    def state(self) -> tuple[Any, ...]:
        return self.start, self.end, self.frames, self.stopped

    def _close(self) -> list[tuple[float, float, int]]:
        done = [] if self.start is None or round(self.end - self.start, 6) < self.least else [(self.start, self.end, self.frames)]
        self.start, self.end, self.frames = None, None, 0
        return done

    def feed(self, start: float, end: float, speech: bool, stop: bool = False) -> list[tuple[float, float, int]]:
        if self.stopped:
            return []
        out = []
        if self.start is not None and round(start - self.end, 6) >= self.silence:
            out += self._close()
        if speech:
            if self.start is None:
                self.start = start
            self.end, self.frames = end, self.frames + 1
            if round(self.end - self.start, 6) >= self.most:
                out += self._close()
        if stop:
            out += self._close()
            self.stopped = True
        return out

    def flush(self) -> list[tuple[float, float, int]]:
        return self._close()


def segment_batch(frames: DataFrame, **rule: float) -> DataFrame:
    """The rule over complete sessions: frames (session, start_s, end_s, speech, stop)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Segmenter(**rule)
        rows = [x for r in pdf.sort_values("start_s").itertuples() for x in s.feed(r.start_s, r.end_s, bool(r.speech), bool(r.stop))] + s.flush()
        return pd.DataFrame([(pdf["session"].iloc[0], *r) for r in rows], columns=["session", "start_s", "end_s", "frames"])

    return frames.groupBy("session").applyInPandas(run, SEGMENT)


def segment_stream(frames: DataFrame, **rule: float) -> DataFrame:
    """The rule over a stream; a stop marker or the processing timeout ends a session."""

    def run(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Segmenter(**rule, state=state.get if state.exists else None)
        if state.hasTimedOut:
            rows = s.flush()
            state.remove()
        else:
            frames_in = pd.concat(list(pdfs)).sort_values("start_s")
            rows = [x for r in frames_in.itertuples() for x in s.feed(r.start_s, r.end_s, bool(r.speech), bool(r.stop))]
            state.update(tuple(None if v is None else v for v in s.state))
            state.setTimeoutDuration(600_000)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "start_s", "end_s", "frames"])

    return frames.groupBy("session").applyInPandasWithState(run, SEGMENT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """ST-04 on a plain signal: runs of events with pauses of at most ``gap`` seconds: (key, session, start_s, end_s, n)."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    d = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return d.groupBy(key, "session").agg(F.min(at).alias("start_s"), F.max(at).alias("end_s"), F.count("*").alias("n"))


def eta(status: DataFrame, keep: float = 0.72) -> DataFrame:
    """ST-08, WN-14 per job: the smoothed remaining time over status rows (job_id, at_s, phase, done, total); other phases reset it."""
    working = {"overlap", "recognizing", "separating"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begun, smooth, out = None, None, []
        for r in pdf.sort_values("at_s").itertuples():
            if r.phase not in working:
                begun, smooth = (begun, smooth) if r.phase in ("queued", "finalizing") else (None, None)
                out.append(None)
                continue
            begun = r.at_s if begun is None else begun
            spent = max(0.0, r.at_s - begun)
            if r.total <= 0 or r.done <= 0 or spent < 1 or r.done >= r.total:
                out.append(None)
                continue
            raw = (r.total - r.done) / (r.done / spent)
            smooth = raw if smooth is None else smooth * keep + raw * (1 - keep)
            out.append(smooth)
        return pdf.sort_values("at_s").assign(remaining_s=pd.array(out, dtype="Float64").astype("float64"))

    return status.groupBy("job_id").applyInPandas(run, "job_id long, at_s double, phase string, done double, total double, remaining_s double")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """ST-09: places of the jobs (queue, job_id, submitted, cancelled): the first is active, a repeated number or cancelled job has none."""
    first = F.row_number().over(Window.partitionBy("queue", "job_id").orderBy("submitted", "seq"))
    d = jobs.withColumn("_n", first).where("_n = 1 AND NOT cancelled").drop("_n")
    return d.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy("submitted", "seq")))


RECOGNIZED = "session long, seq long, start_s double, end_s double, text string, error string"


def recognize_in_order(segments: DataFrame, recognizer: Callable[[int, float, float], str]) -> DataFrame:
    """ST-06 per session: finished segments (session, seq, start_s, end_s) recognised one after the other; one that fails has its error
    in its place, and the rest go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.sort_values("seq").itertuples():
            try:
                out.append((r.session, r.seq, r.start_s, r.end_s, recognizer(r.session, r.start_s, r.end_s), None))
            except Exception as e:  # noqa: BLE001  # whatever a model raises is that segment's error
                out.append((r.session, r.seq, r.start_s, r.end_s, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["session", "seq", "start_s", "end_s", "text", "error"])

    return segments.select("session", "seq", "start_s", "end_s").groupBy("session").applyInPandas(run, RECOGNIZED)


def partial_results(items: DataFrame) -> DataFrame:
    """ST-07: what may be shown before a job ends: base items with text; a filter alone, so it holds for streams in append mode too."""
    return items.where("kind = 'base' AND trim(coalesce(text, '')) != ''")


def phase_state(status: DataFrame) -> DataFrame:
    """ST-08: status rows (job_id, at_s, phase, audio_s) with the seconds spent in the running phase and whether that is slow (PR-10)."""
    w = Window.partitionBy("job_id").orderBy("at_s")
    new = F.when(F.lag("phase").over(w) == F.col("phase"), 0).otherwise(1)
    d = status.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("in_phase_s", F.col("at_s") - F.min("at_s").over(Window.partitionBy("job_id", "_run")))
    return d.withColumn("slow", F.coalesce(F.col("in_phase_s") * 1000 > slow_threshold(F.col("phase"), F.col("audio_s")), F.lit(False))).drop("_new", "_run")
