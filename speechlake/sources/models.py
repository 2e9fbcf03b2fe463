"""Models over partitions of a table (UD-03, UD-04, UD-06): Python table functions with a TABLE argument and PARTITION BY.

A model is made by a function without arguments, once in each Python worker, and makes a run for each partition: ``start(key row)`` gives an object
whose ``feed(row)`` and ``finish()`` yield rows. Rows of a partition come in order and one at a time, so a recording is never held
whole. The speech detector here is a real rule (energy of frames, then the library's segments); diarizers and separators are passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf

from ..streaming.segmenter import Segmenter

_LOADED: dict[Any, Any] = {}  # one model of a kind in a Python worker


class Run(Protocol):
    def feed(self, row: Row) -> Iterable[tuple[Any, ...]]: ...
    def finish(self) -> Iterable[tuple[Any, ...]]: ...


def over_partitions(rows: DataFrame, by: str, order: str, load: Callable[[], Callable[[Row], Run]], out: str, name: str) -> DataFrame:
    """The rows that a model gives for each partition ``by`` of a table, its rows in the given order. ``out`` is the result's schema; a null key is a
    partition too."""

    class Call:
        def __init__(self) -> None:
            self.run: Run | None = None

        def eval(self, row: Row):
            if self.run is None:
                if name not in _LOADED:
                    _LOADED[name] = load()
                self.run = _LOADED[name](row)
            yield from self.run.feed(row)

        def terminate(self):
            if self.run is not None:
                yield from self.run.finish()

    return udtf(Call, returnType=out)(rows.asTable().partitionBy(by).orderBy(order))


SPEECH = "path string, start_s double, end_s double, frames int"


class EnergySpeech:
    """UD-06 for one sound: frames at least as loud as ``threshold`` (root mean square) are speech, joined to segments by the library's rule."""

    def __init__(self, key: Row, rate: int, frame: int, threshold: float, **rule: float) -> None:
        self.path, self.rate, self.frame, self.threshold = key["path"], rate, frame, threshold
        self.rest, self.at, self.segments = np.empty(0, np.float64), 0, Segmenter(**rule)

    def feed(self, row: Row) -> Iterable[tuple[Any, ...]]:
        x = np.concatenate([self.rest, np.asarray(row["samples"] or [], np.float64)])
        n = len(x) // self.frame
        loud = np.sqrt((x[: n * self.frame].reshape(n, self.frame) ** 2).mean(axis=1)) if n else []
        for level in loud:
            begin, self.at = self.at, self.at + self.frame
            for found in self.segments.feed(round(begin / self.rate, 6), round(self.at / self.rate, 6), bool(level >= self.threshold)):
                yield (self.path, *found)
        self.rest = x[n * self.frame :]

    def finish(self) -> Iterable[tuple[Any, ...]]:
        for found in self.segments.flush():
            yield (self.path, *found)


def speech(chunks: DataFrame, rate: int = 16000, frame: int = 512, threshold: float = 0.02, **rule: float) -> DataFrame:
    """UD-06: (path, start_s, end_s, frames) of speech in chunk rows (path, chunk, samples) of any lengths; a last part of a frame is left out."""
    return over_partitions(chunks.select("path", "chunk", "samples"), "path", "chunk", lambda: lambda key: EnergySpeech(key, rate, frame, threshold, **rule), SPEECH, f"speech-{rate}-{frame}-{threshold}-{sorted(rule.items())}")
