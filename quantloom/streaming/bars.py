"""Bars and CUSUM events on streams, with the state machines of the batch operators.

Ticks wait in the state of their key until the watermark has passed them and are then taken in order of (ts, seq), so
the result doesn't depend on how micro-batches cut the stream. A tick that comes after the watermark has passed it is
dropped. As in batches, the open bar is never emitted. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import BAR_COLUMNS, BarRule, BarState
from ..operators.sampling import CusumState
from ..shipping import ship_package

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_BAR_NAMES = [c.split()[0] for c in BAR_COLUMNS.split(", ")]


class Ordered(StatefulProcessor):
    """Releases the ticks of a key in order, up to the watermark, to ``take``."""

    names: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, seq long, price double, volume double")
        self.saved = handle.getValueState("saved", "body string")

    def restore(self, body: dict | None):
        raise NotImplementedError

    def take(self, state, ticks: list[tuple]) -> tuple[list[tuple], dict]:
        raise NotImplementedError

    def _release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        due = sorted(t for t in held if pd.Timestamp(t[0]).timestamp() * 1000 < watermark_ms)
        if due:
            late = [t for t in held if pd.Timestamp(t[0]).timestamp() * 1000 >= watermark_ms]
            self.waiting.put(late) if late else self.waiting.clear()
            body = self.saved.get()
            out, saved = self.take(self.restore(json.loads(body[0]) if body else None), due)
            self.saved.update((json.dumps(saved),))
            if out:
                made = pd.DataFrame(out, columns=self.names)
                made.insert(0, "key", key[0])
                yield made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for frame in rows:
            self.waiting.appendList([(r.ts.to_pydatetime(), int(r.seq), float(r.price), float(r.volume)) for r in frame.itertuples(index=False)])
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
        self.handle.registerTimer(last + 1)
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class BarProcessor(Ordered):
    names = _BAR_NAMES

    def __init__(self, rule: BarRule):
        self.rule = rule

    def restore(self, body: dict | None) -> BarState:
        return BarState(self.rule, body)

    def take(self, state: BarState, ticks: list[tuple]) -> tuple[list[tuple], dict]:
        out = []
        for ts, _, price, volume in ticks:
            if (bar := state.add(pd.Timestamp(ts).timestamp(), price, volume)) is not None:
                out.append((bar[0], pd.Timestamp(bar[1], unit="s").round("us"), *bar[2:]))
        return out, state.saved()


class CusumProcessor(Ordered):
    names = ["ts", "seq"]

    def __init__(self, threshold: float):
        self.threshold = threshold

    def restore(self, body: dict | None) -> CusumState:
        return CusumState(self.threshold, **(body or {}))

    def take(self, state: CusumState, ticks: list[tuple]) -> tuple[list[tuple], dict]:
        out = [(pd.Timestamp(ts), seq) for ts, seq, price, _ in ticks if state.add(price)]
        return out, {"last": state.last, "up": state.up, "down": state.down}


def _run(ticks: DataFrame, processor: StatefulProcessor, shape: str, delay: str) -> DataFrame:
    ship_package(ticks.sparkSession)
    kind = ticks.schema["key"].dataType.simpleString()
    marked = ticks.select("key", "ts", "seq", "price", "volume").withWatermark("ts", delay)
    return marked.groupBy("key").transformWithStateInPandas(processor, outputStructType=f"key {kind}, {shape}", outputMode="Append", timeMode="EventTime")


def stream_bars(ticks: DataFrame, rule: BarRule, delay: str = "0 seconds") -> DataFrame:
    """Bars of a stream of ticks (key, ts, seq, price, volume); ``delay`` is how late a tick may be."""
    return _run(ticks, BarProcessor(rule), BAR_COLUMNS, delay)


def stream_cusum(ticks: DataFrame, threshold: float, delay: str = "0 seconds") -> DataFrame:
    """(key, ts, seq) of the CUSUM events of a stream's prices."""
    return _run(ticks, CusumProcessor(threshold), "ts timestamp, seq long", delay)
