"""Documents that fall silent: keyed state with a timer for each document, over a stream of captures.

A document's state is when it was last captured and how often it has failed
since it was last read; its timer stands a set time after the last capture.
Captures move it on, and if it runs out, in the time of the stream, the
document is reported, once for each silence. A capture that comes after a gap
of that length reports the silence itself if the timer has not, so what is reported does
not depend on how the stream is cut into batches. Needs the RocksDB state
store (``STORE``), which keeps state on disk and timers in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that a session needs before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "set_name string, url string, last_captured timestamp, failures long, silent_since timestamp"
_STATE = "captured_ms long, failures long, told boolean"

_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class _Silence(StatefulProcessor):
    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _report(self, key, at: int, failures: int) -> tuple:
        return (*key, pd.Timestamp(at, unit="ms"), failures, pd.Timestamp(at + self.after_ms, unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        at, failures, told = self.last.get() if self.last.exists() else (None, 0, False)
        out = []
        for batch in rows:
            for ms, status in sorted(zip(batch["ms"].tolist(), batch["status"].tolist(), strict=True), key=lambda x: (x[0], x[1] or "")):
                if at is not None and ms - at >= self.after_ms and not told:
                    out.append(self._report(key, at, failures))
                if at is None or ms > at:
                    at, told = ms, False
                failures = failures + 1 if status not in ("ok", "not_modified") else 0
        self.last.update((at, failures, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not told:
            self.handle.registerTimer(at + self.after_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, failures, told = self.last.get()
        self.last.update((at, failures, True))
        yield pd.DataFrame([] if told else [self._report(key, at, failures)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def silent(captures: DataFrame, after: str = "3 days", delay: str = "1 day") -> DataFrame:
    """(set_name, url, last_captured, failures, silent_since) of documents of a stream (set_name, url, captured_at, status) that had no capture for so long.

    Times are those of the captures; a document is due once the stream's
    watermark, ``delay`` behind the latest capture, has passed its timer.
    """
    after_ms = int(pd.Timedelta(after).total_seconds() * 1000)
    timed = captures.withWatermark("captured_at", delay).select("set_name", "url", "captured_at", "status", (F.unix_millis("captured_at")).alias("ms"))
    return timed.groupBy("set_name", "url").transformWithStateInPandas(statefulProcessor=_Silence(after_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
