"""State of notes in a stream that lets go of deleted ones (needs the session's RocksDB state store).

``changes.latest`` keeps a deleted path for ever, as an event that comes late must find that it is late. Here a deletion
leaves a tombstone, its number alone, with a timer: once the watermark has passed the deletion by ``keep``, events as old
as that are left out by the watermark itself, so the tombstone has nothing left to tell and goes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.plans.workers import reach

OUT = "path string, op string, seq long, content string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", "seq long, there boolean, content string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.note.get()
        seq, newest = (state[0] if state is not None else None), None
        for row in rows:
            if seq is None or row.seq > seq:
                seq, newest = row.seq, row
        if newest is None:
            return
        gone = newest.op == "delete"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.note.update((seq, not gone, None if gone else newest.content))
        if gone:
            self.handle.registerTimer(max(newest.ms, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield Row(path=key[0], op=newest.op, seq=seq, content=None if gone else newest.content)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.note.get()
        if state is not None and not state[1]:
            self.note.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest(events: DataFrame, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """(path, op, seq, content): as changes.latest, from a stream with ``at``, the time of each event.

    Events later than ``late`` are left out; a deleted path is forgotten ``keep_ms`` milliseconds of event time after its
    deletion. The session must name PROVIDER as spark.sql.streaming.stateStore.providerClass.
    """
    reach(events.sparkSession)
    own = events.select("path", "op", "seq", "content", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return own.groupBy("path").transformWithState(_Latest(keep_ms), OUT, "append", "eventTime")
