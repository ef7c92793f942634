"""Replicas' versions as a stream: the last writer of each id as state, whatever order versions come in.

Each id has one row of state: the winning version so far, the largest scores and the number of versions. A
version that was erased (``erased``) wins or loses like any other; while it stands, the id is out, and a
later writer brings it back. Erased ids are forgotten ``keep`` after the last version of them came, by a
timer of the machine's clock; a replica that is later than that may raise one again, so ``keep`` should be
longer than replicas stay away. Other state stays: it is the store.

Cases: a null id is dropped; nulls in a version's other columns are smaller than all else, as in
merge.last_writer; a batch without rows changes nothing; extra columns are not looked at.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memspark.sources import snapshots
from memspark.sources.snapshots import Change

#: What tells which version wins, in this order, as merge.last_writer has it.
TICKET = ("clock", "replica", "updated_at", "content", "type", "scope")
STATE = "clock long, replica string, updated_at long, content string, type string, scope string, erased boolean, importance double, confidence double, replicas long"
OUT = "id string, " + STATE
#: What Spark needs for keyed state of this kind; and timers go off in batches that have rows, for else they ask for batches without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_ROW = ["id", *_NAMES]


def _before(x, y) -> bool:
    """Whether a version's ticket is smaller; nulls are smallest."""
    rank = lambda v: [(v[k] is not None, v[k]) for k in range(len(TICKET))]
    for a, b in zip(rank(x), rank(y), strict=True):
        if a != b:
            return a < b if a[0] == b[0] else b[0]
    return False


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


class LastWriter(StatefulProcessor):
    """The state of an id and what new versions make of it; a batch's outcome is one row an id."""

    def __init__(self, keep: dt.timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("version", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = self.state.get()
        now = None if got is None else list(got)
        timed = now is not None and now[6]
        for row in rows:
            new = [*(row[n] for n in _NAMES[:-1]), 1]
            if now is None:
                now = new
                continue
            best = [_largest(now[7], new[7]), _largest(now[8], new[8]), now[9] + 1]
            now = [*(new if _before(now, new) else now)[:7], *best]
        if timed or now[6]:
            self._timers(timerValues.getCurrentProcessingTimeInMs() + self.keep if now[6] else None)
        self.state.update(tuple(now))
        yield Row(*_ROW)(key[0], *now)

    def _timers(self, at: int | None) -> None:
        """The only timer of an id is the one that forgets it, if it is erased."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()


def winners(versions: DataFrame, keep: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """The outcome of each id that a batch touches, of a stream of versions (id, clock, replica, updated_at, content, type, scope, erased, importance, confidence).

    The session that starts it needs ``SETTINGS``; replicate_into() sees to that.
    """
    score = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    told = versions.filter("id is not null").select(
        "id", F.col("clock").cast("long").alias("clock"), "replica", F.unix_micros("updated_at").alias("updated_at"), "content", "type", "scope",
        F.coalesce("erased", F.lit(False)).alias("erased"), score("importance"), score("confidence"),
    )
    return told.groupBy("id").transformWithState(LastWriter(keep), OUT, "Update", "ProcessingTime")


def replicate_into(versions: DataFrame, root: str, checkpoint: str, keep: dt.timedelta = dt.timedelta(days=30)):
    """The stream's winners in a table ``replicated`` of the store at root, batch by batch; erased ids go.

    A batch that runs again after a failure writes the same rows in place of themselves.
    """
    spark = versions.sparkSession
    columns = ["id", *(n for n in _NAMES if n != "erased")]

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            rows, gone = batch.filter("not erased").select(*columns), batch.filter("erased").select("id")
            while True:
                have = snapshots.versions(spark, root)
                base = have[-1] if have else 0
                known = snapshots.tables_of(spark, root, base) if have else []
                change = Change(rows, gone) if "replicated" in known else rows
                try:
                    snapshots.commit(spark, root, {"replicated": change}, tuple(t for t in known if t != "replicated"), base if have else None)
                    return
                except snapshots.Conflict:
                    continue
        finally:
            batch.unpersist()

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():  # a query keeps the settings that it was started with
        spark.conf.set(k, v)
    try:
        return winners(versions, keep).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
