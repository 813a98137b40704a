"""Streams that remember: journals of changes, the last lines of a source, versions and their silence.

Each operator keeps a few values for a key and restarts from its checkpoint: what
a batch of files gives at once, any split of them into runs gives as well.
Rows that were seen before (of a place at or below the last one) change nothing,
so sources may deliver more than once. Results are changes, the newest of which
counts; ``latest`` takes it.

State lives in the RocksDB store, so its size is bounded by keys, not by rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lines that a tail holds.
TAIL = 25


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, each change appended once; goes on from the checkpoint the next time."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def batch(rows: DataFrame, number: int) -> None:
        # a batch that runs again replaces its own folder
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/number={number}")

    return stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among all that the runs wrote."""
    names = [x.split()[0] for x in schema.split(", ")]
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", out).parquet(f"{out.rstrip('/')}/number=*")
    rest = [n for n in names if n not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "seen")).alias("x"))
    return newest.select(*keys, *[f"x.{n}" for n in rest])


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


JOURNAL = "tx_id string, state string, undone int, redone int, refused int, seen long"


class Journal(StatefulProcessor):
    """Folds undo and redo of a transaction: an undo needs it applied, a redo reverted; others are refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "applied boolean, undone int, redone int, refused int, seen long")

    def handleInputRows(self, key, rows, timerValues):
        applied, undone, redone, refused, seen = self.held.get() if self.held.exists() else (True, 0, 0, 0, -1)
        for pos, action in _ordered(rows, ["pos"])[["pos", "action"]].itertuples(index=False):
            if pos <= seen:
                continue
            seen = int(pos)
            if action == "undo" and applied:
                applied, undone = False, undone + 1
            elif action == "redo" and not applied:
                applied, redone = True, redone + 1
            elif action != "apply":
                refused += 1
        self.held.update((applied, undone, redone, refused, seen))
        yield pd.DataFrame([(key[0], "APPLIED" if applied else "REVERTED", undone, redone, refused, seen)], columns=[x.split()[0] for x in JOURNAL.split(", ")])


def journals(actions: DataFrame) -> DataFrame:
    """State of each transaction of a stream (tx_id, pos, action)."""
    return actions.select("tx_id", "pos", "action").groupBy("tx_id").transformWithStateInPandas(Journal(), JOURNAL, "update", "None")


TAILS = "source string, lines string, seen long"


def tails(lines: DataFrame, most: int = TAIL) -> DataFrame:
    """The last ``most`` lines of each source of a stream (source, id, line), in order of id, as a JSON list of (id, line)."""

    class Tail(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getValueState("held", "lines string")

        def handleInputRows(self, key, rows, timerValues):
            before = dict(json.loads(self.held.get()[0])) if self.held.exists() else {}
            for part in rows:  # never more than a part and the tail at once
                before |= dict(zip(part["id"].tolist(), part["line"].tolist()))
                before = dict(sorted(before.items())[-most:])
            text = json.dumps(list(before.items()))
            self.held.update((text,))
            yield pd.DataFrame([(key[0], text, max(before))], columns=["source", "lines", "seen"])

    return lines.select("source", "id", "line").groupBy("source").transformWithStateInPandas(Tail(), TAILS, "update", "None")


VERSIONS = "entity string, version string, changes int, stale boolean, seen long"


def versions(told: DataFrame, idle: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Each entity's version, how often it changed, and whether nothing was heard of it for longer than ``idle`` of the stream (entity, ts, version).

    A timer of event time tells the silence; whatever comes later ends it.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    class Version(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("held", "version string, changes int, seen long")

        def handleInputRows(self, key, rows, timerValues):
            version, changes, seen = self.held.get() if self.held.exists() else (None, 0, -1)
            for ts, new in _ordered(rows, ["ts", "version"])[["ts", "version"]].itertuples(index=False):
                at = int(ts.timestamp() * 1000)
                if at < seen:
                    continue
                changes += version is not None and new != version
                version, seen = new, at
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(seen + wait)
            self.held.update((version, changes, seen))
            yield self.told(key, False)

        def told(self, key, stale):
            version, changes, seen = self.held.get()
            return pd.DataFrame([(key[0], version, changes, stale, seen + stale)], columns=[x.split()[0] for x in VERSIONS.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.told(key, True)

    return told.select("entity", "ts", "version").withWatermark("ts", late).groupBy("entity").transformWithStateInPandas(Version(), VERSIONS, "update", "EventTime")
