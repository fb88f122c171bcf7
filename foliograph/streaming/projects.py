"""Projects as keyed state: images, approved pages and a pointer to the version that counts, from events as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructField, StructType

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of event time after which a stage that was neither accepted nor discarded is dropped.
ABANDONED = 3_600_000
#: How much later than the newest event one may come; the watermark leaves out what is later still.
LATE = "7 days"
OUT = "project bigint, seq bigint, images bigint, approved string, version int, staged int"


def _of(**fields: Any) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


class ProjectState(StatefulProcessor):
    """State of one project; events: kind, id, value, at (a time in milliseconds).

    image: an image of that id is added, once however often the event comes. approve: the page `value` is approved; pages
    are a set. stage: version `value` is staged, unless a later one is staged or counts already. accept: the pointer moves
    to `value` if that is later than where it is; discard: the stage goes if it is `value`. So neither the order of
    events nor a repetition changes where images, approvals and pointer end.
    """

    def __init__(self, abandoned: int = ABANDONED) -> None:
        self.abandoned = abandoned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.images = handle.getListState("images", _of(id=LongType(), name=StringType()))
        self.known = handle.getMapState("known", _of(id=LongType()), _of(at=LongType()))
        self.approved = handle.getMapState("approved", _of(page=IntegerType()), _of(at=LongType()))
        self.pointer = handle.getValueState("pointer", _of(version=IntegerType(), seq=LongType()))
        self.stage = handle.getValueState("stage", _of(version=IntegerType(), until=LongType()))

    def _held(self) -> tuple[int, int, int | None, int | None]:
        version, seq = self.pointer.get() if self.pointer.exists() else (0, 0)
        staged, until = self.stage.get() if self.stage.exists() else (None, None)
        return version, seq, staged, until

    def _told(self, key: Any, version: int, seq: int, staged: int | None) -> Iterator[Row]:
        self.pointer.update((version, seq + 1))
        pages = sorted(k[0] for k in self.approved.keys())  # noqa: SIM118
        yield Row(project=key[0], seq=seq + 1, images=sum(1 for _ in self.images.get()), approved=",".join(map(str, pages)), version=version, staged=staged)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        """What the rows say is made out first: each look at the state is a message to the JVM, so a value is written once."""
        version, seq, staged, until = self._held()
        before, images, pages = (staged, until), {}, {}
        for e in sorted(rows, key=lambda r: (r.at, r.id)):
            if e.kind == "image":
                images.setdefault(e.id, e.at)
            elif e.kind == "approve":
                pages[e.value] = e.at
            elif e.kind == "stage":
                if e.value > version and (staged is None or e.value >= staged):
                    staged, until = e.value, e.at + self.abandoned
            elif e.kind in ("accept", "discard"):
                version = max(version, e.value) if e.kind == "accept" else version
                if staged is not None and (staged == e.value or staged <= version):
                    staged = until = None
        new = [(i, at) for i, at in images.items() if seq == 0 or not self.known.containsKey((i,))]  # a project's first rows find nothing
        for i, at in new:
            self.known.updateValue((i,), (at,))
        if new:
            self.images.appendList([(i, f"image_{i}") for i, _ in new])
        for page, at in pages.items():
            self.approved.updateValue((page,), (at,))
        if (staged, until) != before:
            if before[1] is not None:
                self.handle.deleteTimer(before[1])
            if until is None:
                self.stage.clear()
            else:
                self.stage.update((staged, until))
                self.handle.registerTimer(until)
        yield from self._told(key, version, seq, staged)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        version, seq, _, until = self._held()
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.stage.clear()
            yield from self._told(key, version, seq, None)

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = LATE, abandoned: int = ABANDONED) -> DataFrame:
    """OUT: a row for each project and batch in which something came or a stage was dropped; events: project, kind, id, value, ts.

    State is kept by project, and a project's stages are dropped by timers of event time.
    An event may come `late` after newer ones; stages are dropped that much after their time.
    """
    session = events.sparkSession
    session.conf.set(PROVIDER, ROCKS)  # the only store that keeps lists, maps and timers of a key
    timed = events.withWatermark("ts", late).select("project", "kind", F.col("id").cast("long").alias("id"), F.col("value").cast("int").alias("value"), F.unix_millis("ts").alias("at"), "ts")
    return timed.groupBy("project").transformWithState(statefulProcessor=ProjectState(abandoned), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def kept(events: DataFrame, out: str, checkpoint: str, late: str = LATE, abandoned: int = ABANDONED) -> None:
    """Works off what has arrived; each batch's rows are a folder of out, which a batch that is played again replaces."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states(events, late, abandoned).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(rows: DataFrame) -> DataFrame:
    """The last state of each project."""
    return rows.groupBy("project").agg(F.max_by(F.struct("images", "approved", "version", "staged"), "seq").alias("s")).select("project", "s.*")
