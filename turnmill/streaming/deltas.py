"""Text of running and of finished requests."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accumulate_deltas(deltas: DataFrame, *requests: str) -> DataFrame:
    """Join the pieces of each request in ``seq`` order, whatever order they came in.

    Works on a batch table and, in update mode, on a stream; there each trigger
    gives the text so far. The result row is the request's text, so a group is
    no larger than one reply. On a stream the pieces of every request stay in the
    state; :func:`finished_requests` lets finished ones go.
    """
    pieces = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return (
        deltas.filter(F.col("delta") != "")
        .groupBy(*requests)
        .agg(F.array_join(F.transform(pieces, lambda p: p["delta"]), "").alias("text"))
    )


class _Assembly(StatefulProcessor):
    """Pieces of one request, by number, until the piece marked as last and all before it
    are there, or none has come for a while.

    A call to the state is a round trip, so a request has a few for each batch, however
    many pieces it got: one value says which pieces are there, and the texts of a batch are
    one entry of a list, read when the request is given."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        places = T.ArrayType(T.LongType())
        self.pieces = handle.getListState("pieces", T.StructType().add("seqs", places).add("deltas", T.ArrayType(T.StringType())))
        self.about = handle.getValueState("about", T.StructType().add("held", places).add("last", T.LongType()).add("timer", T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.about.get()
        held, last, timer = before or ([], None, None)
        known, new, latest = set(held), {}, 0
        for row in rows:
            # A piece that comes twice counts once; the first one stays.
            if row.seq not in known:
                known.add(row.seq)
                new[row.seq] = row.delta or ""
            if row.last:
                last = row.seq if last is None else max(last, row.seq)
            latest = max(latest, row.ts_ms)
        if last is not None and len(known) == last + 1:
            # A request that came whole leaves no trace in the state.
            yield self._given(key, True, new, stored=before is not None)
            if timer is not None:
                self.handle.deleteTimer(timer)
            return
        due = max(latest + self.idle_ms, timer or 0, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        if new:
            self.pieces.appendValue((list(new), list(new.values())))
        self.about.update(([*held, *new], last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.about.exists():
            yield self._given(key, False, {}, stored=True)

    def _given(self, key, complete: bool, new: dict, *, stored: bool) -> Row:
        pieces = list(new.items())
        if stored:
            for seqs, deltas in self.pieces.get():
                pieces += zip(seqs, deltas, strict=True)
            self.pieces.clear()
            self.about.clear()
        pieces.sort()
        return Row(request_id=key[0], text="".join(d for _, d in pieces), pieces=len(pieces), complete=complete)

    def close(self) -> None:
        pass


_FINISHED = T.StructType().add("request_id", T.StringType()).add("text", T.StringType()).add("pieces", T.LongType()).add("complete", T.BooleanType())


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """The state store that state with timers needs; set it before the stream is started."""
    spark.conf.set(_STORE, _ROCKSDB)
    return spark


def finished_requests(deltas: DataFrame, *, idle: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """``request_id, text, pieces, complete`` of each request of a stream, once it is over.

    ``deltas`` has ``request_id``, ``seq`` (from 0), ``ts``, ``delta`` and ``last``, true in
    the piece that ends the request. A request is complete when the last piece and all
    before it have come, in any order; its text is given, and nothing of it stays in the
    state. If the watermark passes the time ``idle`` after its latest piece before that, what
    there is comes out with ``complete`` false. Pieces older than ``lateness`` against the
    latest of the batches before are dropped; a piece that comes again after its request was given begins
    an incomplete one. Append mode.
    """
    use_rocksdb(deltas.sparkSession)
    # The state's own worker on the driver sees no files that were shipped, so the processor
    # goes there whole and not by the name of this module.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    pieces = deltas.withWatermark("ts", lateness).select(
        F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "ts", "delta",
        F.coalesce(F.col("last"), F.lit(False)).alias("last"), F.unix_millis("ts").alias("ts_ms"),
    )
    idle_ms = deltas.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {idle}) AS ms").first()["ms"]
    return pieces.groupBy("request_id").transformWithState(_Assembly(idle_ms), _FINISHED, "Append", "EventTime")
