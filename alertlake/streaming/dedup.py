"""Stream dedup with a time limit."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertlake.session import ROCKSDB_PROVIDER


def use_rocksdb_state(spark: SparkSession) -> None:
    """State with TTL needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


@contextmanager
def state_partitions(spark: SparkSession, per_core: int = 2) -> Iterator[None]:
    """Streams started inside keep their state in at most ``per_core`` parts per core.

    Every part costs a Python worker and a store commit in every trigger, however few rows it has. A stream that
    was started before keeps the number in its checkpoint.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class FirstWithinTtl(StatefulProcessor):
    """Keeps one number per key: the time of the last accepted row, until it can block no more.

    The keys of a hash bucket share one state value and one timer, so a trigger costs a few calls to the state
    store per bucket, not per key. On the event clock the rows of a key within one trigger are ordered by time
    and id, and a number goes once the watermark has passed the end of the block: every row that is not late is
    then free. On the processing clock all rows of a trigger have its time and keep their order of arrival.
    """

    def __init__(self, ttl_us: int, event_time: bool, mark: bool, columns: Sequence[str]):
        self.ttl_us, self.event_time, self.mark = ttl_us, event_time, mark
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "times string")

    def _end_ms(self, last: int) -> int:
        return -(-(last + self.ttl_us) // 1000)

    def _now_ms(self, timerValues: Any) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def _load(self) -> dict[str, int]:
        held = self.state.get()
        return {} if held is None else json.loads(held[0])

    def _store(self, last: dict[str, int], now_ms: int, timer: int | None) -> None:
        """The keys that still block, and a timer for the first of them to end; ``timer`` is the one set before."""
        last = {k: t for k, t in last.items() if self._end_ms(t) > now_ms}
        if last:
            self.state.update((json.dumps(last),))
        else:
            self.state.clear()
        self._set_timer(timer, self._due(last))

    def _due(self, last: dict[str, int]) -> int | None:
        """When the bucket has something to do without new rows."""
        return min(map(self._end_ms, last.values()), default=None)

    def _set_timer(self, before: int | None, due: int | None) -> None:
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, now_ms = self._load(), self._now_ms(timerValues)
        timer = self._due(last)
        chunks = [chunk.set_axis(self.columns, axis=1) for chunk in rows]  # names of computed columns are not kept
        if self.event_time:
            late = [chunk["_t"].to_numpy() < now_ms * 1000 for chunk in chunks]
        else:
            chunks = [chunk.assign(_t=now_ms * 1000, _id=0) for chunk in chunks]
            late = [np.zeros(len(chunk), dtype=bool) for chunk in chunks]
        passed = self._in_time(chunks, late, last)
        self._store(last, now_ms, timer)
        for chunk, free, behind in zip(chunks, passed, late):
            yield self._rows(chunk, free, behind)

    def _in_time(self, chunks: list[pd.DataFrame], late: list[np.ndarray], last: dict[str, int]) -> list[np.ndarray]:
        """Which rows pass: one step per row that passes, over the sorted times of each key; ``last`` follows."""
        order = pd.concat([
            pd.DataFrame({"key": chunk["_key"], "t": chunk["_t"].to_numpy(), "id": chunk["_id"], "chunk": i,
                          "row": np.arange(len(chunk))})[~behind]
            for i, (chunk, behind) in enumerate(zip(chunks, late))]).sort_values(["key", "t", "id"], kind="stable")
        keys, times = order["key"].to_numpy(dtype=object), order["t"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        taken = []
        for begin, end in zip(starts, [*starts[1:], len(keys)]):
            name = keys[begin]
            at = begin if name not in last else begin + int(np.searchsorted(times[begin:end], last[name] + self.ttl_us))
            while at < end:
                taken.append(at)
                last[name] = int(times[at])
                at = begin + int(np.searchsorted(times[begin:end], last[name] + self.ttl_us))
        passed = [np.zeros(len(chunk), dtype=bool) for chunk in chunks]
        in_chunk, in_row = order["chunk"].to_numpy()[taken], order["row"].to_numpy()[taken]
        for i, free in enumerate(passed):
            free[in_row[in_chunk == i]] = True
        return passed

    def _rows(self, chunk: pd.DataFrame, passed: np.ndarray, late: np.ndarray) -> pd.DataFrame:
        out = chunk.drop(columns=["_t", "_id", "_clock", "_key", "_bucket", "_close"], errors="ignore")
        out = out.astype({c: object for c in out.columns if pd.api.types.is_string_dtype(out[c])})
        if not self.mark:
            return out[passed]
        return out.assign(deduplicated=~passed, late=late) if self.event_time else out.assign(deduplicated=~passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._store(self._load(), self._now_ms(timerValues), None)
        return iter([])

    def close(self) -> None:
        pass


class FirstInOrder(FirstWithinTtl):
    """The rule of :class:`FirstWithinTtl` in the order of time and id over all triggers.

    A row waits in the state until the watermark has passed it: every row that could come before it is there
    or late by then. Waiting rows are compressed tables, at most a few a trigger and bucket: those that this trigger's
    watermark will free, and an eighth of the lateness each. A table is read when the watermark reaches its first row,
    so only the part of an eighth that still waits is written again. A row with ``_close`` ends the wait of all.
    """

    def __init__(self, ttl_us: int, mark: bool, columns: Sequence[str], lateness_us: int):
        super().__init__(ttl_us, True, mark, columns)
        self.lateness_us = lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "first long, number long", "rows binary")

    def _due(self, last: dict[str, int]) -> int | None:
        starts = [first // 1000 + 1 for first, _ in self.held.keys()]
        return min([*map(self._end_ms, last.values()), *starts], default=None)

    def _hold(self, rows: pd.DataFrame) -> None:
        rows = rows.drop(columns=["_clock", "_bucket", "_close"], errors="ignore")
        times = rows["_t"].to_numpy()
        freed = int(times.max()) // 1000 * 1000 - self.lateness_us  # the watermark will be there at least
        part = np.maximum(times, freed) // max(self.lateness_us // 8, 1_000_000)
        number = max((n for _, n in self.held.keys()), default=0)
        for i, at in enumerate(np.unique(part), 1):
            piece = pa.Table.from_pandas(rows[part == at], preserve_index=False).replace_schema_metadata(None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(piece)
            self.held.updateValue((int(times[part == at].min()), number + i), (sink.getvalue().to_pybytes(),))

    def _judge(self, last: dict[str, int], before: int | None = None) -> list[pd.DataFrame]:
        """The rows that wait, up to a time, with their answers; ``last`` follows."""
        chunks = []
        for key in [k for k in self.held.keys() if before is None or k[0] < before]:
            piece = pa.ipc.open_stream(bytes(self.held.getValue(key)[0])).read_pandas()
            self.held.removeKey(key)
            due = np.ones(len(piece), dtype=bool) if before is None else piece["_t"].to_numpy() < before
            if not due.all():
                self._hold(piece[~due])
            chunks.append(piece[due])
        if not chunks:
            return []
        late = [np.zeros(len(chunk), dtype=bool) for chunk in chunks]
        return [self._rows(*answers) for answers in zip(chunks, self._in_time(chunks, late, last), late)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, now_ms = self._load(), self._now_ms(timerValues)
        timer, closing, out = self._due(last), False, []
        for chunk in rows:
            chunk = chunk.set_axis(self.columns, axis=1)
            ends = chunk["_close"].to_numpy(dtype=bool)
            closing, chunk = closing or bool(ends.any()), chunk[~ends]
            late = chunk["_t"].to_numpy() < now_ms * 1000
            if late.any():
                out.append(self._rows(chunk[late], np.zeros(late.sum(), dtype=bool), late[late]))
            if not late.all():
                self._hold(chunk[~late])
        if closing:
            out += self._judge(last)
            self._store(last, now_ms, timer)
        else:  # blocks that have ended are still needed by rows whose timer comes after this
            self._set_timer(timer, self._due(last))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, now_ms = self._load(), self._now_ms(timerValues)
        out = self._judge(last, now_ms * 1000)
        self._store(last, now_ms, None)
        return iter(out)


def _closing_rows(closing: DataFrame, schema: T.StructType, buckets: int) -> DataFrame:
    """A row with ``_close`` for each bucket; no nulls in numbers and flags, which pandas would turn into floats."""
    def filler(field: T.StructField) -> Column:
        if field.name == "_bucket":
            return F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<long>"))
        if isinstance(field.dataType, T.BooleanType):
            return F.lit(field.name == "_close")
        return F.lit(0 if isinstance(field.dataType, T.NumericType) else None).cast(field.dataType)

    return closing.select(*[filler(f).alias(f.name) for f in schema.fields])


def dedup_stream(
    df: DataFrame, *, key: Sequence[str], ttl_seconds: int = 3600, clock: str = "processing",
    ts: str | None = None, id: str | None = None, mark: bool = False, lateness_seconds: int = 3600,
    buckets: int = 256, ordered: bool = False, closing: DataFrame | None = None,
) -> DataFrame:
    """First row of a key passes and blocks the key for the TTL; blocked rows do not extend the block.

    ``clock="processing"``: the block lasts TTL on the wall clock, exact but not
    repeatable. Bounded runs (``availableNow``) need
    ``spark.sql.streaming.noDataMicroBatches.enabled=false`` to end.

    ``clock="event"``: same rule on ``ts``, repeatable. The watermark trails the newest ``ts`` by
    ``lateness_seconds``; state of a key goes when the watermark passes the end of its block. Rows behind
    the watermark are late: they can no longer be judged, so they do not pass and block nothing; ``mark``
    returns them with ``late``. Rows without a time are late. A trigger's rows of one bucket are held in one
    task, so bound the trigger at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).

    On the event clock a trigger's rows are judged at once, against the blocks that earlier triggers gave: a row that
    comes in time but in a later trigger than a row of its key with a later time is judged after that one. ``ordered``
    gives the rule of the batch dedup whatever the triggers: a row comes out once the watermark has passed it, so about
    ``lateness_seconds`` after it came; late rows come out at once. A bounded input leaves rows waiting at its end: each row
    of ``closing``, a stream of any columns, lets all that wait out, and rows that come later are judged after those.
    ``ordered`` and ``closing`` belong to the checkpoint. What waits in a bucket and is let out at a time is held in one task.

    ``clock="watermark"``: the built-in dedup; state is dropped by the watermark, so a key may stay blocked
    longer than the TTL.

    Keys are dealt into ``buckets`` by hash, each with one state value. Their number belongs to the checkpoint:
    give more where a trigger's rows or the keys that block at a time are too many for one task.

    ``mark`` keeps every row and adds ``deduplicated`` (and ``late`` on the event clock).
    """
    if ordered and clock != "event":
        raise ValueError("ordered needs the event clock")
    if clock == "watermark":
        return df.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(list(key))
    event = clock == "event"
    use_rocksdb_state(df.sparkSession)
    fields = list(df.schema.fields)
    if mark:
        fields.append(T.StructField("deduplicated", T.BooleanType()))
    identity = F.col(id) if id else F.lit(0)
    if event:
        if mark:
            fields.append(T.StructField("late", T.BooleanType()))
        watched = df.withColumn("_clock", F.col(ts).cast("timestamp")).withWatermark("_clock", f"{lateness_seconds} seconds")
        # The watermark is taken from the column above; rows behind it must reach the state to be flagged,
        # so the column that Spark would filter by holds no past time.
        delay = watched.schema["_clock"].metadata
        keyed = watched.withColumns({
            "_t": F.coalesce(F.unix_micros("_clock"), F.lit(-(2**62)).cast("long")), "_id": identity,
            "_clock": F.lit("2262-01-01").cast("timestamp")})
    else:
        keyed = df.withColumns({"_t": F.lit(0).cast("long"), "_id": identity})
    name = F.to_json(F.array(*[F.col(c).cast("string") for c in key]))
    keyed = keyed.withColumns({"_key": name, "_bucket": F.pmod(F.xxhash64(name), F.lit(buckets))})
    if ordered:
        keyed = keyed.withColumn("_close", F.lit(False))
        if closing is not None:
            keyed = keyed.unionByName(_closing_rows(closing, keyed.schema, buckets))
        rule = FirstInOrder(int(ttl_seconds) * 1_000_000, mark, keyed.columns, int(lateness_seconds) * 1_000_000)
    else:
        rule = FirstWithinTtl(int(ttl_seconds) * 1_000_000, event, mark, keyed.columns)
    if event:
        keyed = keyed.withMetadata("_clock", delay or {"spark.watermarkDelayMs": lateness_seconds * 1000})
    return keyed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=rule, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="EventTime" if event else "ProcessingTime")
