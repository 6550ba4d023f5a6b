"""Folds over a key's events in event time, with what falls due by itself between them: as a batch, and as a stream with timers.

A machine holds the rules: ``start()`` is a key's first state, ``step(state, at, seq, event)`` changes the state by an event and returns its output
rows, ``due(state)`` is the time (ms) at which something happens without an event, or none, and ``expire(state)`` does it and returns its
row. Whatever is due before an event, or before the time that a run is brought up to, happens first. States are JSON objects.

Batch: one shuffle by key, rows streamed in order with one state in memory; a key's events are never held together. Stream: keys lie in many
buckets; events wait in their bucket's state until the watermark has passed them, so their order does not depend on how they arrive, and a timer
brings its keys on; what is due is put out by the timer, without a further event. A key is of a plain type (number, string, time). Both give the same rows up to the watermark. Events later than the watermark are dropped,
and those without a key or a time are nobody's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The provider that keeps lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys that a stream holds together, and the most rows of a frame.
BUCKETS, FRAME = 1024, 10_000


def advance(machine, state: dict, rows, until: float) -> Iterator[dict]:
    """Outputs of the rows (at, seq, event), in order, and of all that is due before each of them and, at last, before ``until``."""
    for at, seq, event in rows:
        while (due := machine.due(state)) is not None and due < at:
            yield machine.expire(state)
        yield from machine.step(state, at, seq, event)
    while (due := machine.due(state)) is not None and due < until:
        yield machine.expire(state)


def _rows(events: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """(key, at in ms, seq, what: the other columns as JSON), with the event time kept for the watermark."""
    rest = [c for c in events.columns if c not in (key, ts, seq)]
    what = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    named = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return named.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"), what.alias("what"))


def _schema(events: DataFrame, key: str, machine) -> str:
    return f"{key} {dict(events.dtypes)[key]}, {machine.schema}"


def _names(schema: str) -> list[str]:
    return [c.split()[0].rstrip(":") for c in schema.split(",")]


def folded(events: DataFrame, machine, key: str, ts: str = "ts", seq: str = "seq", until: float = float("inf")) -> DataFrame:
    """The machine's outputs over a bounded table; events at ``until`` (ms) or later are left out, as a stream's watermark would."""
    names = [key, *_names(machine.schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            out = []
            for k, at, n, what in zip(frame["key"], frame["at"], frame["seq"], frame["what"]):
                if state is None or k != last:
                    if state is not None:
                        out += [{key: last, **row} for row in advance(machine, state, (), until)]
                    last, state = k, machine.start()
                out += [{key: k, **row} for row in advance(machine, state, ((int(at), int(n), json.loads(what)),), float("-inf"))]
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([{key: last, **row} for row in advance(machine, state, (), until)], columns=names)

    rows = _rows(events, key, ts, seq).drop("ts")
    if until != float("inf"):
        rows = rows.filter(F.col("at") < int(until))
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq", "what").mapInPandas(run, _schema(events, key, machine))


class _Timed(StatefulProcessor):
    """The waiting events and states of a bucket of keys; one timer, for the earliest of all.

    A call to the state store costs far more than a step of a machine. So waiting events lie in the store by the frame, and the states of keys that
    have something due lie together. Each other key has an entry of its own, which only its events touch.
    """

    def __init__(self, machine, key: str, kind: str) -> None:
        self.machine, self.key, self.kind = machine, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key array<{self.kind}>, at array<bigint>, seq array<bigint>, what array<string>")
        self.open = handle.getListState("open", f"key array<{self.kind}>, due array<bigint>, state array<string>")
        self.rest = handle.getMapState("rest", f"key {self.kind}", "state string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        firsts = []
        for frame in rows:
            self.waiting.appendValue((frame["key"].tolist(), frame["at"].tolist(), frame["seq"].astype("int64").tolist(), frame["what"].tolist()))
            firsts.append(int(frame["at"].min()))
        was, first = self.timer.get(), min(firsts)
        if was is None or first < was[0]:
            if was is not None:
                self.handle.deleteTimer(was[0])
            self._wake(first)
        return iter([])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        names = [self.key, *_names(self.machine.schema)]
        left, passed = [], {}
        for keys, ats, seqs, whats in self.waiting.get():
            for k, at, seq, what in zip(keys, ats, seqs, whats):
                if at < mark:
                    passed.setdefault(k, []).append((at, seq, what))
                else:
                    left.append((k, at, seq, what))
        due = {k: (t, state) for keys, dues, states in self.open.get() for k, t, state in zip(keys, dues, states)}
        for k, (t, _) in due.items():
            if t < mark:
                passed.setdefault(k, [])
        # what the bucket never held isn't looked up
        held, out = self.rest.exists(), []
        for k, rows in passed.items():
            own = due.pop(k)[1] if k in due else None
            if own is None and held:
                got = self.rest.getValue((k,))
                own = got[0] if got is not None else None
            state = self.machine.start() if own is None else json.loads(own)
            out += [{self.key: k, **row} for row in advance(self.machine, state, [(at, n, json.loads(what)) for at, n, what in sorted(rows)], mark)]
            t = self.machine.due(state)
            if t is not None:
                due[k] = (t, json.dumps(state))
            elif state != self.machine.start():
                self.rest.updateValue((k,), (json.dumps(state),))
            elif held:
                self.rest.removeKey((k,))
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=names)
                out = []
        self._put(self.waiting, left)
        self._put(self.open, [(k, t, state) for k, (t, state) in due.items()])
        wake = min((t for t in (*(r[1] for r in left), *(t for t, _ in due.values()))), default=None)
        # the timer that fired is gone already
        if wake is None:
            self.timer.clear()
        else:
            self._wake(wake)
        if out:
            yield pd.DataFrame(out, columns=names)

    def _put(self, state, rows: list[tuple]) -> None:
        """Rows in place of those held, by the frame."""
        if rows:
            state.put([tuple(list(c) for c in zip(*rows[i : i + FRAME])) for i in range(0, len(rows), FRAME)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def timed_stream(events: DataFrame, machine, key: str, ts: str = "ts", seq: str = "seq", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The machine's outputs over a stream, once the watermark (``late`` behind the newest event) has passed. A checkpoint keeps its ``buckets``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = _rows(events, key, ts, seq).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).withWatermark("ts", late)
    run = _Timed(machine, key, dict(events.dtypes)[key])
    return rows.groupBy("bucket").transformWithStateInPandas(run, _schema(events, key, machine), "Append", "EventTime")
