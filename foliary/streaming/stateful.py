"""Stateful streams: the audited state machine, expiry by timers with retries, and session, repeat and join operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state of the operators here lies in RocksDB: on disk, and in the checkpoint after each batch. Asking for the
    streams starts what keeps track of state, which a batch query over these operators needs as well."""
    spark.streams.active  # noqa: B018
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Machine(StatefulProcessor):
    """The state of a key is one value; each request is answered with the state it met and whether it was legal."""

    def __init__(self, edges: dict[str, frozenset[str]], key: str, order: list[str], start: str, schema: str):
        self.edges, self.key, self.order, self.start, self.schema = edges, key, order, start, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # What has come of a key in this batch, in order; a key's whole log is never held, only a batch's.
        asked = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = self.state.get()[0] if self.state.exists() else self.start
        met, legal = [], []
        for wanted in asked["to_state"]:
            met.append(state)
            legal.append(wanted in self.edges.get(state, ()))
            state = wanted if legal[-1] else state
        self.state.update((state,))
        yield asked.assign(from_state=met, legal=legal)[[f.split()[0] for f in self.schema.split(", ")]]

    def close(self) -> None:
        pass


def audited_stream(requests: DataFrame, transitions: dict[str, tuple[str, ...]], key: str, order: list[str], start: str = "INIT") -> DataFrame:
    """requests (key, order.., to_state) as a stream: each once with from_state, the state it met, and legal.

    An illegal request changes nothing. Requests of a key must come in the order of their batches; within one they are
    sorted. The state is one value a key, kept without expiry, so a restart from the checkpoint goes on where it was.
    """
    with_rocksdb(requests.sparkSession)
    kinds = dict(requests.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *order]) + ", from_state string, to_state string, legal boolean"
    edges = {k: frozenset(v) for k, v in transitions.items()}
    return requests.groupBy(key).transformWithStateInPandas(Machine(edges, key, order, start, schema), outputStructType=schema, outputMode="append", timeMode="none")


#: Groups of items that share a timer and a state row. A stream keeps the number it was started with.
EXPIRY_GROUPS = 4096


class Expiry(StatefulProcessor):
    """The items of a hashed group with a timer for the first of them that is due: those due are purged, tried again, or in
    conflict after the last try. One state row and one timer a group, since each call for a single key is a round trip."""

    def __init__(self, key: str, kind: str, most: int, pause_ms: int):
        self.key, self.kind, self.most, self.pause_ms = key, kind, most, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"timer long, item array<{self.kind}>, due array<long>, fails array<int>, attempts array<int>")

    def _items(self) -> tuple[int | None, dict]:
        """The group's timer and each item's (due, fails, attempts)."""
        if not self.held.exists():
            return None, {}
        timer, item, due, fails, attempts = self.held.get()
        return timer, dict(zip(item, zip(due, fails, attempts, strict=True), strict=True))

    def _keep(self, timer: int | None, items: dict) -> None:
        """timer: the one that is set now, if any."""
        first = min((x[0] for x in items.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.held.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.held.update((first, list(items), *[[x[k] for x in items.values()] for k in range(3)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, items = self._items()
        asked = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for item, kind, purge_at, fails in zip(*[asked[c].tolist() for c in (self.key, "kind", "purge_at", "fails")], strict=True):
            item = None if item != item else item  # a null number is NaN in a frame
            if kind == "deleted":
                items[item] = (int(purge_at.timestamp() * 1000), int(fails), 0)
            else:
                items.pop(item, None)
        self._keep(timer, items)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, items = self._items()
        now, done = timerValues.getCurrentWatermarkInMs(), []
        for item, (at, fails, attempts) in list(items.items()):
            while at <= now:  # the time of several tries may have passed at once
                attempts += 1
                if attempts > fails or attempts >= self.most:
                    done.append((item, "purged" if attempts > fails else "conflict", attempts))
                    del items[item]
                    break
                at += self.pause_ms
            else:
                items[item] = (at, fails, attempts)
        self._keep(None, items)  # the timer that fired is gone
        if done:
            yield pd.DataFrame(done, columns=[self.key, "status", "attempts"], dtype=object)

    def close(self) -> None:
        pass


def expiring(events: DataFrame, key: str, most: int = 3, pause_seconds: int = 5, late: str = "0 seconds", groups: int = EXPIRY_GROUPS) -> DataFrame:
    """events (key, ts, kind deleted or restored, purge_at, fails) of a recycle bin to (key, status, attempts).

    An item that isn't restored before is tried once the watermark has passed purge_at, and again after a pause up to
    ``most`` times: ``purged``, or ``conflict`` when the last try failed too. ``fails`` is how many tries its target
    refuses. Deleting again starts the retention anew. State is one row for each of ``groups`` hashed groups, with its items in
    the bin.
    """
    with_rocksdb(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    group = F.pmod(F.xxhash64(key), F.lit(groups)).alias("group")
    return rows.select(group, key, "ts", "kind", "purge_at", "fails").groupBy("group").transformWithStateInPandas(Expiry(key, kind, most, 1000 * pause_seconds), outputStructType=f"{key} {kind}, status string, attempts int", outputMode="append", timeMode="eventTime")


def expired_batch(events: DataFrame, key: str, as_of: str, most: int = 3, pause_seconds: int = 5) -> DataFrame:
    """What ``expiring`` has put out by the time the watermark stands at as_of: the last event of each item decides."""
    last = events.groupBy(key).agg(F.max_by(F.struct("kind", "purge_at", "fails"), F.struct("ts", F.col("kind") == "restored")).alias("x")).where("x.kind = 'deleted'")
    attempts = F.least(F.col("x.fails") + 1, F.lit(most))
    done = F.col("x.purge_at") + F.make_dt_interval(secs=(attempts - 1) * pause_seconds)
    status = F.when(F.col("x.fails") < most, "purged").otherwise("conflict")
    return last.where(done <= F.lit(as_of).cast("timestamp")).select(key, status.alias("status"), attempts.cast("int").alias("attempts"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, begin, until, n, total) of runs of events less than ``gap`` apart. A stream's watermark closes them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("until"), "n", "total")


def without_repeats(events: DataFrame, key: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first event of each key; a repeat within ``late`` of it is dropped, and state is kept no longer than that."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def followed(first: DataFrame, second: DataFrame, key: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, first_id, first_ts, second_id, second_ts): events of ``second`` (id, key, ts) after one of ``first`` of the
    same key, no longer than ``within``. The time bound lets a stream forget rows that can't match any more."""
    a, b = (df.withWatermark("ts", late) if df.isStreaming else df for df in (first, second))
    a = a.select(F.col(key).alias("k"), F.col("id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = b.select(key, F.col("id").alias("second_id"), F.col("ts").alias("second_ts"))
    near = (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("k") == F.col(key)) & near).select(key, "first_id", "first_ts", "second_id", "second_ts")


class Frames(StatefulProcessor):
    """What is left of a job's last chunk, and whether the job has ended; whole frames become events."""

    def __init__(self, key: str, kind: str, terminal: tuple[str, ...]):
        self.key, self.kind, self.terminal = key, kind, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rest binary, n long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, n, ended = self.held.get() if self.held.exists() else (b"", 0, False)
        out = []
        for chunk in pd.concat(list(rows)).sort_values("seq", kind="stable")["chunk"]:
            if ended:
                break
            # Bytes, since a chunk may end within a character.
            *frames, rest = (bytes(rest) + bytes(chunk)).replace(b"\r\n", b"\n").split(b"\n\n")
            for frame in frames:
                body = "\n".join(x[5:].removeprefix(" ") for x in frame.decode("utf-8", "replace").split("\n") if x.startswith("data:"))
                try:
                    event = json.loads(body)
                except ValueError:
                    continue  # a comment, or what isn't an event
                if not isinstance(event, dict):
                    continue
                ended = event.get("stage") in self.terminal
                out.append((key[0], n, event.get("stage"), event.get("percent"), event.get("message"), ended))
                n += 1
                if ended:
                    rest = b""
                    break
        self.held.update((bytearray(rest), n, ended))
        frame = pd.DataFrame(out, columns=[self.key, "n", "stage", "percent", "message", "terminal"])
        yield frame.astype({"percent": "Int32"})

    def close(self) -> None:
        pass


def joined_frames(chunks: DataFrame, key: str = "job", terminal: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """chunks (job, seq, chunk binary) of server-sent events to (job, n, stage, percent, message, terminal).

    A frame ends at a blank line, wherever chunks are cut, within a character or a line end too; its ``data:`` lines are
    one JSON object. Comments and what is no object are left out; an absent field is null. After its first terminal
    stage a job has no more events. Chunks of a job must come in the order of their batches. State: the cut frame.
    """
    with_rocksdb(chunks.sparkSession)
    kind = dict(chunks.dtypes)[key]
    schema = f"{key} {kind}, n long, stage string, percent int, message string, terminal boolean"
    return chunks.groupBy(key).transformWithStateInPandas(Frames(key, kind, terminal), outputStructType=schema, outputMode="append", timeMode="none")
