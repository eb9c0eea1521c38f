"""Keyed state with timers and a time to live (transformWithState): snapshots of partial results, leases with heartbeats, focus with
display acknowledgement. Each processor has a batch twin over the same events; a stream that is stopped and started again from its
checkpoint ends with the batch's rows.

State is keyed and lives in the state store, so that it survives executors; a key's state is a few values and one map entry a
provider, read one at a time. Rows of one key and micro-batch are folded in order of (ts_ms, seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

#: Rows that a snapshot publishes at most, and the place of the row whose latency is the second one kept.
CAP, SIXTH = 30, 6
#: How long a finished key's state stays, and how long a lease lasts without a heartbeat.
KEEP_MS, STALE_MS = 30 * 24 * 3600 * 1000, 720_000

SNAPSHOT = "job string, n long, first_ms long, sixth_ms long, done boolean, shown array<string>"
LEASES = "market string, ts_ms long, action string, owner string, accepted boolean, holder string"
FOCUS = "client string, ts_ms long, action string, market string, accepted boolean, reason string, ready boolean"


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, in order."""
    return pd.concat(list(frames)).sort_values(["ts_ms", "seq"], kind="stable")


class PartialResults(StatefulProcessor):
    """Events (job, ts_ms, seq, action: start, row or finish, provider) to SNAPSHOT rows: one a job and micro-batch, the newest being right.

    The first row of a provider counts, up to CAP providers are shown in order of arrival; latencies run from the job's start (or its
    first event). A finished job takes no more rows; its state goes KEEP_MS after its last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "started long, n long, first_ms long, sixth_ms long, done boolean, last long", ttlDurationMs=None)
        self.providers = handle.getMapState("providers", StructType([StructField("provider", StringType())]), "ord long", ttlDurationMs=None)
        self.shown = handle.getListState("shown", StructType([StructField("provider", StringType())]), ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, n, first, sixth, done, _ = self.meta.get() if self.meta.exists() else (None, 0, None, None, False, 0)
        last = 0
        for e in in_order(rows).itertuples():
            t = last = int(e.ts_ms)
            started = t if started is None else started
            if done:
                continue
            if e.action == "finish":
                done = True
            elif e.action == "row" and isinstance(e.provider, str) and not self.providers.containsKey((e.provider,)):
                self.providers.updateValue((e.provider,), (n,))
                n += 1
                first = t - started if n == 1 else first
                sixth = t - started if n == SIXTH else sixth
                if n <= CAP:
                    self.shown.appendValue((e.provider,))
        self.meta.update((started, n, first, sixth, done, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + KEEP_MS)
        yield pd.DataFrame({"job": [key[0]], "n": [n], "first_ms": pd.array([first], dtype="Int64"), "sixth_ms": pd.array([sixth], dtype="Int64"), "done": [done], "shown": [[r[0] for r in self.shown.get()]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.meta.clear()
        self.providers.clear()
        self.shown.clear()
        yield from ()

    def close(self) -> None:
        pass


def partial_results(events: DataFrame) -> DataFrame:
    """SNAPSHOT rows of a stream, in update mode."""
    return events.groupBy("job").transformWithStateInPandas(PartialResults(), SNAPSHOT, "Update", "ProcessingTime")


def partial_results_batch(events: DataFrame) -> DataFrame:
    """The last SNAPSHOT of each job. A job's providers are reduced to their first rows before anything is ranked."""
    of_job = Window.partitionBy("job")
    at = F.struct("ts_ms", "seq")
    ends = events.groupBy("job").agg(F.min("ts_ms").alias("started"), F.min(F.when(F.col("action") == "finish", at)).alias("end"))
    rows = events.filter("action = 'row' and provider is not null").join(ends, "job").filter(F.col("end").isNull() | (at < F.col("end")))
    once = rows.groupBy("job", "provider").agg(F.min(at).alias("at"), F.first("started").alias("started"))
    ranked = once.withColumn("k", F.row_number().over(of_job.orderBy("at", "provider")))
    latency = lambda k: F.min(F.when(F.col("k") == k, F.col("at.ts_ms") - F.col("started")))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= CAP, F.struct("k", "provider")))), lambda x: x["provider"])
    got = ranked.groupBy("job").agg(F.count("*").alias("n"), latency(1).alias("first_ms"), latency(SIXTH).alias("sixth_ms"), shown.alias("shown"))
    return ends.join(got, "job", "left").select("job", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first_ms", "sixth_ms", F.col("end").isNotNull().alias("done"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def lease_step(state: tuple, t: int, action: str, owner: str | None) -> tuple[tuple, bool]:
    """(holder, beat) after an event, and whether it was accepted: a free or stale lease is taken by any owner, a held one is kept, given up or
    renewed by its holder alone."""
    holder, beat = state
    live = holder is not None and t - beat < STALE_MS
    if action == "acquire":
        return ((owner, t), True) if owner and (not live or holder == owner) else (state, False)
    if not live or owner != holder:
        return state, False
    if action == "heartbeat":
        return (holder, t), True
    return ((None, 0), True) if action == "release" else (state, False)


class Leases(StatefulProcessor):
    """Events (market, ts_ms, seq, action: acquire, heartbeat or release, owner) to LEASES rows, in append mode by event time.

    The lease is a value; its timer stands STALE_MS behind the last heartbeat, and when the watermark passes it the lease is put out as
    `expired` and forgotten, so that a market without events needs no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, beat long", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.lease.get()) if self.lease.exists() else (None, 0)
        out = []
        for e in in_order(rows).itertuples():
            state, accepted = lease_step(state, int(e.ts_ms), e.action, e.owner if isinstance(e.owner, str) else None)
            out.append((key[0], int(e.ts_ms), e.action, e.owner, accepted, state[0]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] is None:
            self.lease.clear()
        else:
            self.lease.update(state)
            self.handle.registerTimer(state[1] + STALE_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            holder, beat = self.lease.get()
            self.lease.clear()
            yield pd.DataFrame([(key[0], beat + STALE_MS, "expired", holder, True, None)], columns=[c.split()[0] for c in LEASES.split(", ")])

    def close(self) -> None:
        pass


def leases(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """LEASES rows of a stream whose events are no later than `lateness`."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)
    return timed.groupBy("market").transformWithStateInPandas(Leases(), LEASES, "Append", "EventTime")


def leases_batch(events: DataFrame) -> DataFrame:
    """LEASES rows of a batch without the expiries: markets stream by in order, and one market's lease is held."""
    names = [c.split()[0] for c in LEASES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, state = None, (None, 0)
        for batch in batches:
            out = []
            for e in batch.itertuples():
                if e.market != market:
                    market, state = e.market, (None, 0)
                state, accepted = lease_step(state, int(e.ts_ms), e.action, e.owner if isinstance(e.owner, str) else None)
                out.append((market, int(e.ts_ms), e.action, e.owner, accepted, state[0]))
            yield pd.DataFrame(out, columns=names)

    return events.filter("market is not null").repartition("market").sortWithinPartitions("market", "ts_ms", "seq").mapInPandas(run, LEASES)


class Focus(StatefulProcessor):
    """Events (client, ts_ms, seq, action: focus or display, market, focus_seq, display_seq, shown) to FOCUS rows.

    A focus is accepted if its sequence is above the client's last one. A display report counts for the focus it names: it is
    `stale_focus` unless that is the client's current one on that market, `stale_display` unless its own sequence rises. It is ready once
    something is shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "market string, focus_seq long, display_seq long", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.current.get()) if self.current.exists() else None
        out = []
        for e in in_order(rows).itertuples():
            state, accepted, reason, ready = focus_step(state, e)
            out.append((key[0], int(e.ts_ms), e.action, e.market, accepted, reason, ready))
        if state is not None:
            self.current.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOCUS.split(", ")])

    def close(self) -> None:
        pass


def focus_step(state: tuple | None, e) -> tuple[tuple | None, bool, str | None, bool]:
    """(market, focus_seq, display_seq) after an event; accepted, reason and ready."""
    if e.action == "focus":
        if state is not None and int(e.focus_seq) <= state[1]:
            return state, False, "stale_focus", False
        return (e.market, int(e.focus_seq), 0), True, None, False
    if state is None:
        return state, False, "unknown_client", False
    if e.market != state[0] or int(e.focus_seq) != state[1]:
        return state, False, "stale_focus", False
    if int(e.display_seq) <= state[2]:
        return state, False, "stale_display", False
    return (state[0], state[1], int(e.display_seq)), True, None, int(e.shown) > 0


def acknowledged(events: DataFrame) -> DataFrame:
    """FOCUS rows of a stream, in append mode."""
    return events.groupBy("client").transformWithStateInPandas(Focus(), FOCUS, "Append", "None")


def acknowledged_batch(events: DataFrame) -> DataFrame:
    """FOCUS rows of a batch by windows alone: a running maximum gives the focus that counts, a second one the displays under it."""
    order = Window.partitionBy("client").orderBy("ts_ms", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_focus = F.col("action") == "focus"
    rows = events.withColumn("top", F.max(F.when(is_focus, F.col("focus_seq"))).over(before)).withColumn("taken", is_focus & F.coalesce(F.col("focus_seq") > F.col("top"), F.lit(True)))
    rows = rows.withColumn("front", F.last(F.when(F.col("taken"), F.col("market")), ignorenulls=True).over(before)).withColumn("fits", ~is_focus & (F.col("focus_seq") == F.col("top")) & (F.col("market") == F.col("front")))
    under = Window.partitionBy("client", "top").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("shown_to", F.coalesce(F.max(F.when(F.col("fits"), F.col("display_seq"))).over(under), F.lit(0)))
    good = F.when(is_focus, F.col("taken")).otherwise(F.coalesce(F.col("fits") & (F.col("display_seq") > F.col("shown_to")), F.lit(False)))
    why = F.when(good, None).when(is_focus, "stale_focus").when(F.col("top").isNull(), "unknown_client").when(F.coalesce(F.col("fits"), F.lit(False)), "stale_display").otherwise("stale_focus")
    return rows.select("client", "ts_ms", "action", "market", good.alias("accepted"), why.alias("reason"), (good & ~is_focus & (F.col("shown") > 0)).alias("ready"))
