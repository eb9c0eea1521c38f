"""Durable jobs as keyed state over an event stream, and the decisions that need no state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerlens.functions.rules import first_reason

LEASE_MS, MAX_ATTEMPTS, RETENTION_MS = 60_000, 3, 30 * 24 * 3600 * 1000
#: How long a finished job answers the next request, and items a job's request holds at most.
REUSE_MS, ITEMS = 300_000, 40
#: Events: market_key, ts_ms, action (enqueue, claim, progress, finish, release, fail), owner, priority; perhaps items (joined by commas) and reason.
STATE = "status string, owner string, lease_until long, attempts long, priority long, updated long, written long, items string, reason string"
RESULT = "market_key string, ts_ms long, action string, accepted boolean, " + STATE


def lease_decision(now: Column, lease_until: Column, status: Column, retry_after: Column, fresh_until: Column, heartbeat: Column | None = None, stale_ms: int = 720_000) -> Column:
    """What a discovery request does: held by another, waiting to retry, fresh enough, or start. A lease whose last heartbeat is older
    than stale_ms is open."""
    held = lease_until > now if heartbeat is None else (lease_until > now) & F.coalesce(now - heartbeat <= stale_ms, F.lit(True))
    return F.coalesce(first_reason([("lease_held", held), ("retry_backoff", (status == "failed") & (retry_after > now)), ("ttl_fresh", (status == "done") & (fresh_until > now))]), F.lit("start"))


def discovery_decision(now: Column, resolved: Column, verified: Column, candidates: Column, status: Column, lease_until: Column, started: Column, completed: Column, retry_at: Column, failure: Column, goal: int = 4, thin: int = 15, lease_ms: int = 2_700_000, useful_ms: int = 604_800_000, thin_ms: int = 86_400_000, quota_ms: int = 21_600_000) -> dict[str, Column]:
    """reason and start of a market's next discovery: the first of ten rules. status is null for a market without a state; times in ms."""
    since = lambda t, ms: F.coalesce(now - t < ms, F.lit(False))
    v, c = F.coalesce(verified, F.lit(0)), F.coalesce(candidates, F.lit(0))
    rules = [
        ("city_unresolved", ~F.coalesce(resolved, F.lit(False)), False), ("pool_healthy", v >= goal, False), ("partial_without_state", status.isNull() & (v > 0), True), ("unknown_coverage", status.isNull(), True),
        ("lease_held", lease_until > now, False), ("already_running", (status == "running") & since(started, lease_ms), False), ("stale_running", status == "running", True), ("retry_backoff", retry_at > now, False),
        ("ttl_fresh", (v >= goal) & (c >= thin) & since(completed, useful_ms), False), ("thin_cooldown", (c < thin) & verified.isNull() & since(completed, thin_ms), False),
        ("quota_backoff", (status == "failed") & (failure == "quota") & since(completed, quota_ms), False),
    ]
    reason = F.coalesce(first_reason([(name, p) for name, p, _ in rules]), status, F.lit("retry"))
    return {"reason": reason, "start": ~reason.isin(*(name for name, _, start in rules if not start))}


def import_status(venues: Column, services: Column, prices: Column, providers: Column) -> Column:
    """How an import ends: complete with providers and prices, partial with venues or services alone, else empty."""
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    return F.when(some(providers) & some(prices), "complete").when(some(venues) | some(services), "partial").otherwise("empty")


def import_decision(now: Column, status: Column, started: Column, completed: Column, prices: Column, providers: Column, ttl_ms: int = 7 * 86_400_000, empty_ms: int = 1_800_000, running_ms: int = 2_700_000) -> dict[str, Column]:
    """reason and start of a market's next import, from its last state; status is null without one. A running import is left alone for running_ms. A
    useful one is fresh for ttl_ms, one that brought nothing (also a complete one without prices), or only a part, rests empty_ms."""
    since = lambda t, ms: F.coalesce(now - t < ms, F.lit(False))
    useful = F.coalesce((prices > 0) & (providers > 0), F.lit(False))
    rests, ended = since(completed, empty_ms), status == "complete"
    rules = [
        ("missing", status.isNull(), True), ("already_running", (status == "running") & since(started, running_ms), False), ("stale_running", status == "running", True),
        ("empty_cooldown", (ended & ~useful & rests) | ((status == "empty") & rests), False), ("partial_cooldown", (status == "partial") & rests, False), ("complete_but_empty", ended & ~useful, True),
        ("ttl_fresh", ended & since(completed, ttl_ms), False), ("ttl_expired", ended, True), ("empty_retry", status == "empty", True), ("partial_retry", status == "partial", True),
    ]
    reason = F.coalesce(first_reason([(name, p) for name, p, _ in rules]), status)
    return {"reason": reason, "start": ~reason.isin(*(name for name, _, start in rules if not start))}


def discovery_finished(resolved: Column, thin: Column, candidates: Column, verified: Column, failure: Column, goal: int = 4, quota_ms: int = 21_600_000, failed_ms: int = 1_800_000, thin_ms: int = 86_400_000) -> dict[str, Column]:
    """status and retry_ms (how long to wait; null: no wait) of a discovery that ended. Candidates alone never complete a market: without a verified row
    it is partial, without candidates too it is thin; below the goal, or thin in candidates, it stays partial."""
    c, v = F.coalesce(candidates, F.lit(0)), F.coalesce(verified, F.lit(0))
    failed = failure.isNotNull() & F.coalesce(resolved, F.lit(False))
    status = F.when(~F.coalesce(resolved, F.lit(False)) | failed, "failed").when((v <= 0) & (c <= 0), "thin").when(v <= 0, "partial").when(F.coalesce(thin, F.lit(False)) | (v < goal), "partial").otherwise("complete")
    return {"status": status, "retry_ms": F.when(failed & (failure == "quota"), quota_ms).when(failed, failed_ms).when(status == "thin", thin_ms)}


def retry_blocked(now: Column, permanent: Column, retry_after: Column, lease_until: Column) -> Column:
    return F.coalesce(permanent.isNotNull() | (retry_after > now) | (lease_until > now), F.lit(False))


def merged_items(old: str, new: str) -> str:
    """Items of both requests in order, each once, ITEMS at most."""
    return ",".join(list(dict.fromkeys(x for x in f"{old},{new}".split(",") if x))[:ITEMS])


def apply_event(state: tuple, event) -> tuple[tuple, bool]:
    """The state after an event, and whether the event was accepted.

    An active job takes no second enqueue, but its request is merged if the new priority is no lower: items in order, the higher
    priority, and the reason `user` sticks. A job finished less than REUSE_MS ago answers a request, unless a user asks. Only the
    owner with a running lease may report; an expired lease is open to others until the attempts are used up."""
    status, owner, lease, attempts, priority, updated, written, items, reason = state
    t, action = int(event.ts_ms), event.action
    live = status == "running" and lease > t
    if action == "enqueue":
        asked, why = getattr(event, "items", None) or "", getattr(event, "reason", None) or ""
        if status in ("queued", "running"):
            if int(event.priority) >= priority:
                priority, items, reason = int(event.priority), merged_items(items, asked), "user" if "user" in (reason, why) else why or reason
            return (status, owner, lease, attempts, priority, t, written, items, reason), False
        if status == "done" and t - updated < REUSE_MS and why != "user":
            return state, False
        return ("queued", None, 0, 0, int(event.priority), t, written, merged_items("", asked), why), True
    if action == "claim":
        if status == "queued" or (status == "running" and not live and attempts < MAX_ATTEMPTS):
            return ("running", event.owner, t + LEASE_MS, attempts + 1, priority, t, written, items, reason), True
        if status == "running" and not live:
            return ("failed", None, 0, attempts, priority, t, written, items, reason), False
        return state, False
    if not live or owner != event.owner:
        return state, False
    if action == "progress":
        return (status, owner, t + LEASE_MS, attempts, priority, t, written + 1, items, reason), True
    if action == "release":
        return ("queued", None, 0, attempts, priority, t, written, items, reason), True
    if action in ("finish", "fail"):
        return ("done" if action == "finish" else "failed", None, 0, attempts, priority, t, written, items, reason), True
    return state, False


START = ("none", None, 0, 0, 0, 0, 0, "", "")


def focus(events: DataFrame) -> DataFrame:
    """Focus events (client_id, seq, ts_ms, market_key) with accepted: the sequence is above all that the client sent before; a late or
    repeated one is stale. One window a client, streamed over sorted rows."""
    before = F.max("seq").over(Window.partitionBy("client_id").orderBy("ts_ms", "seq", "market_key").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("accepted", F.coalesce(F.col("seq") > before, F.lit(True)))


def focus_priorities(focused: DataFrame, front: int = 100, back: int = 70) -> DataFrame:
    """client_id, market_key and priority after the events: the client's last accepted market is in front, those before go back."""
    good = focused.filter("accepted")
    last = good.groupBy("client_id").agg(F.max_by("market_key", F.struct("seq", "ts_ms")).alias("_front"))
    jobs = good.select("client_id", "market_key").distinct().join(last, "client_id")
    return jobs.select("client_id", "market_key", F.when(F.col("market_key") == F.col("_front"), front).otherwise(back).alias("priority"))


def replay(events: DataFrame) -> DataFrame:
    """RESULT of each event in a batch, in order of time within a market.

    A market's events come to one task in order, but never into memory together: Spark sorts them on disk, and the fold keeps one
    market's state while batches stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, state = None, START
        for batch in batches:
            rows = []
            for e in batch.itertuples():
                if e.market_key != market:
                    market, state = e.market_key, START
                state, accepted = apply_event(state, e)
                rows.append((market, e.ts_ms, e.action, accepted, *state))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    named = events.filter("market_key is not null")  # an event without a market belongs to no job
    return named.repartition("market_key").sortWithinPartitions("market_key", "ts_ms", "seq").mapInPandas(run, RESULT)


def track(events: DataFrame) -> DataFrame:
    """The same over a stream: state by market, dropped RETENTION_MS after a market's last event."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = tuple(state.get) if state.exists else START
        rows = []
        group = pd.concat(list(frames))
        for e in group.sort_values(["ts_ms", "seq"], kind="stable").itertuples():
            current, accepted = apply_event(current, e)
            rows.append((key[0], e.ts_ms, e.action, accepted, *current))
        state.update(current)
        state.setTimeoutDuration(RETENTION_MS)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return events.groupBy("market_key").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and values by window and type; on a stream, late rows beyond the watermark are left out."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", lateness) if events.isStreaming else ts
    return ts.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upsert_batches(path: str, keys: list[str], buckets: int = 64):
    """A foreachBatch sink: the batch's rows (the newest a key, by `updated`) replace those of the same keys.

    The table is cut into buckets by a hash of the keys; a batch writes anew only the buckets that it touches, as version v=number
    of these. A replayed batch reads what was there before it and gives the same table. Older versions of a bucket go once two
    newer ones are complete, so that readers and replays still find theirs. `read_upserted` reads the table."""
    from offerlens.operators.resolve import overwrite_upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "updated").alias("_r")).select(*keys, "_r.*")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in last.select(bucket).distinct().collect()]  # `buckets` numbers at most
        old = read_upserted(spark, path, number, touched)
        table = last if old is None else overwrite_upsert(old, last, keys)
        table.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        _forget_versions(spark, path, number, touched)

    return write


def merge_versions(old: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old after changes, both with `version` and `deleted`: of each key the row of the greatest version, of equal versions the old one, so that
    a stale or repeated writer changes nothing. Deleted rows stay as tombstones: a late change of an older version can't bring them back."""
    rest = [c for c in changes.columns if c not in keys]
    changes = changes.withColumns({"deleted": F.coalesce("deleted", F.lit(False)), "_new": F.lit(1)})
    both = changes if old is None else old.select(*changes.columns[:-1], F.lit(0).alias("_new")).unionByName(changes)
    # of several changes of one version in a batch the greatest row, whatever their order
    ranked = F.struct("version", (-F.col("_new")).alias("_old_first"), *(F.col(c) for c in rest if c != "version"))
    return both.filter("version is not null").groupBy(*keys).agg(F.max(ranked).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def refused(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The changes that merge_versions refuses: their version is no greater than the stored one."""
    stored = old.select(*keys, F.col("version").alias("_stored"))
    return changes.join(stored, keys).filter(F.col("version") <= F.col("_stored")).drop("_stored")


def mirror_batches(path: str, keys: list[str], buckets: int = 64):
    """A foreachBatch sink that also deletes: rows (keys, version, deleted, ...) by merge_versions, in buckets as in `upsert_batches`.

    A replayed batch, a late one and batches in another order leave the same table; `read_mirrored` shows what isn't deleted."""

    def write(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        table = merge_versions(read_upserted(batch.sparkSession, path, number, touched), batch, keys)
        table.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        _forget_versions(batch.sparkSession, path, number, touched)

    return write


def read_mirrored(spark: SparkSession, path: str) -> DataFrame | None:
    got = read_upserted(spark, path)
    return got.filter("not deleted").drop("deleted") if got is not None else None


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(version, bucket) of all folders of the table whose version is complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for v in fs.listStatus(folder) if fs.exists(folder) else []:
        if v.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            out += [(int(v.getPath().getName()[2:]), int(b.getPath().getName()[7:])) for b in fs.listStatus(v.getPath()) if b.getPath().getName().startswith("bucket=")]
    return out


def read_upserted(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table that upsert_batches writes: of each bucket the newest version (older than `before`); None if there is none."""
    newest: dict[int, int] = {}
    for v, b in _versions(spark, path):
        if (before is None or v < before) and (buckets is None or b in buckets):
            newest[b] = max(v, newest.get(b, v))
    if not newest:
        return None
    return spark.read.parquet(*(f"{path}/v={v}/bucket={b}" for b, v in sorted(newest.items())))


def _forget_versions(spark: SparkSession, path: str, number: int, touched: list[int]) -> None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    have: dict[int, list[int]] = {}
    for v, b in _versions(spark, path):
        if b in touched and v <= number:
            have.setdefault(b, []).append(v)
    for b, versions in have.items():
        for v in sorted(versions)[:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/bucket={b}"), True)
