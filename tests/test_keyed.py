"""Keyed streams against their batch twins, stopped and started again between micro-batches."""

import pytest
from pyspark.sql import functions as F

from offerlens.streaming import keyed
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def store(spark):
    """Keyed state with timers needs the column-family state store."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, tmp_path, batches, flow, mode, **trigger):
    """Rows that a stream puts out for batches, with a new query, from the same checkpoint, for each batch."""
    schema = batches[0].schema
    out = []
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got: list = []
        query = flow(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(**(trigger or {"once": True})).foreachBatch(lambda df, n, got=got: got.extend(df.collect())).start()
        assert query.awaitTermination(60)
        out += [(k, r) for r in got]
    return out


def shown_events(spark):
    """A job a user: the first event starts it, a purchase ends it, all others bring a row of a provider."""
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    provider = F.concat(F.lit("p"), F.col("event_id") % 9)
    return e.filter("user_id < 12").select(F.concat(F.lit("j"), F.col("user_id")).alias("job"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 41 == 40, "finish").otherwise("row").alias("action"), F.when(F.col("event_id") % 13 > 0, provider).alias("provider"))


def test_partial_results_after_a_restart(spark, tmp_path, store):
    events = shown_events(spark).cache()
    cuts = events.approxQuantile("ts_ms", [0.3, 0.6], 0.0)
    batches = [events.filter(F.col("ts_ms") <= cuts[0]), events.filter((F.col("ts_ms") > cuts[0]) & (F.col("ts_ms") <= cuts[1])), events.filter(F.col("ts_ms") > cuts[1])]
    got = streamed(spark, tmp_path, batches, keyed.partial_results, "update")
    last = {r["job"]: r for _, r in got}
    want = {r["job"]: r for r in keyed.partial_results_batch(events).collect()}
    assert {k: r.asDict() for k, r in last.items()} == {k: r.asDict() for k, r in want.items()}
    assert any(r["done"] for r in want.values()) and any(r["sixth_ms"] is not None for r in want.values())
    # on the way, too: after the first batch the snapshots are those of its events
    first = {r["job"]: r.asDict() for k, r in got if k == 0}
    assert first == {r["job"]: r.asDict() for r in keyed.partial_results_batch(batches[0]).collect()}


def test_leases_after_a_restart(spark, tmp_path, store):
    minute = 60_000
    rows = [("m", 0, 1, "acquire", "a"), ("m", 5, 2, "acquire", "b"), ("m", 10, 3, "heartbeat", "a"), ("m", 15, 4, "heartbeat", "b"), ("m", 23, 5, "acquire", "b"), ("n", 16, 6, "acquire", "x"), ("n", 17, 7, "release", "x"), ("n", 18, 8, "release", "x"), ("n", 19, 9, "acquire", None), ("m", 30, 10, "release", "b"), ("o", 60, 11, "acquire", "z"), ("o", 61, 12, "acquire", "z")]
    schema = "market string, ts_ms long, seq long, action string, owner string"
    frames = [spark.createDataFrame([(m, (t + 100) * minute, s, a, o) for m, t, s, a, o in part], schema) for part in (rows[:3], rows[3:9], rows[9:])]
    frames += [spark.createDataFrame([("p", (t + 100) * minute, s, "acquire", "q")], schema) for t, s in ((200, 13),)]  # time goes on
    got = [tuple(r) for _, r in streamed(spark, tmp_path, frames, keyed.leases, "append", availableNow=True)]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert sorted((r for r in got if r[2] != "expired" and r[0] != "p"), key=str) == sorted(map(tuple, keyed.leases_batch(whole).collect()), key=str)
    assert ("o", 161 * minute + keyed.STALE_MS, "expired", "z", True, None) in got
    assert not any(r[0] == "n" and r[2] == "expired" for r in got)


def test_focus_and_display(spark, tmp_path, store):
    rows = [
        ("c", 1, 1, "display", "rome", 1, 1, 4), ("c", 2, 2, "focus", "rome", 1, 0, 0), ("c", 3, 3, "display", "rome", 1, 1, 0), ("c", 4, 4, "display", "rome", 1, 1, 4), ("c", 5, 5, "display", "rome", 1, 2, 4), ("c", 6, 6, "focus", "oslo", 3, 0, 0),
        ("c", 7, 7, "display", "rome", 1, 3, 4), ("c", 8, 8, "focus", "rome", 2, 0, 0), ("c", 9, 9, "display", "oslo", 3, 1, 2), ("c", 10, 10, "display", "rome", 3, 2, 2), ("d", 1, 11, "focus", "rome", 1, 0, 0), ("d", 2, 12, "focus", "rome", 1, 0, 0), ("d", 3, 13, "display", "rome", 1, 1, 0),
    ]
    schema = "client string, ts_ms long, seq long, action string, market string, focus_seq long, display_seq long, shown long"
    events = spark.createDataFrame(rows, schema)
    got = [r for _, r in streamed(spark, tmp_path, [events.filter("seq <= 5"), events.filter("seq > 5")], keyed.acknowledged, "append")]
    batch = keyed.acknowledged_batch(events).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch))
    assert [r["reason"] for r in sorted(batch, key=lambda r: (r["client"], r["ts_ms"]))] == ["unknown_client", None, None, "stale_display", None, None, "stale_focus", "stale_focus", None, "stale_focus", None, "stale_focus", None]
    assert sum(r["ready"] for r in batch) == 2


def test_a_mirror_deletes_and_refuses(spark, tmp_path):
    """Replayed, late and reordered batches leave the same table; tombstones keep old versions away."""
    from offerlens.streaming import jobs

    schema = "k long, version long, deleted boolean, x string"
    batches = [spark.createDataFrame(rows, schema) for rows in ([(1, 1, False, "a"), (2, 1, None, "b"), (3, 5, False, "c"), (4, None, False, "no")], [(1, 2, True, None), (2, 1, False, "stale"), (5, 1, True, "never")], [(1, 1, False, "late"), (3, 6, False, "d"), (3, 4, False, "old"), (5, 2, False, "e")])]
    tables = []
    for name, order in (("a", [0, 1, 2]), ("b", [0, 1, 1, 2]), ("c", [1, 0, 2]), ("d", [2, 1, 0])):
        write = jobs.mirror_batches(str(tmp_path / name), ["k"], 4)
        seen: dict = {}
        for place, n in enumerate(order):
            number = seen.setdefault(n, place)  # a replay bears its batch's number
            write(batches[n], number)
        tables.append(sorted(map(tuple, jobs.read_mirrored(spark, str(tmp_path / name)).drop("bucket").collect())))
    assert tables[0] == tables[1] == [(2, 1, "b"), (3, 6, "d"), (5, 2, "e")]
    assert [[r for r in x if r[0] != 2] for x in tables[2:]] == [[(3, 6, "d"), (5, 2, "e")]] * 2  # of equal versions the first one stays
    assert jobs.read_mirrored(spark, str(tmp_path / "none")) is None
    old = jobs.merge_versions(None, batches[0], ["k"])
    assert {tuple(r) for r in jobs.refused(old, batches[1], ["k"]).collect()} == {(2, 1, False, "stale")}
