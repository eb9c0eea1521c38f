"""Evidence and serving operators on small tables with nulls, ties and empty groups."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import evidence
from offerlens.operators import serve
from offerlens.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "source,amount,found",
    [("costs 1,250 in all", 1250, True), ("costs 1.250 EUR", 1250, True), ("1 250", 1250, True), ("11,250", 1250, False), ("1,250,000", 1250, False), ("12500", 1250, False), ("", 1250, False), (None, 1250, False), ("call 1250", None, False), ("peel €99.50", 99.5, True), ("€1,299.50", 1299.5, True), ("129,50 €", 129.5, True), ("peel 99.5", 99.5, True), ("€99.99", 99.5, False), ("1250.00", 1250, True), ("1250.50", 1250, False), ("7,05", 7.05, True), ("7.5", 7.05, False)],
)
def test_literally_in(spark, source, amount, found):
    assert value(spark, evidence.literally_in(F.lit(source).cast("string"), F.lit(amount).cast("double"))) is found


@pytest.mark.parametrize(
    "label,want",
    [("from $120", (120.0, None, "from")), ("$120 - $300", (120.0, 300.0, "range")), ("approx. 80", (80.0, None, "approximate")), ("1.250,50 €", (1250.5, None, "fixed")), ("ask us", (None, None, None)), ("", (None, None, None)), (None, (None, None, None))],
)
def test_price_text(spark, label, want):
    got = evidence.price_text(F.lit(label).cast("string"))
    assert tuple(value(spark, got[k]) for k in ("price_min", "price_max", "price_type")) == want


@pytest.mark.parametrize("text,want", [("cafÃ©", "café"), ("café", "café"), ("plain", "plain"), ("Ð¶", "ж"), ("Ã", "Ã"), ("ж", "ж"), (None, None), ("", "")])
def test_mojibake(spark, text, want):
    assert value(spark, evidence.mojibake_repaired(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("+1 (555) 123-4567", "551234567"[-9:]), ("1234", None), (None, None)])
def test_phone_key(spark, text, want):
    got = value(spark, evidence.phone_key(F.lit(text).cast("string")))
    assert got == ("551234567" if want else None)


def test_one_per_category_equals_a_loop(spark):
    rows = [(c, k, float((c * 7 + k * 3) % 11)) for c in range(5) for k in range(6)]
    got = serve.one_per_category(spark.createDataFrame(rows, "category int, k int, score double"), "category", "k", "score", 5).collect()
    want, used = {}, set()
    for c in range(5):
        for _, k in sorted((-s, k) for cc, k, s in rows if cc == c):
            if k not in used:
                want[c] = k
                used.add(k)
                break
    assert {r["category"]: r["k"] for r in got} == want
    assert serve.one_per_category(spark.createDataFrame([], "category int, k int, score double"), "category", "k", "score", 5).count() == 0


def test_one_per_category_can_run_out(spark):
    rows = [(1, 10, 1.0), (2, 10, 2.0), (3, 11, 1.0)]
    got = serve.one_per_category(spark.createDataFrame(rows, "category int, k int, score double"), "category", "k", "score", 3)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (3, 11)]


def test_slots_keep_gaps(spark):
    shown = spark.createDataFrame([(1, 7, 2, "old")], "session int, k int, slot long, value string")
    fresh = spark.createDataFrame([(1, 7, 5, "new"), (1, 8, 1, "a"), (1, 9, 2, "b"), (2, 8, 1, "c")], "session int, k int, rank int, value string")
    got = serve.stabilise_slots(shown, fresh, "session", "k", 2).select("session", "k", "slot", "value").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 2, "new"), (1, 8, 1, "a"), (2, 8, 1, "c")]


def test_enqueue_keeps_null_keys(spark):
    c = spark.createDataFrame([(1, None, None), (2, "a", False), (3, "b", True)], "id int, host string, bad boolean")
    known = spark.createDataFrame([("host:a",), ("host:a",)], "key string")
    got = serve.enqueue_candidates(c, known, {"host": F.col("host")}, F.col("bad"), "id")
    assert {r["id"]: r["decision"] for r in got.collect()} == {1: "queued", 2: "known", 3: "blocked"}


def test_invalidate_dry_run(spark):
    o = spark.createDataFrame([(1, 5.0), (2, None)], "id int, price double")
    reason = F.when(F.col("price") > 1, "odd")
    assert [tuple(r) for r in serve.invalidate_untrusted(o, reason, ["price"]).orderBy("id").collect()] == [(1, None, "odd", 5.0), (2, None, None, None)]
    assert serve.invalidate_untrusted(o, reason, ["price"], dry_run=True).columns == ["id", "price", "invalid_reason"]


def test_replay_streams_a_hot_market(spark):
    """One market with many more events than an Arrow batch holds: its state goes on over batches."""
    events = spark.range(25_000).select(F.lit("m").alias("market_key"), F.col("id").alias("ts_ms"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "enqueue").when(F.col("id") == 1, "claim").otherwise("progress").alias("action"), F.lit("o").alias("owner"), F.lit(1).cast("long").alias("priority"))
    got = jobs.replay(events)
    assert got.filter("accepted").count() == 25_000
    assert got.agg(F.max("written")).first()[0] == 24_998


@pytest.mark.parametrize(
    "status,started,completed,prices,providers,reason,start",
    [(None, None, None, None, None, "missing", True), ("running", 99, None, 0, 0, "already_running", False), ("running", None, None, 0, 0, "stale_running", True), ("complete", None, 99, 0, 5, "empty_cooldown", False), ("complete", None, None, None, None, "complete_but_empty", True),
     ("complete", None, 99, 1, 1, "ttl_fresh", False), ("complete", None, -10**10, 1, 1, "ttl_expired", True), ("empty", None, 99, 0, 0, "empty_cooldown", False), ("partial", None, -10**10, 0, 0, "partial_retry", True), ("failed", None, None, 0, 0, "failed", True)],
)
def test_import_decision(spark, status, started, completed, prices, providers, reason, start):
    long = lambda x: F.lit(x).cast("long")
    got = jobs.import_decision(long(100), F.lit(status).cast("string"), long(started), long(completed), long(prices), long(providers))
    assert (value(spark, got["reason"]), value(spark, got["start"])) == (reason, start)
