"""Operators on fixtures of our own: fictional providers, pages and jobs."""

import json

import pytest
from pyspark.sql import functions as F

from offerlens.functions import rules, text
from offerlens.operators import rank, resolve
from offerlens.sources import curated, pages
from offerlens.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("label", "number"), [("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1 234", 1234.0), ("12", 12.0), ("1.234", 1234.0), ("99,9", 99.9), ("about", None), ("", None), ("1,234.567", 1234.567), ("1.234,567", 1234.567), ("12.3456", 12.3456), ("1,2345", 1.2345), ("1.234.567", 1234567.0), ("1,234,567.5", 1234567.5), ("1.234.56", None), ("12'345", 12345.0), ("0,5", 0.5), (None, None)])
def test_locale_number(spark, label, number):
    assert one(spark, text.locale_number(F.col("t")), t=label) == number


@pytest.mark.parametrize(("label", "code"), [("from €20", "EUR"), ("20 USD", "USD"), ("USDX 20", None), ("£5", "GBP"), ("", None)])
def test_currency(spark, label, code):
    assert one(spark, text.currency_of(F.col("t"), [("€", "EUR"), ("$", "USD"), ("£", "GBP")]), t=label) == code


@pytest.mark.parametrize(("name", "packed"), [("The Rose Clinic Ltd", "rose"), ("Clinic Clinic", "clinicclinic"), ("Été & Co.", "ete"), ("Rose of Clinic Town", "roseofclinictown")])
def test_packed_name(spark, name, packed):
    assert one(spark, text.packed_name(F.col("t"), ["the", "clinic", "ltd", "co"]), t=name) == packed


@pytest.mark.parametrize(("day", "value", "unit", "due"), [("2024-01-31", 1, "months", "2024-02-29"), ("2024-02-29", 1, "years", "2025-03-01"), ("2024-02-29", 4, "years", "2028-02-29"), ("2024-01-01", 2, "weeks", "2024-01-15"), ("2023-12-31", 1, "days", "2024-01-01")])
def test_add_period(spark, day, value, unit, due):
    assert str(one(spark, text.add_period(F.col("d").cast("date"), F.col("v").cast("int"), F.col("u")), d=day, v=value, u=unit)) == due


@pytest.mark.parametrize(("label", "day"), [("2024-02-30", None), ("2024-02-29", "2024-02-29"), ("29.02.2024", None)])
def test_strict_date(spark, label, day):
    got = one(spark, text.strict_date(F.col("t")), t=label)
    assert (got and str(got)) == day


def test_first_reason_keeps_order_and_counts_null_as_false(spark):
    checks = [("a", F.lit(None).cast("boolean")), ("b", F.col("x") > 1), ("c", F.col("x") > 0)]
    got = spark.createDataFrame([(2,), (1,), (0,)], "x int").select(rules.first_reason(checks).alias("r")).collect()
    assert [r["r"] for r in got] == ["b", "c", None]


def test_first_match_join_equals_chain(spark):
    labels = [("lip", "filler"), ("tox", "toxin"), ("lip tox", "never")]
    df = spark.createDataFrame([(1, "a lip tox"), (2, "tox"), (3, None), (4, "peel")], "k long, t string")
    table = spark.createDataFrame([(p, n, c) for p, (n, c) in enumerate(labels)], "priority int, needle string, label string")
    joined = {r["k"]: r["label"] for r in rules.first_match_join(df, "t", table, "k").collect()}
    assert joined == {r["k"]: r["x"] for r in df.select("k", rules.first_match(F.col("t"), labels).alias("x")).collect()} == {1: "filler", 2: "toxin", 3: None, 4: None}


def test_greedy_dedupe_is_not_transitive(spark):
    df = spark.createDataFrame([("m", 1, ["a"]), ("m", 2, ["a", "b"]), ("m", 3, ["b"]), ("n", 1, ["a"])], "g string, ord int, ks array<string>")
    kept = {(r["g"], r["ord"]) for r in resolve.greedy_dedupe(df, ["g"], ["ord"], "ks").collect()}
    assert kept == {("m", 1), ("m", 3), ("n", 1)}  # row 2 was dropped, so its key b is still free


def test_ordered_fold_sees_the_running_best(spark):
    df = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 4.0), ("p", 3, 7.0)], "k string, ord int, v double")
    got = rank.ordered_fold(df, ["k"], ["ord"], "v", lambda a, r: r["v"] > a["v"] + 1.5).first()
    assert got["best"]["v"] == 7.0


def test_overwrite_and_union(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in resolve.overwrite_upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_keyed_merge(spark):
    cols = "k int, at int, v string"
    old, new = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (2, 5, "c")], cols), spark.createDataFrame([(1, 5, "d"), (2, 4, "e"), (3, None, "f")], cols)
    assert {tuple(r) for r in resolve.keyed_merge(old, new, ["k"], ["at"], ["v"]).collect()} == {(1, 5, "d"), (2, 5, "c"), (3, None, "f")}


def test_curated_file(spark, tmp_path):
    service = {"name": "Lip care", "category": "lips", "price": 200, "source_url": "https://rose.example/prices/lips", "unit": "per 2 areas"}
    clinics = [{"name": "Rose", "website": "https://www.rose.example", "location": {"city": "Anytown", "country_code": "ca", "address": "1 Road", "zip": ""}, "rating": {"value": 4.5, "review_count": 10}, "procedures": [
        service, service | {"price": 220, "source_url": "https://rose.example/"}, {"name": "No price", "source_url": "https://rose.example/"}, {"name": "", "price": 5, "source_url": "x"}, {"name": "No source", "price": 5},
        {"name": "Peel", "price_min": 50, "price_max": 90, "regular_price": 60, "source_url": "https://rose.example/peel"}]}, {"name": "Empty", "procedures": []}]
    (tmp_path / "a.json").write_text(json.dumps({"checked_at": "2024-01-01", "market": "Anytown", "currency_default": "CAD", "clinics": clinics}))
    rows = curated.offers(curated.read(spark, str(tmp_path)))
    assert {r["service_name"]: r["skip_reason"] for r in rows.collect()} == {"Lip care": None, "No price": "no_numeric_price", "": "missing_name", "No source": "missing_source_url", "Peel": None}
    won = {r["service_name"]: r for r in curated.winners(rows.filter("skip_reason is null")).collect()}
    lips, peel = won["Lip care"], won["Peel"]
    assert (lips["amount"], lips["n_rows"], lips["n_prices"], lips["currency"], lips["price_type"], lips["unit_quantity"], lips["unit_token"], lips["country_code"], lips["address"]) == (200.0, 2, 2, "CAD", "per_area", 2.0, "areas", "CA", "1 Road, Anytown")
    assert (peel["amount"], peel["amount_max"], peel["price_type"]) == (60.0, 90.0, "range")


PAGE = """<html><nav><li>Menu $1</li></nav><script type="application/ld+json">{"name":"Glow","offers":[{"price":"120","priceCurrency":"EUR"}]} {"name":"Other","lowPrice":7}</script>
<h2>Peels</h2><p>Light peel: €80</p><ul><li>Deep peel - €150.50</li><li>no price</li></ul>
<table><tr><th>Service</th><th>Before</th><th>Now</th></tr><tr><td>Lips</td><td>€300</td><td>€250</td></tr></table><p><del>€999</del> €10</p><footer><p>Call €5</p></footer></html>"""


def test_page_evidence(spark):
    df = spark.createDataFrame([(1, "https://rose.example/p", PAGE), (2, "https://x.example", None), (3, "https://y.example", "<script>app()</script>"), (4, None, "<p>€5<p>€5")], "page_id long, url string, html string")
    got = {(r["page_id"], r["method"], r["label"], r["amount"], r["currency"]) for r in pages.evidence(df).collect()}
    assert got == {(1, "json_ld", "Glow", 120.0, "EUR"), (1, "json_ld", "Other", 7.0, None), (1, "text", "Light peel", 80.0, "EUR"), (1, "list", "Deep peel", 150.5, "EUR"), (1, "table", "Lips", 250.0, "EUR"), (1, "text", "Peels", 10.0, "EUR")}
    assert [r["x"] for r in df.filter("html is not null").orderBy("page_id").select(pages.looks_like_shell(F.col("html")).alias("x")).collect()][1]


def test_variants(spark):
    df = spark.createDataFrame([(1, "Laser", 100.0, [("small", 40.0), ("free", 0.0)]), (2, "Peel", None, None)], "service_id long, name string, price double, variants array<struct<name:string,price:double>>")
    assert {(r["label"], r["amount"]) for r in pages.expand_variants(df).collect()} == {("Laser", 100.0), ("Laser - small", 40.0)}


EVENTS = [("m", 0, 1, "enqueue", "w1", 1), ("m", 10, 2, "enqueue", "w1", 5), ("m", 20, 3, "claim", "w1", 0), ("m", 30, 4, "claim", "w2", 0), ("m", 40, 5, "progress", "w2", 0), ("m", 50, 6, "progress", "w1", 0),
          ("m", 90_000, 7, "claim", "w2", 0), ("m", 90_010, 8, "finish", "w1", 0), ("m", 90_020, 9, "finish", "w2", 0)]
ACCEPTED = [True, False, True, False, False, True, True, False, True]
JOB = "market_key string, ts_ms long, seq long, action string, owner string, priority long"


def test_requests_merge(spark):
    """Items in order, each once and forty at most; a lower priority changes nothing; `user` sticks; a fresh result answers."""
    from types import SimpleNamespace

    ask = lambda t, priority, items, reason="": SimpleNamespace(ts_ms=t, action="enqueue", owner="w", priority=priority, items=items, reason=reason)
    state, ok = jobs.apply_event(jobs.START, ask(0, 5, "a,b"))
    assert ok and state[7:] == ("a,b", "")
    state, ok = jobs.apply_event(state, ask(1, 5, "b,c", "user"))
    assert not ok and state[7:] == ("a,b,c", "user")
    state, _ = jobs.apply_event(state, ask(2, 9, ",".join(map(str, range(60))), "auto"))
    assert state[4] == 9 and len(state[7].split(",")) == 40 and state[8] == "user"
    assert jobs.apply_event(state, ask(3, 1, "z", "x"))[0][7:] == state[7:]
    for k, action in enumerate(("claim", "finish")):
        state, ok = jobs.apply_event(state, SimpleNamespace(ts_ms=10 + k, action=action, owner="w", priority=0))
        assert ok
    assert not jobs.apply_event(state, ask(1000, 5, "q"))[1] and jobs.apply_event(state, ask(1000, 5, "q", "user"))[1] and jobs.apply_event(state, ask(400_000, 5, "q"))[1]


def test_job_replay(spark):
    rows = jobs.replay(spark.createDataFrame(EVENTS, JOB)).orderBy("ts_ms").collect()
    assert [r["accepted"] for r in rows] == ACCEPTED
    assert (rows[-1]["status"], rows[-1]["attempts"], rows[-1]["priority"], rows[-1]["written"]) == ("done", 2, 5, 1)


def test_job_stream_equals_replay(spark, tmp_path):
    for k, part in enumerate((EVENTS[:4], EVENTS[4:])):
        spark.createDataFrame(part, JOB).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a timeout would keep asking for empty batches
    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = jobs.track(stream).writeStream.format("memory").queryName("job_events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = sorted((r["ts_ms"], r["accepted"]) for r in spark.table("job_events").collect())
    assert [a for _, a in got] == ACCEPTED


def test_upsert_sink_replays_a_batch_alike(spark, tmp_path):
    write = jobs.upsert_batches(str(tmp_path / "t"), ["k"])
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, updated int")
    write(frame([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), 0)
    for _ in range(2):
        write(frame([(2, "d", 3), (3, "e", 3)]), 1)
    table = lambda: {(r["k"], r["v"]) for r in jobs.read_upserted(spark, str(tmp_path / "t")).collect()}
    assert table() == {(1, "b"), (2, "d"), (3, "e")}
    for n in range(2, 6):
        write(frame([(1, f"x{n}", n)]), n)
    assert table() == {(1, "x5"), (2, "d"), (3, "e")}
    versions = [p for p in (tmp_path / "t").glob("v=*/bucket=*")]
    assert len({p.name for p in versions}) <= 3 and len(versions) <= 6  # two versions of a bucket at most, and only touched ones


def test_greedy_dedupe_streams(spark):
    """Against brute force, with rows of equal keys, without keys and with null; no group is collected."""
    import random

    rng = random.Random(4)
    rows = [(g, k, rng.choice([None, []]) if k % 9 == 0 else [f"k{rng.randrange(60)}" for _ in range(rng.randint(1, 3))]) for g in ("a", "b", None) for k in range(120)]
    rng.shuffle(rows)
    expected, seen = set(), {}
    for g, k, keys in sorted(rows, key=lambda r: r[1]):
        own = seen.setdefault(g, set())
        if not own & set(keys or ()):
            own |= set(keys or ())
            expected.add((g, k))
    got = resolve.greedy_dedupe(spark.createDataFrame(rows, "g string, k long, keys array<string>"), ["g"], ["k"], "keys")
    assert got.columns == ["g", "k", "keys"] and sorted(map(str, expected)) == sorted(str((r["g"], r["k"])) for r in got.collect())
    assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize(("stated", "unit", "has_range", "regular", "want"), [("approximate", "per ml", True, None, "approximate"), (None, "per ml", True, None, "per_unit"), (None, "per 2 areas", True, None, "per_area"), (None, None, True, None, "range"), ("From", "package", False, 9.0, "from"), ("introductory", "", False, None, "sale"), (None, "each", False, 9.0, "sale"), (None, None, False, None, "fixed")])
def test_price_type(spark, stated, unit, has_range, regular, want):
    lit = lambda x, kind: F.lit(x).cast(kind)
    got = curated.price_type(lit(stated, "string"), lit(unit, "string"), F.lit(has_range), lit(regular, "double"), F.lit(5.0))
    assert spark.range(1).select(got.alias("x")).first()["x"] == want


def test_first_match_join_is_an_equi_join(spark):
    rules_table = spark.createDataFrame([(k, f"n{k:03d}x", str(k)) for k in range(300)] + [(300, "a", "short"), (301, "", "never")], "priority int, needle string, label string")
    df = spark.createDataFrame([(1, "..n007x.n003x"), (2, "b"), (3, ""), (4, "ba"), (5, None)], "k long, t string")
    got = rules.first_match_join(df, "t", rules_table, "k")
    assert {r["k"]: r["label"] for r in got.collect()} == {1: "3", 2: None, 3: None, 4: "short", 5: None}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_near_places_wraps(spark):
    """Against all pairs: over the 180th meridian, at the poles, and at all latitudes."""
    import math
    import random

    rng = random.Random(5)
    spots = [(k, rng.choice([89.9, -89.95, 60, 0]) + rng.uniform(-0.05, 0.05) * (k % 2), rng.choice([179.9, -179.9, 0, 10]) + rng.uniform(-0.3, 0.3)) for k in range(160)]
    left, right = (spark.createDataFrame(spots, f"{s} int, lat_{s} double, lon_{s} double") for s in "lr")

    def km(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    got = sorted((r["l"], r["r"]) for r in resolve.near_places(left, right, 25.0).collect())
    assert got == sorted((p[0], q[0]) for p in spots for q in spots if km(p, q) <= 25.0)


@pytest.mark.parametrize(("label", "want"), [("Éclair—Über ﬁn", "eclair—uber fin"), ("жё", "же"), (None, None)])
def test_fold_marks(spark, label, want):
    assert spark.createDataFrame([(label,)], "t string").select(text.fold_marks("t").alias("x")).first()["x"] == want


@pytest.mark.parametrize(("label", "spaced", "place"), [("São-Paulo  City", "sao paulo city", "sao paulo city"), ("L'Hospitalet_x", "l'hospitalet x", "lhospitalet x"), ("Iğdır", "iğdır", "igdir")])
def test_other_folds(spark, label, spaced, place):
    row = spark.createDataFrame([(label,)], "t string").select(text.fold_spaced(F.col("t")).alias("a"), text.fold_place(F.col("t")).alias("b")).first()
    assert row["a"] == spaced and row["b"] == place


def test_tolerance_binding(spark):
    labels = spark.createDataFrame([("a", 10.0, 20.0), ("a", 10.5, 20.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0)], "k string, low double, high double")
    records = spark.createDataFrame([("a", 10.011, 19.99, "d1"), ("a", 10.02, 20.0, "d2"), ("b", 1.0, 1.0, "d1"), ("b", 0.995, 1.01, "d2"), ("c", 10.0, 20.0, "d3")], "k string, low double, high double, day string")
    got = [(r["k"], r["low"], r["bound"], r["ambiguous"]) for r in resolve.tolerance_binding(labels, records, ["k"], "low", "high", "day").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a", 10.0, "d1", False), ("a", 10.5, None, False), ("b", 1.0, None, True), ("b", 1.0, None, True)]))
