"""The price call, occurrences of numbers, witnesses and key joins: plans, loops in Python, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from offerlens.functions import evidence, occurrences, sanity
from offerlens.functions.cues import CUES, pattern
from offerlens.operators import prices
from offerlens.plans import prices as plans
from offerlens.plans import registry
from tests.conftest import SMALL


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_scanned_and_parsed_once(spark):
    for name in ("q133_procedure_prices", "q134_price_funnel"):
        plan = physical(registry.queries()[name](spark, SMALL))
        assert len(re.findall(r"MapInArrow", plan)) == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
        assert len(re.findall(r"FileScan parquet \[[^]]*html", plan)) == 1


def test_funnel_falls_and_ends_with_the_fresh_rows(spark):
    requests, pool, stages = plans.staged(lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet"), spark)
    counts = {}
    for r in prices.funnel(stages).collect():
        counts.setdefault((r["city"], r["family"]), {})[r["stage"]] = r["providers"]
    for by in counts.values():
        row = [by[s] for s in prices.STAGES]
        assert row == sorted(row, reverse=True)
    fresh = prices.procedure_prices(requests, pool, stages, cap=10**6).filter("source = 'fresh'").groupBy("city", "family").count().collect()
    assert {(r["city"], r["family"]): r["count"] for r in fresh} == {k: by["accepted"] for k, by in counts.items() if by["accepted"]}


def test_price_call_of_nothing(spark):
    requests = spark.createDataFrame([], "city string, family string")
    candidates = spark.createDataFrame([("a.example", "en", None)], "host string, city string, blocked boolean")
    pool = spark.createDataFrame([], "host string, city string, family string, amount double, currency string, label string")
    pages = spark.createDataFrame([(1, "https://a.example/", None), (2, "https://a.example/", ""), (3, None, "<p>Ring €5</p>"), (4, "https://a.example/x", "<p>Ring €5</p>")], "page_id long, url string, html string")
    judged = prices.judged_evidence(pages, [("ring", r"\bring\b")], r"\d ml", "hot", "old")
    got = {(r["page_id"], r["method"], r["relation"], r["read"]) for r in judged.collect()}
    assert got == {(2, "page", None, False), (3, "page", None, True), (3, "text", "exact", False), (4, "page", None, True), (4, "text", "exact", False)}
    for wanted, stage in ((requests, None), (spark.createDataFrame([("en", "ring")], requests.schema), 7), (spark.createDataFrame([("en", "bolt")], requests.schema), 4), (spark.createDataFrame([("fr", "ring")], requests.schema), None)):
        rows = prices.provider_stages(wanted, candidates, pool, judged, F.lit(None).cast("string")).collect()
        assert [r["stage"] for r in rows] == ([stage] if stage else [])
    assert prices.procedure_prices(requests, pool, prices.provider_stages(requests, candidates, pool, judged, F.lit("en"))).count() == 0


NUMBERS = [
    ("flights for 2 people €900", 900.0, "travel_cost_not_procedure"), ("flights for two people €900", 900.0, "travel_cost_not_procedure"), ("hotel and taxi | peel €900", 900.0, None), ("hotel €80, peel €900", 900.0, None),
    ("peel 1.299,50 € or €1,299.50 with flights €1,299.50", 1299.5, "travel_cost_not_procedure"), ("hotel, 3 nights, 2 adults: 1 299,50 €", 1299.5, "travel_cost_not_procedure"), ("hotel " + "so " * 10 + "€900", 900.0, None),
    ("how much is 2 ml in 2024?", 2024.0, "calendar_year_not_price"), ("how much in 2024 for peels?", 2024.0, None), ("add to cart: serum 30 ml €900", 900.0, "product_not_procedure"), ("hotel €900.50", 900.0, None), (None, 900.0, None), ("", 900.0, None),
]


@pytest.mark.parametrize(("text", "amount", "reason"), NUMBERS)
def test_scope_reads_every_place_of_the_amount(spark, text, amount, reason):
    column, a = F.lit(text).cast("string"), F.lit(amount)
    found = occurrences.of_amount(occurrences.occurrences(column), a)
    assert value(spark, sanity.scope_reason(found, sanity.low(column), F.lit("peel"), a)) == reason


def loop_occurrences(text):
    """The same by a loop over matches."""
    t = re.sub(r"[\n|]", " | ", text.lower()).translate(str.maketrans("\t\r ", "   "))
    out = []
    for k, m in enumerate(matches := list(re.finditer(occurrences.NUMBER, t))):
        first = matches[max(k - occurrences.BEFORE, 0) - 1].end() if k > occurrences.BEFORE else 0
        before = t[first : m.start()].split(" ")
        out.append((k, m[0], " ".join([w for w in before if w][-occurrences.BEFORE :])))
    return out


@pytest.mark.parametrize("text", ["a 1 b 22,50 c|1.000 x\n€5", "no", "", "7", "7 8 9", "x" * 50 + " 12 " + "y z " * 40 + "13", "1 2 3 4 5 " * 12, "1 299,50 € 1 299 2999 1.2.3"])
def test_occurrences_equal_a_loop(spark, text):
    got = value(spark, occurrences.occurrences(F.lit(text)))
    assert [(r["ord"], r["raw"], r["before"]) for r in got] == loop_occurrences(text)


def test_cue_patterns():
    for phrases in CUES.values():
        for p in phrases:
            said = p.replace("*", "xyz").replace("#", "12")
            assert re.search(pattern([p]).replace(r"[\p{L}]", "[a-zà-ÿ]").replace(r"\p{L}", "a-zà-ÿ"), f"({said})"), p
    assert not re.search(pattern(["pay"]).replace(r"\p{L}", "a-zà-ÿ"), "payment") and not re.search(pattern(["set of #"]).replace(r"\p{L}", "a-zà-ÿ"), "set of 1")


@pytest.mark.parametrize(("block", "label", "amount", "held"), [("Peel light €90", "Light peel", 90.0, True), ("Massage €90", "Light peel", 90.0, False), ("Peel €95", "Light peel", 90.0, False), ("ab €90", "ab", 90.0, True), ("€90", "ab", 90.0, True), ("€90", "", 90.0, False), (None, "peel", 90.0, False), ("peel", None, 90.0, False)])
def test_shares_block(spark, block, label, amount, held):
    assert bool(value(spark, evidence.shares_block(F.lit(block).cast("string"), F.lit(label).cast("string"), F.lit(amount)))) is held


def test_claims_in_other_blocks_are_refused(spark):
    pages = spark.createDataFrame([(1, ["Light peel", "Massage €90", "Peel €1,250.50 or 1.250,50 €"]), (2, []), (3, None)], "page long, blocks array<string>")
    amounts, words = prices.block_index(pages, "page", F.col("blocks"))
    claims = spark.createDataFrame([("a", 1, "Light peel", 90.0), ("b", 1, "Massage", 90.0), ("c", 1, "Peel", 1250.5), ("d", 2, "Peel", 90.0), ("e", 1, None, 90.0), ("f", None, "Peel", 90.0), ("g", 1, "Peel", None)], "claim string, page long, label string, amount double")
    assert {r["claim"]: r["locked"] for r in prices.lock_claims(claims, amounts, words, "page", "claim").collect()} == dict(a=False, b=True, c=True, d=False, e=False, f=False, g=False)
    plan = physical(prices.lock_claims(claims, amounts, words, "page", "claim"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_names_equal_a_nested_loop(spark):
    """Over suppliers and customers, with nulls, repeated and short names; no nested loop in the plan."""
    s, c = plans.packed_names(lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet".replace("0.001", "0.01")))
    s = s.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "clinic000037"), (-4, "abcdefgh"), (-5, "rose4")], s.schema))
    c = c.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "xxabcdefghxx"), (-4, "bcdefg"), (-5, "abcdefg")], c.schema))
    got = prices.contained_names(s, "s_suppkey", "s_name", c, "c_custkey", "c_name")
    plan = physical(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    left, right = s.collect(), c.collect()
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] and y[1] and (x[1] == y[1] or (len(x[1]) >= 8 and x[1] in y[1]) or (len(y[1]) >= 8 and y[1] in x[1])))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_ranked_match_uses_every_step(spark):
    rows = registry.queries()["q140_ranked_match"](spark, SMALL.replace("0.001", "0.01")).groupBy("step").count().collect()
    assert {r["step"] for r in rows} >= {"country_city", "region", "distance", "text"} and all(r["count"] > 0 for r in rows)


def test_witness_of_a_page(spark):
    rows = spark.createDataFrame([(1, ["ring"]), (1, []), (1, ["bolt", "ring"]), (2, []), (None, ["ring"]), (2, None)], "page long, names array<string>")
    got = sorted(((r["page"], r["names"], r["witnesses"]) for r in prices.witnessed(rows, "page", "names").collect()), key=repr)
    assert [x[2] for x in got if x[0] == 1] == [["bolt", "ring"]] * 3 and [x[2] for x in got if x[0] == 2] == [[], []]
    has = [F.array(*map(F.lit, x)).cast("array<string>") for x in ([], ["ring"], ["bolt"], ["ring", "bolt"])]
    no, yes = F.lit(False), F.lit(True)
    names = [value(spark, evidence.relation(h, F.lit("ring"), no, no, part, witness)) for h in has for part, witness in ((no, no), (yes, no), (yes, yes))]
    assert names == ["ambiguous", "ambiguous", "variant", "exact", "variant", "variant", "different", "different", "different", "bundle", "bundle", "bundle"]


def test_venue_matches_equal_a_nested_loop(spark):
    """Phones, spots across cell borders, addresses and names, by brute force over all pairs; no pairs of a city in the plan."""
    import random

    from offerlens.functions import identity

    rnd = random.Random(4)
    make = lambda n: [(k, rnd.choice(["x", "y", None]), rnd.choice(["Rose Clinic", "The Rose", "Lily", "", None]), rnd.choice(["+1 555 123 45 67", "1234", "+44 20 7946 0958", None]), rnd.choice([None, 40 + rnd.random() * 0.02]), 20 + rnd.random() * 0.02, rnd.choice(["Main Street 5", "Street Main", "High Road", None])) for k in range(n)]
    schema = "{0} long, city string, name string, phone string, lat double, lon double, address string"
    v, p = spark.createDataFrame(make(60), schema.format("v")), spark.createDataFrame(make(90), schema.format("p"))
    got = prices.venue_matches(v, p, "v", "p", identity.GENERIC)
    assert "NestedLoop" not in physical(got) and "Cartesian" not in physical(got)
    c = F.col
    both = v.crossJoin(p.select("p", *(F.col(x).alias(f"q_{x}") for x in ("city", "name", "phone", "lat", "lon", "address"))))
    same = (c("city") == c("q_city")) & (prices_packed(c("name")) == prices_packed(c("q_name"))) & (prices_packed(c("name")) != "")
    near = identity.same_place(c("lat"), c("lon"), c("q_lat"), c("q_lon"))
    words = lambda x: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    address = F.size(F.array_intersect(words(c("address")), words(c("q_address")))) >= 2
    rank = F.when(evidence.phone_key(c("phone")) == evidence.phone_key(c("q_phone")), 0).when(near, 1).when(address, 2).otherwise(3)
    want = {r["v"]: r["m"] for r in both.filter(same).groupBy("v").agg(F.min(F.struct(rank.alias("r"), "p")).alias("m")).collect()}
    rows = got.collect()
    assert len(rows) == 60
    for r in rows:
        m = want.get(r["v"])
        assert (r["matched"], r["strength"]) == ((m["p"], "weak_name_only" if m["r"] == 3 else "strong") if m else (None, "name_mismatch"))
    assert {m["r"] for m in want.values()} == {0, 1, 2, 3}


def prices_packed(c):
    from offerlens.functions import identity, text

    return text.packed_name(F.coalesce(c, F.lit("")), list(identity.GENERIC))


def test_rotation_shows_all_alike(spark):
    """Runs that read the exposures of the run before show every row about as often; a sibling's rows wait."""
    from offerlens.operators import rank

    rows = spark.createDataFrame([("m", k, 0, False) for k in range(10)] + [("n", k, 0, k < 2) for k in range(3)], "market string, k long, exposure long, sibling boolean")
    shown = []
    for run in range(5):
        rows = spark.createDataFrame(rank.rotated(rows, ["market"], "k", run, 2).collect(), "market string, k long, exposure long, sibling boolean, shown boolean")
        shown.append({r["k"] for r in rows.filter("market = 'n' and shown").collect()})
        rows = rows.drop("shown")
    assert {r["exposure"] for r in rows.filter("market = 'm'").collect()} == {1}
    assert 2 in shown[0] and len(shown[0]) == 2
