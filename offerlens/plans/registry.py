"""Named queries of the operators over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.functions import rules, text
from offerlens.operators import rank, resolve
from offerlens.plans import extraction, prices, providers, serving, trust  # noqa: F401  they register their queries
from offerlens.plans.catalog import documentation, oracle_sql, queries, query  # noqa: F401
from offerlens.streaming import jobs

NOW = "timestamp_ntz'2024-06-01 00:00:00'"


@query("""
WITH s AS (SELECT n_name, s_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_discount < 0.05 THEN 4 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 3 ELSE 0 END + 1 / (1 + l_extendedprice) AS sc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY sc DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY sc DESC, s_suppkey) AS rn FROM r WHERE k = 1)
SELECT n_name, s_suppkey, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, round(sc, 6) AS score, rn FROM t WHERE rn <= 4""")
def q01_representative_topk(t, spark):
    """Best line a supplier, then the top four suppliers a nation. Lines are aggregated before the joins."""
    score = F.when(F.col("l_discount") < 0.05, 4).otherwise(0) + F.when(F.col("l_returnflag") == "N", 3).otherwise(0) + 1 / (1 + F.col("l_extendedprice"))
    lines = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", score.alias("score"))
    best = rank.representative(lines, ["l_suppkey"], F.col("score"), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")])
    named = best.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    top = rank.top_k(named, ["n_name"], [F.desc("score"), F.asc("s_suppkey")], 4)
    return top.select("n_name", "s_suppkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.round("score", 6).alias("score"), "rn")


@query("""
WITH b(p_brand, lo, hi) AS (VALUES ('Brand#11', 900.0, 1500.0), ('Brand#12', 1000.0, 1400.0), ('Brand#23', 950.0, 1250.0))
SELECT p_partkey, coalesce(p_retailprice BETWEEN lo AND hi, true) AS plausible FROM part LEFT JOIN b USING (p_brand)""")
def q02_plausibility_band(t, spark):
    """Amounts against a band dimension; without a band an amount is plausible."""
    bands = spark.createDataFrame([("Brand#11", 900.0, 1500.0), ("Brand#12", 1000.0, 1400.0), ("Brand#23", 950.0, 1250.0)], "p_brand string, lo double, hi double")
    return rules.band_join(t("part"), bands, "p_brand", "p_retailprice").select("p_partkey", "plausible")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 0 THEN 'missing_amount' WHEN l_extendedprice > 90000 THEN 'implausible_amount'
  WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount >= 0.09 THEN 'promotional' WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 'stale' ELSE 'accepted' END AS reason FROM lineitem)
GROUP BY reason""")
def q03_reject_reasons(t, spark):
    """ordered predicates, the first that holds is the reason; rows by reason. Not C1, whose cascade has some 50 reasons."""
    checks = [("missing_amount", F.col("l_quantity") <= 0), ("implausible_amount", F.col("l_extendedprice") > 90000), ("returned", F.col("l_returnflag") == "R"), ("promotional", F.col("l_discount") >= 0.09), ("stale", F.col("l_shipdate") < F.expr("timestamp_ntz'1994-01-01 00:00:00'"))]
    reason = F.coalesce(rules.first_reason(checks), F.lit("accepted"))
    return t("lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderpriority, count(*) AS found, count(*) FILTER (o_orderstatus <> 'P') AS fetched, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 50000) AS priced,
  count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) AS accepted FROM orders GROUP BY o_orderpriority""")
def q04_funnel(t, spark):
    """all steps of a funnel in one pass."""
    fetched, priced = F.col("o_orderstatus") != "P", F.col("o_totalprice") > 50000
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("found"), F.count_if(fetched).alias("fetched"), F.count_if(fetched & priced).alias("priced"), F.count_if((F.col("o_orderstatus") == "F") & priced).alias("accepted"))


@query("""
WITH a AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS price, p_retailprice * 1.1 AS regular, p_retailprice * 0.9 AS low, p_retailprice * (1 + p_size / 100.0) AS high FROM part),
b AS (SELECT *, coalesce(CASE WHEN price > 0 THEN price END, CASE WHEN regular > 0 THEN regular END, low) AS amount FROM a)
SELECT p_partkey, round(amount, 4) AS amount, round(CASE WHEN high > amount THEN high END, 4) AS amount_max,
  CASE WHEN p_size % 7 = 0 THEN 'per_area' WHEN p_size % 7 = 1 THEN 'per_unit' WHEN high > amount THEN 'range' WHEN regular > amount THEN 'sale' ELSE 'fixed' END AS price_type FROM b""")
def q05_price_resolution(t, spark):
    """B1: the first positive of several prices, a maximum only above it, and the type by precedence."""
    from offerlens.sources.curated import price_type, resolve_price

    p = F.col("p_retailprice")
    a = t("part").select("p_partkey", "p_size", F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(p).alias("price"), (p * 1.1).alias("regular"), (p * 0.9).alias("low"), (p * (1 + F.col("p_size") / 100.0)).alias("high"))
    got = resolve_price(F.col("price"), F.col("low"), F.col("high"), F.col("regular"), F.lit(None).cast("double"))
    unit = F.when(F.col("p_size") % 7 == 0, "per 2 areas").when(F.col("p_size") % 7 == 1, "per ml")
    kind = price_type(F.lit(None).cast("string"), unit, got["amount_max"].isNotNull(), F.col("regular"), got["amount"])
    return a.select("p_partkey", F.round(got["amount"], 4).alias("amount"), F.round(got["amount_max"], 4).alias("amount_max"), kind.alias("price_type"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_discount, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, n AS n_rows FROM r WHERE k = 1""")
def q06_conflict_winner(t, spark):
    """Of rows with one identity the deepest, then narrowest, then first wins; with how many there were."""
    lines = t("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    won = resolve.conflict_winner(lines, ["l_suppkey", "l_partkey"], [-F.col("l_quantity"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")])
    return won.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "n_rows")


@query("""
WITH u AS (SELECT l_partkey, l_shipdate, l_orderkey, l_extendedprice, 0 AS side FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_partkey, l_shipdate, l_orderkey, l_extendedprice, 1 FROM lineitem WHERE l_linenumber % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, side DESC, l_extendedprice DESC) AS k FROM u)
SELECT l_partkey, l_orderkey, round(l_extendedprice, 2) AS price FROM r WHERE k = 1""")
def q07_keyed_merge(t, spark):
    """Two batches merged by key, the newest record wins, the second batch on equal terms. Both lie in one table: one scan."""
    lines = t("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", (F.col("l_linenumber") % 2).alias("side"), F.col("l_extendedprice").alias("price"))
    return resolve.keyed_winner(lines, ["l_partkey"], ["l_shipdate", "l_orderkey", "side", "price"]).select("l_partkey", "l_orderkey", F.round("price", 2).alias("price"))


@query("""
WITH o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer
  UNION ALL SELECT -s_suppkey - 1, s_name, 'SUPPLIER' FROM supplier)
SELECT c_custkey, coalesce(p.c_name, o.c_name) AS c_name, coalesce(p.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN p USING (c_custkey)""")
def q08_upsert_coalesce(t, spark):
    """A patch that changes only what it gives; suppliers come as new keys."""
    c, missing = t("customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey") % 3 == 0
    old = c.withColumn("c_mktsegment", F.when(~missing, F.col("c_mktsegment")))
    patch = c.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name"))).withColumn("c_mktsegment", F.when(missing, F.col("c_mktsegment")))
    patch = patch.unionByName(t("supplier").select((-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("SUPPLIER").alias("c_mktsegment")))
    return resolve.coalesce_upsert(old, patch, ["c_custkey"])


@query("""
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 150000)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)""")
def q09_anti_known(t, spark):
    """What is neither known (an open order of over 150,000) nor blocked (an order in the last 30 days)."""
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))
    known, blocked = o.filter((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 150000)), o.join(F.broadcast(last), F.col("o_orderdate") > F.col("last") - F.expr("INTERVAL 30 DAYS"))  # one row
    return t("customer").join(known, "c_custkey", "left_anti").join(blocked, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def q10_semi_priced(t, spark):
    """Rows whose key is among those already priced."""
    priced = t("orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(priced, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal, 2) END, q) AS rating, coalesce(n, 0) AS reviews
FROM supplier LEFT JOIN (SELECT l_suppkey, round(avg(l_quantity), 4) AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey""")
def q11_overlay(t, spark):
    """A left join that fills what is missing."""
    base = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.round("s_acctbal", 2)).alias("rating"), F.lit(None).cast("long").alias("reviews"))
    extra = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_quantity"), 4).alias("rating"), F.count("*").alias("reviews"))
    return resolve.overlay(base, extra, ["s_suppkey"], ["rating", "reviews"]).withColumn("reviews", F.coalesce("reviews", F.lit(0)))


@query("""
WITH a AS (SELECT n_name, count(*) AS relevant, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS no_price, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS unverified
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT *, CASE WHEN relevant < 15 THEN 'thin' WHEN relevant < 30 THEN 'partial' WHEN relevant < 60 THEN 'healthy' ELSE 'broad' END AS level,
  CASE WHEN verified < 4 THEN 'high' WHEN verified < 10 THEN 'active' WHEN verified < 20 THEN 'normal' ELSE 'maintenance' END AS priority FROM a""")
def q12_coverage_tally(t, spark):
    """Exclusive states counted in one pass, then levels. Orders are counted by customer before the joins."""
    s = F.col("o_orderstatus")
    by_customer = t("orders").groupBy("o_custkey").agg(F.count("*").alias("relevant"), F.count_if(s == "F").alias("verified"), F.count_if(s == "P").alias("no_price"))
    named = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = named.groupBy("n_name").agg(*(F.sum(c).alias(c) for c in ("relevant", "verified", "no_price"))).withColumn("unverified", F.col("relevant") - F.col("verified") - F.col("no_price"))
    level = rules.first_reason([("thin", F.col("relevant") < 15), ("partial", F.col("relevant") < 30), ("healthy", F.col("relevant") < 60)])
    priority = rules.first_reason([("high", F.col("verified") < 4), ("active", F.col("verified") < 10), ("normal", F.col("verified") < 20)])
    return n.withColumn("level", F.coalesce(level, F.lit("broad"))).withColumn("priority", F.coalesce(priority, F.lit("maintenance")))


@query("""
WITH c AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, brand) AS k FROM c)
SELECT CASE WHEN k <= 4 THEN brand ELSE 'Other' END AS brand, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def q13_top4_other(t, spark):
    """the four largest groups and the rest as one."""
    return rank.top_with_rest(t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")), "brand", "n", 4)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q14_group_by_day(t, spark):
    """a journal by day."""
    return t("events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey""")
def q15_entity_group_latest(t, spark):
    """An entity's rows with its latest one."""
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("""
SELECT p_brand, CASE WHEN count(*) >= 2 AND count(DISTINCT p_size % 2) = 1 THEN round(min(p_retailprice), 2) END AS low, CASE WHEN count(*) >= 2 AND count(DISTINCT p_size % 2) = 1 THEN round(max(p_retailprice), 2) END AS high
FROM part GROUP BY p_brand""")
def q16_currency_range_summary(t, spark):
    """A range only over two rows or more of a single currency; one currency is tested as min = max, without a distinct."""
    c = F.col("p_size") % 2
    one = (F.count("*") >= 2) & (F.min(c) == F.max(c))
    return t("part").groupBy("p_brand").agg(F.when(one, F.round(F.min("p_retailprice"), 2)).alias("low"), F.when(one, F.round(F.max("p_retailprice"), 2)).alias("high"))


@query("""
WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM m),
a AS (SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS cheapest, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best, max(c_acctbal) AS top FROM customer GROUP BY 1),
t AS (SELECT c.c_nationkey, count(*) AS ties FROM customer c JOIN a USING (c_nationkey) WHERE c_acctbal >= top - 100 GROUP BY 1)
SELECT a.c_nationkey, cheapest, best, r.c_mktsegment AS modal_segment, ties FROM a JOIN r ON r.c_nationkey = a.c_nationkey AND k = 1 JOIN t ON t.c_nationkey = a.c_nationkey""")
def q17_kpis(t, spark):
    """best by either end, the modal value and ties near the top, each with a stated tie rule."""
    c = t("customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment")
    a = c.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("cheapest"), F.max_by("c_custkey", F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("best"), F.max("c_acctbal").alias("top"))
    mode = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("modal_segment"))
    ties = c.join(a.select("c_nationkey", "top"), "c_nationkey").filter("c_acctbal >= top - 100").groupBy("c_nationkey").agg(F.count("*").alias("ties"))
    return a.join(mode, "c_nationkey").join(ties, "c_nationkey").drop("top")


@query("""
WITH f(n, rate) AS (VALUES (0, 1.0), (1, 0.92), (2, 31.5), (3, 1.36)) SELECT c_custkey, round(c_acctbal / coalesce(rate, 1.0), 4) AS usd FROM customer LEFT JOIN f ON n = c_nationkey % 5
WHERE c_acctbal / coalesce(rate, 1.0) BETWEEN 100 AND 5000""")
def q18_fx_filter(t, spark):
    """Amounts through units per dollar, an unknown currency as 1; then a range filter."""
    rate = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in (0, 1.0, 1, 0.92, 2, 31.5, 3, 1.36))), F.col("c_nationkey") % 5), F.lit(1.0))
    usd = F.col("c_acctbal") / rate
    return t("customer").filter(usd.between(100, 5000)).select("c_custkey", F.round(usd, 4).alias("usd"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_brand), 'brand#3')")
def q19_substring_search(t, spark):
    """Case-insensitive search over several fields."""
    return t("part").filter(F.lower("p_name").contains("green") | F.lower("p_brand").contains("brand#3")).select("p_partkey", "p_name")


@query("""
WITH u AS (SELECT c_name AS name, 0 AS source, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, 1, c_custkey FROM customer UNION ALL SELECT s_name, 2, s_suppkey FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, k) AS n FROM u) SELECT name, k, CAST(source AS BIGINT) AS source FROM r WHERE n = 1""")
def q20_ordered_union_distinct(t, spark):
    """Union in order, an id's first source stays."""
    c = t("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    return resolve.ordered_union_distinct([c.filter("k % 2 = 0"), c, t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))], "name").select("name", "k", "source")


@query("""
WITH p AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS priority FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, ts, event_id) AS rn FROM p)
SELECT user_id, event_id, CAST(priority AS BIGINT) AS priority, rn FROM r WHERE rn <= 2""")
def q21_queue_priority(t, spark):
    """H4, H5, H6: a queue's next rows by priority, then age; each user's first two."""
    p = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("priority"))
    return rank.top_k(p, ["user_id"], [F.desc("priority"), F.asc("ts"), F.asc("event_id")], 2).select("user_id", "event_id", "priority", "rn")


@query("""
SELECT event_id, (event_type = 'error' OR ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-15 00:00:00' OR value > 100) AS blocked FROM events""")
def q22_retry_blocked(t, spark):
    """A permanent reason, a retry time to come or a lease still held."""
    now = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    permanent = F.when(F.col("event_type") == "error", F.col("event_type"))
    lease = F.when(F.col("value") > 100, now + F.expr("interval 1 hour"))
    return t("events").select("event_id", jobs.retry_blocked(now, permanent, F.col("ts") + F.expr("interval 2 hours"), lease).alias("blocked"))


@query("""
SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-08-02 00:00:00' - o_orderdate <= INTERVAL 14 DAY THEN 'fresh' WHEN TIMESTAMP '1998-08-02 00:00:00' - o_orderdate <= INTERVAL 90 DAY THEN 'stale_usable' ELSE 'expired' END AS state FROM orders""")
def q23_ttl(t, spark):
    """Freshness by age against a stated now."""
    age = F.expr("timestamp_ntz'1998-08-02 00:00:00'") - F.col("o_orderdate")
    state = rules.first_reason([("fresh", age <= F.expr("interval 14 days")), ("stale_usable", age <= F.expr("interval 90 days"))])
    return t("orders").select("o_orderkey", F.coalesce(state, F.lit("expired")).alias("state"))


@query("""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'view' AND value > 10) SELECT user_id, event_id, rn FROM r WHERE rn <= 3""")
def q24_due_notifications(t, spark):
    """What is due and not sent, the oldest three a user."""
    due = t("events").filter("event_type != 'view' AND value > 10").select("user_id", "event_id", "ts")
    return rank.top_k(due, ["user_id"], [F.asc("ts"), F.asc("event_id")], 3).select("user_id", "event_id", "rn")


@query("""
WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS v, epoch_ms(max(ts)) AS t FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN t + CAST(floor(v) AS BIGINT) * 60000 > 1705276800000 THEN 'lease_held' WHEN last_type = 'error' AND t + 86400000 > 1705276800000 THEN 'retry_backoff' WHEN last_type = 'purchase' AND t + 864000000 > 1705276800000 THEN 'ttl_fresh' ELSE 'start' END AS decision FROM e""")
def q25_lease_decision(t, spark):
    """L8, L9, B.6: what the next request does, from a key's last event."""
    at = F.struct("ts", "event_id")
    e = t("events").groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max_by("value", at).alias("v"), F.unix_millis(F.max("ts").cast("timestamp")).alias("t"))
    status = F.when(F.col("last_type") == "error", "failed").when(F.col("last_type") == "purchase", "done")
    decided = jobs.lease_decision(F.lit(1705276800000), F.col("t") + F.floor("v").cast("long") * 60000, status, F.col("t") + 86400000, F.col("t") + 864000000)
    return e.select("user_id", decided.alias("decision"))


@query("""
WITH RECURSIVE e AS (
  SELECT 'm' || user_id AS m, epoch_us(ts) // 1000 AS t, ['enqueue', 'claim', 'progress', 'finish', 'release', 'claim'][event_id % 6 + 1] AS a, 'w' || event_id % 3 AS o, CAST(floor(value) AS BIGINT) AS p,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
w AS (
  SELECT DISTINCT m, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS a, CAST('' AS VARCHAR) AS d, CAST('none' AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS ow, CAST(0 AS BIGINT) AS le, CAST(0 AS BIGINT) AS tries, CAST(0 AS BIGINT) AS pr, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS wr FROM e
  UNION ALL
  SELECT e.m, e.i, e.t, e.a, x.d, CASE x.d WHEN 'new' THEN 'queued' WHEN 'take' THEN 'running' WHEN 'expire' THEN 'failed' WHEN 'release' THEN 'queued' WHEN 'finish' THEN 'done' ELSE st END,
    CASE WHEN x.d = 'take' THEN e.o WHEN x.d IN ('new', 'expire', 'release', 'finish') THEN NULL ELSE ow END, CASE WHEN x.d IN ('take', 'progress') THEN e.t + 60000 WHEN x.d IN ('new', 'expire', 'release', 'finish') THEN 0 ELSE le END,
    CASE x.d WHEN 'new' THEN 0 WHEN 'take' THEN tries + 1 ELSE tries END, CASE x.d WHEN 'new' THEN e.p WHEN 'merge' THEN greatest(pr, e.p) ELSE pr END, CASE WHEN x.d IN ('no', 'reuse') THEN up ELSE e.t END, wr + CASE x.d WHEN 'progress' THEN 1 ELSE 0 END
  FROM w JOIN e ON e.m = w.m AND e.i = w.i + 1, LATERAL (SELECT CASE e.a
    WHEN 'enqueue' THEN CASE WHEN st IN ('queued', 'running') THEN 'merge' WHEN st = 'done' AND e.t - up < 300000 THEN 'reuse' ELSE 'new' END
    WHEN 'claim' THEN CASE WHEN st = 'queued' OR (st = 'running' AND le <= e.t AND tries < 3) THEN 'take' WHEN st = 'running' AND le <= e.t THEN 'expire' ELSE 'no' END
    ELSE CASE WHEN st = 'running' AND le > e.t AND ow = e.o THEN e.a ELSE 'no' END END AS d) x)
SELECT m AS market_key, t AS ts_ms, a AS action, d IN ('new', 'take', 'progress', 'release', 'finish') AS accepted, st AS status, ow AS owner, le AS lease_until, tries AS attempts, pr AS priority, up AS updated, wr AS written, '' AS items, '' AS reason FROM w WHERE i > 0""")
def q26_job_replay(t, spark):
    """L1, L2, L3: jobs with leases replayed in order by market, a fold streamed over sorted partitions."""
    kinds = ["enqueue", "claim", "progress", "finish", "release", "claim"]
    action = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("event_id", F.lit(len(kinds))) + 1).cast("int"))
    return jobs.replay(t("events").select(F.concat(F.lit("m"), F.col("user_id")).alias("market_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("w"), F.pmod("event_id", F.lit(3))).alias("owner"), F.floor("value").cast("long").alias("priority")))


@query(r"""
WITH w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(replace(translate(lower(replace(text, 'İ', 'i')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), ' ') AS k FROM documents)
SELECT doc_id, len(k) AS n_tokens, k[1] AS first_token, k[len(k)] AS last_token FROM w""")
def q27_fold_tokens(t, spark):
    """Folded keys."""
    words = F.split(text.name_key(F.col("text")), " ")
    return t("documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.get(words, F.lit(0)).alias("first_token"), F.element_at(words, -1).alias("last_token"))


@query(r"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, host, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, CASE WHEN contains(path, '/en/') THEN 3 ELSE 0 END + CASE WHEN ends_with(path, '.html') THEN 2 ELSE 0 END - CASE WHEN contains(url, 'utm_') THEN 1 ELSE 0 END AS score, url FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, length(url), page_id) AS rn FROM s) SELECT page_id, host, depth, CAST(score AS BIGINT) AS score, rn FROM r WHERE rn <= 3""")
def q28_host_url(t, spark):
    """Host and depth, a score, the three best urls a host."""
    url = F.col("url")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    score = F.when(path.contains("/en/"), 3).otherwise(0) + F.when(path.endswith(".html"), 2).otherwise(0) - F.when(url.contains("utm_"), 1).otherwise(0)
    s = t("pages").select("page_id", url, text.host(url).alias("host"), text.path_depth(url).alias("depth"), score.cast("long").alias("score"))
    return rank.top_k(s, ["host"], [F.desc("score"), F.length("url").asc(), F.asc("page_id")], 3).select("page_id", "host", "depth", "score", "rn")


LABELS = [("green", "colour_green"), ("red", "colour_red"), ("almond", "nut"), ("blue", "colour_blue"), ("steel", "metal")]


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'green') THEN 'colour_green' WHEN contains(lower(p_name), 'red') THEN 'colour_red' WHEN contains(lower(p_name), 'almond') THEN 'nut' WHEN contains(lower(p_name), 'blue') THEN 'colour_blue' WHEN contains(lower(p_name), 'steel') THEN 'metal' END AS label FROM part")
def q29_first_match_label(t, spark):
    """The first vocabulary entry that fits."""
    return t("part").select("p_partkey", rules.first_match(F.lower("p_name"), LABELS).alias("label"))


@query(r"""
WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN '1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',50 €' WHEN 1 THEN '$' || CAST(p_size AS VARCHAR) || '.25' WHEN 2 THEN CAST(p_size AS VARCHAR) || ' GBP' ELSE 'ask us' END AS label FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1000 + p_size % 1000 + 0.5 WHEN 1 THEN p_size + 0.25 WHEN 2 THEN CAST(p_size AS DOUBLE) END::DOUBLE AS amount, CASE p_partkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency FROM x""")
def q30_number_currency_parse(t, spark):
    """Amounts and currencies from price labels."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    label = F.when(k == 0, F.concat(F.lit("1."), F.lpad(size, 3, "0"), F.lit(",50 €"))).when(k == 1, F.concat(F.lit("$"), size, F.lit(".25"))).when(k == 2, F.concat(size, F.lit(" GBP"))).otherwise("ask us")
    symbols = [("€", "EUR"), ("$", "USD"), ("£", "GBP")]
    return t("part").select("p_partkey", F.get(text.numbers_in(label), F.lit(0)).alias("amount"), text.currency_of(label, symbols).alias("currency"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<a[ >]')) AS n_links, len(regexp_extract_all(html, '(?i)<li[ >]')) AS n_items, len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS n_headings, contains(lower(html), '<script') AS has_script FROM pages""")
def q31_page_elements(t, spark):
    """Structure of pages, natively."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t("pages").select("page_id", n("(?i)<a[ >]").alias("n_links"), n("(?i)<li[ >]").alias("n_items"), n("(?i)<h[1-6][ >]").alias("n_headings"), F.lower("html").contains("<script").alias("has_script"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def q32_content_hash_dedupe(t, spark):
    """One row a content."""
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def q33_json_props(t, spark):
    """K: fields of a JSON column."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("""
WITH c AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 800) / 100.0 + 40 AS lat, (s_suppkey * 91 % 800) / 100.0 + 20 AS lon FROM supplier),
d AS (SELECT a.k AS a, b.k AS b, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM c a JOIN c b ON a.k < b.k)
SELECT a, b, round(km, 4) AS km FROM d WHERE km <= 40""")
def q34_haversine_block(t, spark):
    """Pairs within 40 km by an equi-join on grid cells, then the distance."""
    c = lambda side: t("supplier").select(F.col("s_suppkey").alias("a" if side == "l" else "b"), ((F.col("s_suppkey") * 37 % 800) / 100.0 + 40).alias(f"lat_{side}"), ((F.col("s_suppkey") * 91 % 800) / 100.0 + 20).alias(f"lon_{side}"))
    return resolve.near_places(c("l"), c("r"), 40.0).filter("a < b").select("a", "b", F.round("km", 4).alias("km"))


@query("""
WITH e AS (SELECT l_suppkey AS s_suppkey, count(*) AS exposure FROM lineitem GROUP BY 1), j AS (SELECT s.s_suppkey, s_nationkey, coalesce(exposure, 0) AS exposure FROM supplier s LEFT JOIN e USING (s_suppkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY exposure, s_suppkey) AS rn FROM j) SELECT s_nationkey, s_suppkey, exposure, rn FROM r WHERE rn <= 4""")
def q35_rotation(t, spark):
    """Those shown least come next."""
    e = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("exposure"))
    j = t("supplier").join(e, "s_suppkey", "left").withColumn("exposure", F.coalesce("exposure", F.lit(0)))
    return rank.top_k(j, ["s_nationkey"], [F.asc("exposure"), F.asc("s_suppkey")], 4).select("s_nationkey", "s_suppkey", "exposure", "rn")


@query("""
WITH a AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part WHERE p_size < 20), b AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part WHERE p_size BETWEEN 10 AND 30),
u AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE 2 END AS tier FROM a WHERE n <= 8 UNION ALL SELECT *, 1 FROM b WHERE n <= 8), o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, n) AS k FROM u),
s AS (SELECT p_partkey, row_number() OVER (ORDER BY tier, n) AS slot FROM o WHERE k = 1) SELECT p_partkey, slot FROM s WHERE slot <= 6""")
def q36_quota_mix(t, spark):
    """Two saved rows first, then live ones, then the rest, a key once, six in all (a top-k report)."""
    p = t("part").select("p_partkey", "p_retailprice", "p_size")
    mixed = rank.quota_mix(p.filter("p_size < 20"), p.filter("p_size between 10 and 30"), "p_partkey", ["p_retailprice"], 2, 6)
    return mixed.select("p_partkey", "slot")


@query("SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey, s_suppkey % 7")
def q37_greedy_dedupe(t, spark):
    """Ordered, non-transitive dedupe on several keys; here the keys make it equal to grouping, which SQL can check."""
    k = F.array(F.concat(F.lit("id:"), F.col("s_suppkey") % 7), F.concat(F.lit("own:"), F.col("s_suppkey")))
    kept = resolve.greedy_dedupe(t("supplier").select("s_nationkey", "s_suppkey", k.alias("keys")), ["s_nationkey"], ["s_suppkey"], "keys")
    return kept.select("s_nationkey", "s_suppkey")


@query("""
WITH RECURSIVE n AS (SELECT s_nationkey AS g, s_suppkey AS k, ['id:' || s_suppkey % 50, 'host:' || s_suppkey * 3 % 11, 'name:' || s_suppkey % 7] AS ks, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
w AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, false AS kept FROM n
  UNION ALL SELECT n.g, n.i, n.k, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, NOT list_has_any(seen, ks) FROM w JOIN n ON n.g = w.g AND n.i = w.i + 1)
SELECT g AS s_nationkey, k AS s_suppkey FROM w WHERE kept""")
def q129_greedy_keys(t, spark):
    """Rows in order, dropped if any of three kinds of keys was seen with a row that stayed; no grouping gives this."""
    k = F.col("s_suppkey")
    keys = F.array(F.concat(F.lit("id:"), k % 50), F.concat(F.lit("host:"), k * 3 % 11), F.concat(F.lit("name:"), k % 7))
    return resolve.greedy_dedupe(t("supplier").select("s_nationkey", "s_suppkey", keys.alias("keys")), ["s_nationkey"], ["s_suppkey"], "keys").select("s_nationkey", "s_suppkey")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d + CAST(o_orderkey % 40 AS INTEGER) WHEN 1 THEN d + 7 * CAST(o_orderkey % 10 AS INTEGER)
  WHEN 2 THEN CAST(d + to_months(CAST(o_orderkey % 18 AS INTEGER)) AS DATE)
  ELSE CASE WHEN month(d) = 2 AND day(d) = 29 AND day(CAST(d + to_years(CAST(o_orderkey % 5 AS INTEGER)) AS DATE)) = 28 THEN CAST(d + to_years(CAST(o_orderkey % 5 AS INTEGER)) AS DATE) + 1 ELSE CAST(d + to_years(CAST(o_orderkey % 5 AS INTEGER)) AS DATE) END END AS due
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q38_redo_date(t, spark):
    """Due dates with stated month-end and leap-day rules."""
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.col("o_orderkey") % 40).when(k == 1, F.col("o_orderkey") % 10).when(k == 2, F.col("o_orderkey") % 18).otherwise(F.col("o_orderkey") % 5).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("days", "weeks", "months", "years"))), (k + 1).cast("int"))
    return t("orders").select("o_orderkey", text.add_period(F.col("o_orderdate").cast("date"), value, unit).alias("due"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q39_windowed_counts(t, spark):
    """The streaming aggregate, run over the table as a batch."""
    w = jobs.windowed_counts(t("events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS k FROM conversations) SELECT conv_id, turn, role, length(text) AS n_chars FROM r WHERE k = 1""")
def q41_latest_snapshot(t, spark):
    """The last state of each keyed log."""
    last = F.max_by(F.struct("turn", "role", F.length("text").cast("long").alias("n_chars")), F.struct("turn", F.negative(F.ascii("role")).alias("r")))
    return t("conversations").groupBy("conv_id").agg(last.alias("l")).select("conv_id", "l.*")


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderkey) AS k, lower(o_orderpriority) AS f FROM orders) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY f) AS options FROM a WHERE k = 1 GROUP BY o_custkey""")
def q42_option_lists(t, spark):
    """distinct options by folded spelling, the first spelling kept, in order."""
    one = t("orders").groupBy("o_custkey", F.lower("o_orderpriority").alias("f")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("first"))
    return one.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "first"))), lambda x: x["first"]), ",").alias("options"))


@query("""
SELECT * FROM (SELECT l_orderkey, CAST(unnest(['quantity', 'discount', 'tax']) AS VARCHAR) AS quote, unnest([l_quantity, CASE WHEN l_discount > 0 THEN l_discount END, CASE WHEN l_tax > 0 THEN l_tax END]) AS amount, l_linenumber FROM lineitem) WHERE amount IS NOT NULL""")
def q43_wide_to_long(t, spark):
    """One row a published quote."""
    wide = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "quote", "amount").filter("amount is not null")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem), o AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN count(DISTINCT l_shipdate) = 1 THEN min(l_shipdate) END AS bound_date, count(DISTINCT l_shipdate) > 1 AS ambiguous FROM o JOIN l ON l_orderkey = o_orderkey AND l_extendedprice <= o_totalprice * 0.6 GROUP BY o_orderkey""")
def q44_dated_binding(t, spark):
    """A date binds only if all matching records have the same; tested as min = max, so that no distinct is expanded."""
    l, o = t("lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate"), t("orders").select("o_orderkey", "o_totalprice")
    met = o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") <= F.col("o_totalprice") * 0.6))
    one = F.min("l_shipdate") == F.max("l_shipdate")
    return met.groupBy("o_orderkey").agg(F.when(one, F.min("l_shipdate")).alias("bound_date"), (~one).alias("ambiguous"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'directory' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'publisher' ELSE 'provider' END AS host_class FROM h""")
def q45_host_class(t, spark):
    """A host or one of its parents in a class table, joined on the exploded suffixes."""
    classes = spark.createDataFrame([("example.net", "directory"), ("example.org", "publisher")], "suffix string, host_class string")
    h = t("pages").select("page_id", F.explode(text.host_suffixes(text.host(F.col("url")))).alias("suffix")).join(F.broadcast(classes), "suffix").groupBy("page_id").agg(F.max_by("host_class", F.length("suffix")).alias("host_class"))  # two literal rows
    return t("pages").select("page_id").join(h, "page_id", "left").withColumn("host_class", F.coalesce("host_class", F.lit("provider")))
