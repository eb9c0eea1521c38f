"""Named queries of evidence, serving and state operators over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.functions import evidence, rules, text
from offerlens.operators import rank, resolve, serve
from offerlens.plans.catalog import query

NOW = "timestamp_ntz'2024-01-31 00:00:00'"


@query("""
SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 5) AS locked FROM part""")
def q46_evidence_lock(t, spark):
    """C4: an amount counts only if its source writes it, cents and all, plainly or grouped, and not inside a longer number."""
    a, k = F.round(F.col("p_retailprice") * 10 + 0.07, 2), F.col("p_partkey") % 6
    plain, grouped = F.format_string("%.2f", a), F.format_number(a, 2)
    now = lambda x: F.concat(F.lit("now "), x)
    label = F.when(k == 0, now(plain)).when(k == 1, now(grouped)).when(k == 2, now(F.translate(grouped, ",.", ".,"))).when(k == 3, F.concat(F.lit("now 7"), plain)).when(k == 4, now(F.floor(a).cast("string"))).otherwise(F.concat(F.translate(plain, ".", ","), F.lit(" EUR")))
    return t("part").select("p_partkey", evidence.literally_in(label, a).alias("locked"))


@query("""
SELECT reason, count(*) AS n, CAST(sum(rank) AS BIGINT) AS rank_sum FROM (
  SELECT CASE WHEN s_acctbal < 0 THEN 'identity' WHEN l_linestatus <> 'F' THEN 'status' WHEN l_returnflag = 'R' THEN 'reverify' WHEN l_extendedprice <= 0 THEN 'no_amount' WHEN l_discount > 0.08 THEN 'provenance' ELSE 'trusted' END AS reason,
    CASE s_suppkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 0 END AS rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY reason""")
def q47_trust_gate(t, spark):
    """The ordered trust gate with its first reason; ranks of sources summed by reason."""
    rows = t("lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_extendedprice", "l_discount").join(t("supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    gate = [("identity", F.col("s_acctbal") < 0), ("status", F.col("l_linestatus") != "F"), ("reverify", F.col("l_returnflag") == "R"), ("no_amount", F.col("l_extendedprice") <= 0), ("provenance", F.col("l_discount") > 0.08)]
    order = F.element_at(F.array(*map(F.lit, (40, 30, 20, 0))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return rows.groupBy(F.coalesce(rules.first_reason(gate), F.lit("trusted")).alias("reason")).agg(F.count("*").alias("n"), F.sum(order).alias("rank_sum"))


SIGNALS = [("red", "colour"), ("blue", "colour"), ("bolt", "fastener"), ("plate", "sheet"), ("gear", "drive")]


@query("""
WITH s AS (SELECT p_partkey, p_type, contains(p_name, 'red') OR contains(p_name, 'blue') AS c, contains(p_name, 'bolt') AS b, contains(p_name, 'plate') AS p, contains(p_name, 'gear') AS g FROM part),
n AS (SELECT *, CAST(c AS INTEGER) + CAST(b AS INTEGER) + CAST(p AS INTEGER) + CAST(g AS INTEGER) AS n FROM s)
SELECT p_partkey, n AS n_signals, CASE WHEN p_type = 'PROMO' THEN 'market' WHEN c AND p_type = 'SMALL' THEN 'add_on' WHEN c AND n > 1 THEN 'bundle' WHEN c THEN 'exact' WHEN n = 0 THEN 'ambiguous' ELSE 'different' END AS relation FROM n""")
def q48_relation(t, spark):
    """Signals of a label, and its relation to the wanted one by the first rule that holds."""
    found = evidence.signals(F.col("p_name"), SIGNALS)
    return t("part").select("p_partkey", F.size(found).alias("n_signals"), evidence.relation(found, F.lit("colour"), F.col("p_type") == "PROMO", F.col("p_type") == "SMALL").alias("relation"))


UNITS = [("sess", "session"), ("area", "area"), ("ml", "ml"), ("syr", "syringe")]


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'session' WHEN 1 THEN 'area' WHEN 2 THEN 'ml' WHEN 3 THEN 'syringe' END AS unit, CASE p_partkey % 5 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN 1.5 END AS quantity FROM part""")
def q49_unit_standard(t, spark):
    """Unit labels to standard units and quantities."""
    from offerlens.sources.curated import unit_parts

    k = F.col("p_partkey") % 5
    label = F.when(k == 0, "per session").when(k == 1, F.concat(F.lit("per "), F.col("p_size"), F.lit(" areas"))).when(k == 2, "1.5 ml").when(k == 3, "Syringe").otherwise("each")
    return t("part").select("p_partkey", evidence.standard_unit(label, UNITS).alias("unit"), unit_parts(label)["unit_quantity"].alias("quantity"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN CAST(100 + p_size AS DOUBLE) END AS price_min, CASE WHEN p_partkey % 5 = 1 THEN CAST(500 + p_size AS DOUBLE) END AS price_max, CASE p_partkey % 5 WHEN 0 THEN 'from' WHEN 1 THEN 'range' WHEN 2 THEN 'approximate' WHEN 3 THEN 'fixed' END AS price_type FROM part""")
def q50_price_text(t, spark):
    """Bounds and type of price labels."""
    k, a, b = F.col("p_partkey") % 5, (F.col("p_size") + 100).cast("string"), (F.col("p_size") + 500).cast("string")
    label = F.when(k == 0, F.concat(F.lit("From $"), a)).when(k == 1, F.concat(F.lit("$"), a, F.lit(" - $"), b)).when(k == 2, F.concat(F.lit("approx. "), a, F.lit(" €"))).when(k == 3, F.concat(a, F.lit(" GBP"))).otherwise("ask us")
    return t("part").select("p_partkey", *(c.alias(n) for n, c in evidence.price_text(label).items()))


@query("""
WITH a AS (SELECT s_suppkey, '+1 555 ' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 6, '0') AS phone, s_nationkey FROM supplier), b AS (SELECT c_custkey, '555' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS phone, c_nationkey FROM customer)
SELECT s_suppkey, c_custkey, s_nationkey = c_nationkey AS same_place FROM a JOIN b ON right(regexp_replace(a.phone, '[^0-9]', '', 'g'), 9) = right(b.phone, 9)""")
def q51_phone_match(t, spark):
    """One provider by the last nine digits of its phone, an equi-join; the place is compared after."""
    a = t("supplier").select("s_suppkey", "s_nationkey", evidence.phone_key(F.concat(F.lit("+1 555 "), F.lpad((F.col("s_suppkey") * 3).cast("string"), 6, "0"))).alias("phone"))
    b = t("customer").select("c_custkey", "c_nationkey", evidence.phone_key(F.concat(F.lit("555"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).alias("phone"))
    return a.join(b, "phone").select("s_suppkey", "c_custkey", (F.col("s_nationkey") == F.col("c_nationkey")).alias("same_place"))


@query(r"""
WITH k AS (SELECT page_id, unnest(list_distinct(string_split_regex(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^a-z]+'))) AS token FROM pages),
c(token, market) AS (VALUES ('en', 'north'), ('fr', 'west'), ('de', 'centre'), ('es', 'south'))
SELECT p.page_id, min(market) AS market, coalesce(min(market) <> 'north', false) AS conflicts FROM pages p LEFT JOIN (SELECT * FROM k JOIN c USING (token)) m ON p.page_id = m.page_id GROUP BY p.page_id""")
def q52_url_market(t, spark):
    """The market a url's path names by a whole token, joined on tokens; a conflict if it isn't the wanted one."""
    markets = spark.createDataFrame([("en", "north"), ("fr", "west"), ("de", "centre"), ("es", "south")], "token string, market string")
    path = F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    tokens = t("pages").select("page_id", F.explode(F.array_distinct(F.split(path, "[^a-z]+"))).alias("token"))
    hit = tokens.join(F.broadcast(markets), "token").groupBy("page_id").agg(F.min("market").alias("market"))  # four literal rows
    return t("pages").select("page_id").join(hit, "page_id", "left").withColumn("conflicts", F.coalesce(F.col("market") != "north", F.lit(False)))


@query("""
WITH j AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'implausible' END AS reason FROM orders)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(sum(CASE WHEN reason IS NULL THEN o_totalprice END), 2) AS total, round(sum(CASE WHEN reason IS NOT NULL THEN o_totalprice END), 2) AS legacy_total, min(o_orderkey) AS sample FROM j GROUP BY 1""")
def q53_invalidate(t, spark):
    """B8, F5, N: untrusted rows keep their identity, prices move to legacy columns; statistics by reason."""
    reason = rules.first_reason([("pending", F.col("o_orderstatus") == "P"), ("implausible", F.col("o_totalprice") < 50000)])
    done = serve.invalidate_untrusted(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), reason, ["o_totalprice"])
    return done.groupBy(F.coalesce("invalid_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.sum("legacy_o_totalprice"), 2).alias("legacy_total"), F.min("o_orderkey").alias("sample"))


@query("""
SELECT user_id, round(sum(value), 4) AS total, max(ts) AS last_seen, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), 4) AS last_purchase, count(*) AS n FROM events GROUP BY user_id""")
def q54_seed_rollup(t, spark):
    """sum, maximum and the last value that is given, in one partial aggregate."""
    last = F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id")))
    return t("events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_seen"), F.round(last, 4).alias("last_purchase"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type <> 'error') AS last_success FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY successes DESC, last_success DESC NULLS LAST, user_id) AS rn FROM c) SELECT user_id, successes, failures, last_success, rn FROM r WHERE rn <= 12""")
def q55_source_reliability(t, spark):
    """Successes and failures of a source, the most reliable twelve of each shard."""
    good = F.col("event_type") != "error"
    c = t("events").groupBy("user_id").agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.max(F.when(good, F.col("ts"))).alias("last_success"))
    c = c.withColumn("shard", F.col("user_id") % 10)
    return rank.top_k(c, ["shard"], [F.desc("successes"), F.desc_nulls_last("last_success"), F.asc("user_id")], 12).drop("shard")


@query("""
SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, count(*) FILTER (date_trunc('month', o_orderdate) = TIMESTAMP '1998-08-01') AS this_month, least(count(*) * 25, 999) AS score FROM orders GROUP BY o_custkey""")
def q56_spend_summary(t, spark):
    """total, count of one month and a capped score."""
    month = F.date_trunc("month", "o_orderdate").cast("date") == F.lit("1998-08-01").cast("date")
    return t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count_if(month).alias("this_month"), F.least(F.count("*") * 25, F.lit(999).cast("long")).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, cost FROM (SELECT l_orderkey, l_linenumber, l_shipdate, lower(l_returnflag) AS title, CASE WHEN l_discount > 0 THEN l_extendedprice END AS cost FROM lineitem) WHERE title = 'n' AND coalesce(cost >= 20000 AND cost <= 40000, false)""")
def q57_timeline_filter(t, spark):
    """C20: equal titles without case, costs in bounds; a null cost fails any bound."""
    cost = F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", cost.alias("cost"))
    return rows.filter((F.lower("l_returnflag") == "n") & F.coalesce(F.col("cost").between(20000, 40000), F.lit(False))).select("l_orderkey", "l_linenumber", "cost")


@query("""
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal < 0 DESC, c_acctbal DESC, c_name, c_custkey) AS rn FROM customer) SELECT * FROM r WHERE rn BETWEEN 11 AND 20""")
def q58_community_page(t, spark):
    """Live rows first, then by value, the second page of ten of each segment."""
    c = t("customer").withColumn("live", F.col("c_acctbal") < 0)
    return rank.top_k(c, ["c_mktsegment"], [F.desc("live"), F.desc("c_acctbal"), F.asc("c_name"), F.asc("c_custkey")], 20).filter("rn > 10").select("c_mktsegment", "c_custkey", "rn")


@query("""
WITH s AS (SELECT s_nationkey AS session, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, s_acctbal FROM supplier),
shown AS (SELECT session, s_suppkey, n AS slot FROM s WHERE n <= 2), fresh AS (SELECT session, s_suppkey, s_acctbal + 1 AS value, row_number() OVER (PARTITION BY session ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM s),
kept AS (SELECT h.session, h.s_suppkey, h.slot, f.value FROM shown h JOIN fresh f USING (session, s_suppkey)),
new AS (SELECT f.session, f.s_suppkey, f.value, row_number() OVER (PARTITION BY f.session ORDER BY rank) + (SELECT count(*) FROM shown h WHERE h.session = f.session) AS slot FROM fresh f ANTI JOIN shown h USING (session, s_suppkey))
SELECT session, s_suppkey, slot, round(value, 4) AS value FROM kept UNION ALL SELECT session, s_suppkey, slot, round(value, 4) FROM new WHERE slot <= 4""")
def q59_slots(t, spark):
    """Shown slots stay and are refreshed, free ones are filled."""
    s = t("supplier").select(F.col("s_nationkey").alias("session"), "s_suppkey", "s_acctbal")
    n = F.row_number().over(Window.partitionBy("session").orderBy("s_suppkey")).cast("long")
    shown = s.withColumn("slot", n).filter("slot <= 2").select("session", "s_suppkey", "slot", F.col("s_acctbal").alias("value"))
    by = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    fresh = s.select("session", "s_suppkey", (F.col("s_acctbal") + 1).alias("value"), by.alias("rank"))
    return serve.stabilise_slots(shown, fresh, "session", "s_suppkey", 4).withColumn("value", F.round("value", 4))


@query("""
WITH RECURSIVE s AS (SELECT l_linenumber AS category, l_suppkey, round(sum(l_extendedprice), 2) AS score FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, l_suppkey) AS r FROM s),
l AS (SELECT category, list(l_suppkey ORDER BY r) AS ks FROM n WHERE r <= 7 GROUP BY category), o AS (SELECT *, row_number() OVER (ORDER BY category) AS i FROM l),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS category, CAST(NULL AS BIGINT) AS l_suppkey, CAST([] AS BIGINT[]) AS used
  UNION ALL SELECT o.i, o.category, list_filter(ks, lambda k: NOT list_contains(used, k))[1], list_append(used, list_filter(ks, lambda k: NOT list_contains(used, k))[1]) FROM w JOIN o ON o.i = w.i + 1)
SELECT category, l_suppkey FROM w WHERE l_suppkey IS NOT NULL""")
def q60_one_per_category(t, spark):
    """Each category takes its best provider that no category before it has taken."""
    s = t("lineitem").groupBy(F.col("l_linenumber").alias("category"), "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return serve.one_per_category(s, "category", "l_suppkey", "score", 7)


@query("""
WITH a AS (SELECT lower(p_name) || ' ' || p_size || ' ' || lower(p_type) AS alias, p_brand FROM part) SELECT alias, min(p_brand) AS owner FROM a GROUP BY alias HAVING count(DISTINCT p_brand) = 1""")
def q61_alias_inversion(t, spark):
    """An alias that one owner alone has; tested as min = max."""
    return t("part").groupBy(F.concat_ws(" ", F.lower("p_name"), "p_size", F.lower("p_type")).alias("alias")).agg(F.min("p_brand").alias("owner"), F.max("p_brand").alias("last")).filter("owner = last").select("alias", "owner")


@query("""
SELECT c_custkey, n_nationkey AS country FROM (SELECT c_custkey, 'Street ' || c_custkey || ', NATION_' || (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END) AS address FROM customer) LEFT JOIN nation ON n_name = string_split(address, ', ')[-1]""")
def q62_country_of_address(t, spark):
    """The country an address ends with, by a join on its last part."""
    odd = F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0)
    address = F.concat(F.lit("Street "), F.col("c_custkey"), F.lit(", NATION_"), F.col("c_nationkey") + odd)
    named = t("customer").select("c_custkey", F.element_at(F.split(address, ", "), -1).alias("n_name"))
    return named.join(t("nation"), "n_name", "left").select("c_custkey", F.col("n_nationkey").alias("country"))


@query("""
SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(?:19|20)[0-9][0-9]'), lambda x: CAST(x AS INTEGER))) AS year FROM documents""")
def q63_year_hint(t, spark):
    """The latest year a text names."""
    years = F.regexp_extract_all("text", F.lit("((?:19|20)[0-9][0-9])"), 1)
    return t("documents").select("doc_id", F.array_max(F.transform(years, lambda y: y.cast("int"))).alias("year"))


@query("""
SELECT l_orderkey, round(min(l_extendedprice) + coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_tax * 100 END), 0), 4) AS price FROM lineitem GROUP BY l_orderkey""")
def q64_add_on_fee(t, spark):
    """A page's mandatory fee is added to its best price."""
    fee = F.coalesce(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 100)), F.lit(0))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.min("l_extendedprice") + fee, 4).alias("price"))


@query("""
SELECT p_partkey, (p_size // 10, p_size % 10, 0) >= (2, 5, 0) AS supported FROM part""")
def q65_version_gate(t, spark):
    """Versions compared part by part, missing parts as 0."""
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    return t("part").select("p_partkey", (evidence.versions(v) >= evidence.versions(F.lit("2.5"))).alias("supported"))


@query("""
SELECT event_id FROM events WHERE NOT (event_type IN ('error', 'purchase') AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)""")
def q66_retention(t, spark):
    """Terminal rows go once they are old, all others stay."""
    old = F.col("event_type").isin("error", "purchase") & (F.col("ts") < F.expr(f"{NOW} - interval 10 days"))
    return t("events").filter(~old).select("event_id")


@query("""
WITH p AS (SELECT event_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*) FILTER (coalesce(ts - before <= CASE event_type WHEN 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END, false)) AS hits, count(*) AS n FROM p GROUP BY event_type""")
def q67_ttl_cache(t, spark):
    """Look-ups that a cache with a time to live by reason would answer."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ttl = F.when(F.col("event_type") == "error", F.expr("interval '1' hour")).otherwise(F.expr("interval '24' hour"))
    p = t("events").select("event_type", "ts", F.lag("ts").over(w).alias("before"))
    return p.groupBy("event_type").agg(F.count_if(F.col("ts") - F.col("before") <= ttl).alias("hits"), F.count("*").alias("n"))


@query("""
SELECT user_id, arg_max(value, (ts, event_id)) AS value, min(ts) FILTER (event_type <> 'error') AS posted_at FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'""")
def q68_change_feed(t, spark):
    """A public mirror: the last tagged state, gone if the last state is untagged, with the first posting's time."""
    last = F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id"))
    g = t("events").groupBy("user_id").agg(last.alias("l"), F.min(F.when(F.col("event_type") != "error", F.col("ts"))).alias("posted_at"))
    return g.filter("l.event_type != 'error'").select("user_id", "l.value", "posted_at")


@query("""
WITH live AS (SELECT n_name, p.s_suppkey, p.s_acctbal FROM supplier p JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice > 90000 AND l_discount = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM live)
SELECT n_name, count(*) AS n_candidates, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 4) AS display FROM r WHERE rn <= 30 GROUP BY n_name""")
def q69_price_index(t, spark):
    """N, A3, B6, B15, E8: a market's candidates without quarantined sources: how many, and the first four."""
    offers = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal").join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_acctbal")
    bad = t("lineitem").filter("l_extendedprice > 90000 and l_discount = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    index = serve.price_index(offers, bad, ["n_name"], "s_suppkey", [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return index.select("n_name", "n_candidates", F.array_join(F.transform("display", lambda r: r["s_suppkey"].cast("string")), ",").alias("display"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def q70_provider_search(t, spark):
    """N, C22: folded search over several fields, the best twenty (a top-k report)."""
    return serve.provider_search(t("customer"), ["c_name", "c_mktsegment"], "Build", [F.desc("c_acctbal"), F.asc("c_custkey")], 20).select("c_custkey", "c_name")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'blocked' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) OR 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') IN (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier) THEN 'known' ELSE 'queued' END AS decision FROM customer""")
def q71_enqueue(t, spark):
    """N, E7, B10: candidates that are blocked, known by any of their keys, or queued; keys are exploded and joined."""
    known = t("orders").filter("o_totalprice > 200000").select(F.concat(F.lit("id:"), F.col("o_custkey").cast("string")).alias("key"))
    known = known.unionByName(t("supplier").select(F.concat(F.lit("name:"), F.regexp_replace("s_name", "Supplier", "Customer")).alias("key")))
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    return serve.enqueue_candidates(c, known, {"id": F.col("c_custkey").cast("string"), "name": F.col("c_name")}, F.col("c_acctbal") < -500, "c_custkey").select("c_custkey", "decision")


@query("""
WITH p AS (SELECT c_nationkey, count(*) AS pending FROM customer GROUP BY 1), a AS (SELECT o_custkey AS c_custkey, count(*) AS attempts FROM orders GROUP BY 1),
r AS (SELECT c.c_nationkey, c.c_custkey, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY coalesce(attempts, 0), c.c_custkey) AS slot, pending FROM customer c JOIN p USING (c_nationkey) LEFT JOIN a USING (c_custkey))
SELECT c_nationkey, c_custkey, slot FROM r WHERE slot <= greatest(5, least(10, ceil(pending / 10)))""")
def q72_verify_batch(t, spark):
    """N, H5, D15: the least tried candidates of each market, five to ten by what is pending."""
    c = t("customer").select("c_nationkey", "c_custkey")
    pending = c.groupBy("c_nationkey").agg(F.count("*").alias("pending"))
    tried = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("attempts"))
    rows = c.join(tried, "c_custkey", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).join(pending, "c_nationkey")
    return serve.verify_batch(rows, ["c_nationkey"], "attempts", "c_custkey", serve.batch_size(F.col("pending"))).select("c_nationkey", "c_custkey", "slot")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25")
def q73_resumed_page(t, spark):
    """A5: the next page of a scan after a token; the limit is the feature."""
    return t("orders").filter("o_orderkey > 1000").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_custkey")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END) AS attempts, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_custkey""")
def q74_candidate_merge(t, spark):
    """I2, I5, I10, K: array union, greatest count and first non-empty value of two batches, by key."""
    attempts = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    part = lambda d: d.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("set"), F.max(attempts).alias("n"), F.min(F.struct("o_orderkey", "o_orderstatus")).alias("first"))
    old, new = part(t("orders").filter("o_totalprice < 150000")), part(t("orders").filter("o_totalprice >= 150000")).withColumnsRenamed({"set": "set2", "n": "n2", "first": "first2"})
    empty = F.expr("cast(array() as array<string>)")
    union = F.array_join(F.array_sort(F.array_union(F.coalesce("set", empty), F.coalesce("set2", empty))), ",")
    return old.join(new, "o_custkey", "full_outer").select("o_custkey", union.alias("priorities"), F.greatest("n", "n2").alias("attempts"), F.least("first", "first2")["o_orderstatus"].alias("first_status"))


@query("""
SELECT coalesce(family, 'other') AS family, count(*) AS n, count(*) FILTER (p_size > 25) AS n_large FROM (SELECT p_size, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN lower(p_type) END AS family FROM part) GROUP BY 1""")
def q75_family_tally(t, spark):
    """Rows by family, `other` without one."""
    family = F.coalesce(F.when(F.col("p_type").isin("PROMO", "SMALL"), F.lower("p_type")), F.lit("other"))
    return t("part").groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"))


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages),
o AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, link FROM l)
SELECT page_id, CASE WHEN starts_with(link, '/') THEN origin || link ELSE link END AS target, count(*) AS n FROM o WHERE starts_with(link, '/') OR starts_with(link, origin) GROUP BY 1, 2""")
def q76_site_links(t, spark):
    """A page's links within its own site, made absolute."""
    links = t("pages").select("page_id", F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1).alias("origin"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    inner = F.startswith("link", F.lit("/")) | F.startswith("link", "origin")
    target = F.when(F.startswith("link", F.lit("/")), F.concat("origin", "link")).otherwise(F.col("link"))
    return links.filter(inner).groupBy("page_id", target.alias("target")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS repaired FROM documents")
def q77_mojibake(t, spark):
    """Texts read in the wrong character set are put right: here each is spoilt first, and must come back."""
    spoilt = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t("documents").select("doc_id", F.sha2(evidence.mojibake_repaired(spoilt), 256).alias("repaired"))


@query(r"""
WITH x AS (SELECT page_id, 'Home | ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - Reviews' AS title, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^(www|m|blog)\.', '') AS host FROM pages)
SELECT page_id, coalesce(list_filter(list_transform(string_split_regex(title, '\s+[|\-–]\s+'), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN ('home', 'reviews'))[1], string_split(host, '.')[1]) AS lead FROM x""")
def q78_search_lead(t, spark):
    """A provider's name from a page's title, else from its host."""
    title = F.concat(F.lit("Home | "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - Reviews"))
    return t("pages").select("page_id", evidence.lead_name(title, F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), ["home", "reviews"]).alias("lead"))


@query("""
SELECT n_name || ' ' || f || CASE stage WHEN 1 THEN ' prices' ELSE ' near me' END AS search, stage FROM nation, (VALUES ('small'), ('large')) v(f), (VALUES (1), (2)) s(stage)""")
def q79_query_text(t, spark):
    """Search texts for each market, family and stage."""
    combos = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("stage")) for f in ("small", "large") for s in (1, 2)))
    x = t("nation").select("n_name", F.explode(combos).alias("c"))
    tail = F.when(F.col("c.stage") == 1, " prices").otherwise(" near me")
    return x.select(F.concat("n_name", F.lit(" "), F.col("c.f"), tail).alias("search"), F.col("c.stage").alias("stage"))


@query("""
SELECT s_nationkey, round(min(d), 3) AS nearest, round(max(d), 3) AS farthest FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS d FROM supplier) GROUP BY s_nationkey""")
def q80_distance_range(t, spark):
    """F16: least and greatest of the positive values."""
    d = text.positive(F.col("s_acctbal"))
    return t("supplier").groupBy("s_nationkey").agg(F.round(F.min(d), 3).alias("nearest"), F.round(F.max(d), 3).alias("farthest"))


@query("""
WITH f AS (SELECT o_custkey, bit_xor(CAST('0x' || substr(md5(o_orderkey || '|' || o_orderstatus), 1, 15) AS BIGINT)) AS fingerprint, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT o_custkey, bit_xor(CAST('0x' || substr(md5(o_orderkey || '|' || CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END), 1, 15) AS BIGINT)) AS fingerprint, count(*) AS n FROM orders GROUP BY 1)
SELECT f.o_custkey, f.fingerprint = g.fingerprint AND f.n = g.n AS unchanged FROM f JOIN g USING (o_custkey)""")
def q81_skip_unchanged(t, spark):
    """A keyed batch is written only if its rows' fingerprint changed; fingerprints don't depend on order and add up partially."""
    digest = lambda status: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), status)), 1, 15), 16, 10).cast("long")
    odd = F.when(F.col("o_orderkey") % 97 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    # both fingerprints in one pass: the same rows, before and after
    g = t("orders").groupBy("o_custkey").agg(F.bit_xor(digest(F.col("o_orderstatus"))).alias("was"), F.bit_xor(digest(odd)).alias("now"))
    return g.select("o_custkey", (F.col("was") == F.col("now")).alias("unchanged"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'invalid' ELSE CASE WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-02' THEN 'future' END END AS failure FROM orders""")
def q82_date_provenance(t, spark):
    """Why a published date can't be trusted."""
    k = F.col("o_orderkey") % 5
    shown = F.when(k == 0, "").when(k == 1, "03/04/1997").when(k == 2, "1997-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", evidence.date_failure(shown, F.lit("1998-01-01")).alias("failure"))


@query("""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' AND value > 50 THEN 'permanent' WHEN event_type IN ('error', 'signup') THEN 'temporary' WHEN value < 5 THEN 'weak' ELSE 'structured' END AS class FROM events) GROUP BY class""")
def q83_failure_class(t, spark):
    """Permanent and temporary failures, weak and structured methods."""
    known = [("permanent", (F.col("event_type") == "error") & (F.col("value") > 50)), ("temporary", F.col("event_type").isin("error", "signup")), ("weak", F.col("value") < 5)]
    return t("events").groupBy(F.coalesce(rules.first_reason(known), F.lit("structured")).alias("class")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) WHEN 1 THEN 'from $' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) ELSE '$' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' - $' || format('{:,}', CAST(floor(p_retailprice * 2) AS BIGINT)) END AS label FROM part""")
def q84_price_label(t, spark):
    """Shown price labels; amounts are cut, not rounded."""
    k, low = F.col("p_partkey") % 3, F.col("p_retailprice")
    return t("part").select("p_partkey", evidence.amount_label(low, F.when(k == 2, low * 2), F.when(k == 1, "from").otherwise("fixed"), F.lit("$")).alias("label"))


@query("""
WITH e AS (SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey GROUP BY 1),
f AS (SELECT s.s_suppkey, min(c.c_custkey) AS c_custkey FROM supplier s ANTI JOIN e USING (s_suppkey) JOIN customer c ON right(s_name, 2) = right(c_name, 2) WHERE c_nationkey IS NOT NULL GROUP BY 1)
SELECT s_suppkey, c_custkey, 'exact' AS how FROM e UNION ALL SELECT s_suppkey, c_custkey, 'suffix' FROM f""")
def q85_match_with_fallback(t, spark):
    """An exact key first; what is left over by a suffix, both equi-joins, the first match each."""
    s, c = t("supplier").select("s_suppkey", "s_name", "s_nationkey"), t("customer").select("c_custkey", "c_name", "c_nationkey")
    exact = s.join(c, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).groupBy("s_suppkey").agg(F.min("c_custkey").alias("c_custkey"))
    # one row a suffix before the join: only the first match counts
    suffix = c.groupBy(F.right("c_name", F.lit(2)).alias("suffix")).agg(F.min("c_custkey").alias("c_custkey"))
    left = s.join(exact, "s_suppkey", "left_anti").withColumn("suffix", F.right("s_name", F.lit(2)))
    return exact.withColumn("how", F.lit("exact")).unionByName(left.join(suffix, "suffix").select("s_suppkey", "c_custkey", F.lit("suffix").alias("how")))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, rn FROM r WHERE rn <= 3""")
def q86_trusted_first(t, spark):
    """H8, I4, I8: a pool with trusted rows first, capped for each key as its contract says (a top-k report)."""
    o = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("trusted"))
    return rank.top_k(o, ["o_custkey"], [F.desc("trusted"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rn")


@query("""
SELECT s_suppkey, round(coalesce(r.best, s_acctbal), 2) AS rating, r.best IS NOT NULL AS enriched FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_quantity) AS best FROM lineitem WHERE l_tax > 0.07 AND l_discount > 0.09 GROUP BY 1) r ON l_suppkey = s_suppkey""")
def q87_legacy_projection(t, spark):
    """An overlay fills or replaces values, identity columns stay as they are."""
    best = t("lineitem").filter("l_tax > 0.07 and l_discount > 0.09").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("best"))
    both = resolve.overlay(t("supplier").select("s_suppkey", F.col("s_acctbal").alias("acct"), F.lit(None).cast("double").alias("best")), best, ["s_suppkey"], ["best"])
    return both.select("s_suppkey", F.round(F.coalesce("best", "acct"), 2).alias("rating"), F.col("best").isNotNull().alias("enriched"))
