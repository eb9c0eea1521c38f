"""Named queries of provider identity, provenance, trust and freshness; kinds with stated outcomes, as in trust."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.functions import evidence, identity, text
from offerlens.functions.rules import first_reason
from offerlens.operators import prices, resolve, serve
from offerlens.plans.catalog import query
from offerlens.plans.trust import values
from offerlens.streaming import jobs


def kinds(t, spark, rows, schema):
    """part keys with the columns of their kind."""
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"kind int, {schema}")
    return t("part").select("p_partkey", "p_size", F.pmod("p_partkey", F.lit(len(rows))).cast("int").alias("kind")).join(F.broadcast(table), "kind")  # a row a kind


NAMES = [
    ("Rose Clinic", "provider", "", None), ("", "provider", "", "empty_name"), ("€ 200", "provider", "", "price_like_name"), ("120 eur", "provider", "", "price_like_name"), ("Summer Sale", "provider", "", "offer_name"),
    ("Average nose job", "provider", "", "market_estimate"), ("Online Shop", "provider", "", "generic_shop"), ("Bookly", "provider", "", "marketplace_brand"), ("Rose", "publisher", "", "publisher_host"),
    ("Rose", "marketplace", "", "marketplace_without_provider"), ("Rose", "marketplace", "Rose Clinic", None), (None, "provider", "", "empty_name"),
]


@query("WITH k(kind, reason) AS (" + values([(k, r[3]) for k, r in enumerate(NAMES)]) + f") SELECT p_partkey, reason FROM part JOIN k ON kind = p_partkey % {len(NAMES)}")
def q111_identity_reason(t, spark):
    """Why a name is no provider's."""
    rows = kinds(t, spark, [r[:3] for r in NAMES], "name string, host_class string, provider string")
    return rows.select("p_partkey", identity.identity_reason(F.col("name"), F.col("host_class"), F.col("provider"), ["bookly"]).alias("reason"))


@query(r"""
WITH c(suffix, class) AS (VALUES ('example.net', 'directory'), ('blog.thther.example.net', 'publisher'), ('example.org', 'marketplace'), ('ads-track.example.com', 'booking')),
h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages),
m AS (SELECT page_id, arg_max(class, length(suffix)) AS class FROM h JOIN c ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY 1)
SELECT page_id, coalesce(class, 'provider') AS host_class FROM h LEFT JOIN m USING (page_id)""")
def q112_host_classes(t, spark):
    """Marketplace, directory, publisher and booking hosts by exact name or suffix, the longest suffix first."""
    classes = spark.createDataFrame([("example.net", "directory"), ("blog.thther.example.net", "publisher"), ("example.org", "marketplace"), ("ads-track.example.com", "booking")], "suffix string, host_class string")
    hosts = t("pages").select("page_id", F.explode(text.host_suffixes(text.host(F.col("url")))).alias("suffix"))
    hit = hosts.join(F.broadcast(classes), "suffix").groupBy("page_id").agg(F.max_by("host_class", F.length("suffix")).alias("host_class"))  # four literal rows
    return t("pages").select("page_id").join(hit, "page_id", "left").withColumn("host_class", F.coalesce("host_class", F.lit("provider")))


@query("""
WITH v AS (SELECT s_suppkey, s_suppkey % 40 AS city, 40 + s_suppkey % 9 * 0.01 AS lat, 'Rose ' || s_suppkey % 7 AS name, '1' || lpad(CAST(s_suppkey % 11 AS VARCHAR), 9, '5') AS phone, 'Main Street ' || s_suppkey % 5 AS address FROM supplier),
p AS (SELECT c_custkey, c_custkey % 40 AS city, 40 + c_custkey % 9 * 0.01 AS lat, 'The Rose ' || c_custkey % 7 || ' Clinic' AS name, '1' || lpad(CAST(c_custkey % 11 AS VARCHAR), 9, '5') AS phone, 'Main Road ' || c_custkey % 5 AS address FROM customer)
SELECT s_suppkey, c_custkey, CASE WHEN v.name <> replace(replace(p.name, 'The ', ''), ' Clinic', '') THEN 'name_mismatch' WHEN v.lat = p.lat OR right(v.phone, 9) = right(p.phone, 9) THEN 'strong' ELSE 'weak_name_only' END AS strength FROM v JOIN p USING (city)""")
def q113_venue_match(t, spark):
    """All venues and places of one city by name, with phone, geography or address beside it; judged once a pair of profiles."""
    own = lambda k: [(k % 40).alias("city"), (40 + k % 9 * 0.01).alias("lat"), F.lit(20.0).alias("lon"), F.concat(F.lit("1"), F.lpad((k % 11).cast("string"), 9, "5")).alias("phone")]
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    v = t("supplier").select("s_suppkey", *own(s), F.concat(F.lit("Rose "), s % 7).alias("name"), F.concat(F.lit("Main Street "), s % 5).alias("address"))
    p = t("customer").select("c_custkey", *own(c), F.concat(F.lit("The Rose "), c % 7, F.lit(" Clinic")).alias("name"), F.concat(F.lit("Main Road "), c % 5).alias("address"))
    return prices.venue_pairs(v, p, "s_suppkey", "c_custkey", identity.GENERIC)


PLACES = [("Deutschland", "EUR", "DE"), ("tr", "EUR", "TR"), ("", "GBP", "GB"), (None, "XXX", "US"), ("Türkiye", None, "TR"), ("nowhere", "TRY", "TR")]


@query("WITH k(kind, code) AS (" + values([(k, r[2]) for k, r in enumerate(PLACES)]) + f") SELECT p_partkey, code FROM part JOIN k ON kind = p_partkey % {len(PLACES)}")
def q114_country_code(t, spark):
    """A country's code by alias, two letters, currency or default."""
    rows = kinds(t, spark, [r[:2] for r in PLACES], "country string, currency string")
    return rows.select("p_partkey", identity.country_code(F.col("country"), F.col("currency"), {"deutschland": "DE", "turkiye": "TR"}, {"GBP": "GB", "TRY": "TR"}).alias("code"))


SPOTS = [("uk", "London", "51.5", "-0.1", "GB", 51.5, -0.1), ("", "Rome", "x", "12", "IT", None, None), (None, "Atlantis", "95", "0", None, None, None), ("fr", "Rome", "NaN", "1", "FR", None, None), ("tr", "", "41.0", "29.0", "TR", 41.0, 29.0)]


@query("WITH k(kind, country, lat, lon) AS (" + values([(k, *r[4:]) for k, r in enumerate(SPOTS)]) + f") SELECT p_partkey, country, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM part JOIN k ON kind = p_partkey % {len(SPOTS)}")
def q115_locality(t, spark):
    """Codes of countries, by the city where they are missing, and coordinates that are on the globe."""
    rows = kinds(t, spark, [r[:4] for r in SPOTS], "country string, city string, a string, b string")
    got = identity.locality(F.col("country"), F.col("city"), F.col("a"), F.col("b"), {"rome": "IT"})
    return rows.select("p_partkey", *(c.alias(n) for n, c in got.items()))


#: identity, status, reverify, flagged, amount, price text, label, url, currency, relation, provenance, sane, method, source type, reason.
TRUST = [
    (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", None), ("offer_name", "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", "invalid_identity"),
    (None, "legacy_untrusted", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", "legacy_untrusted"), (None, "", True, False, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", "needs_reverification"),
    (None, "", True, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", None), (None, "unverified", False, False, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", "not_verified_flag"),
    (None, "official_website", False, None, 90.0, "€90", "Peel", "u", "EUR", "variant", None, True, "table", "", None), (None, "", False, True, 90.0, " ", "Peel", "u", "EUR", "exact", None, True, "table", "", "missing_literal_evidence"),
    (None, "", False, True, None, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "", "missing_literal_evidence"), (None, "", False, True, 90.0, "€90", "Peel", "u", "", "exact", None, True, "table", "", "missing_currency"),
    (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "bundle", None, True, "table", "", "bad_procedure_relation"), (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", "future", True, "table", "", "provenance"),
    (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, False, "table", "", "sanity_reject"), (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "AI_read", "", "untrusted_extraction_method"),
    (None, "", False, True, 90.0, "€90", "Peel", "u", "EUR", "exact", None, True, "table", "Scraper", "untrusted_source_type"),
]


@query("WITH k(kind, reason) AS (" + values([(k, r[-1]) for k, r in enumerate(TRUST)]) + f") SELECT p_partkey, reason FROM part JOIN k ON kind = p_partkey % {len(TRUST)}")
def q116_trust_gate(t, spark):
    """The trust gate with all its eleven reasons."""
    names = ["identity", "status", "reverify", "flagged", "amount", "price_text", "label", "url", "currency", "relation", "provenance", "sane", "method", "source_type"]
    types = {"reverify": "boolean", "flagged": "boolean", "amount": "double", "sane": "boolean"}
    rows = kinds(t, spark, [r[:-1] for r in TRUST], ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
    return rows.select("p_partkey", first_reason(identity.trust_reasons(**{n: F.col(n) for n in names})).alias("reason"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN 'missing_currency' WHEN o_orderkey % 5 = 3 THEN 'sanity' END AS sanitised, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE round(o_totalprice, 2) END AS price FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 5 <> 1""")
def q117_sanitise_pool(t, spark):
    """Rows of a pool are dropped, or stripped to a stub, by the first check that holds."""
    k = F.col("o_orderkey") % 5
    checks = [("location", k == 0, "drop"), ("revision", k <= 1, "drop"), ("missing_currency", k == 2, "strip"), ("sanity", k == 3, "strip")]
    return identity.sanitise_pool(t("orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price")), checks, ["price"]).select("o_orderkey", "sanitised", "price")


CURRENCIES = [("marketplace", "platform_converted", "EUR", "a.example", None), ("marketplace", "platform_converted", "USD", "a.example", "conversion_unstable"), ("marketplace", "platform_converted", "EUR", "b.example", "conversion_unstable"), ("marketplace", "viewer_localized", "EUR", "a.example", "original_currency_unverified"), ("official", "viewer_localized", "EUR", "a.example", None), (None, None, None, None, None)]


@query("WITH k(kind, failure) AS (" + values([(k, r[4]) for k, r in enumerate(CURRENCIES)]) + f") SELECT p_partkey, failure FROM part JOIN k ON kind = p_partkey % {len(CURRENCIES)}")
def q118_currency_provenance(t, spark):
    """Why a marketplace's currency can't be trusted."""
    rows = kinds(t, spark, [r[:4] for r in CURRENCIES], "source_type string, basis string, currency string, host string")
    return rows.select("p_partkey", identity.currency_failure(F.col("source_type"), F.col("basis"), F.col("currency"), F.col("host"), "a.example", "EUR").alias("failure"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'expired' WHEN o_orderkey % 60 <= 14 THEN 'fresh' WHEN o_orderkey % 60 <= 30 THEN 'stale_usable' ELSE 'expired' END AS state,
  CASE o_custkey % 4 WHEN 0 THEN 'permanent' WHEN 1 THEN 'temporary' WHEN 2 THEN 'retry' ELSE 'none' END AS class, CASE o_orderkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 25 WHEN 2 THEN 10 ELSE 0 END AS rank FROM orders""")
def q119_freshness(t, spark):
    """Age and revision to a state; classes of failures; ranks of sources."""
    k = F.col("o_custkey") % 4
    reason = F.element_at(F.array(*map(F.lit, ("invalid_identity_offer", "HTTP 503", "odd", ""))), (k + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("official", "verified_marketplace", "verified", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t("orders").select("o_orderkey", identity.freshness(F.col("o_orderkey") % 60, 14, F.when(k != 0, F.lit("r2")), F.lit("r2"), 30).alias("state"), identity.failure_class(reason).alias("class"), identity.source_rank(kind).alias("rank"))


@query("""
WITH r(n, rate) AS (VALUES (0, 1.0), (1, 0.9), (2, 30.0)) SELECT c_custkey FROM customer JOIN r ON n = c_nationkey % 3
WHERE c_acctbal / 1000 >= 2 - 1e-9 AND contains(lower(c_name), '1') AND c_acctbal / rate >= 100 AND c_acctbal / rate <= 6000""")
def q120_compare_filter(t, spark):
    """Rating, name cue and converted amount in bounds."""
    rate = F.element_at(F.array(F.lit(1.0), F.lit(0.9), F.lit(30.0)), (F.col("c_nationkey") % 3 + 1).cast("int"))
    keep = identity.compare_filter(F.col("c_acctbal") / 1000, 2.0, F.col("c_name"), "1", F.col("c_acctbal"), 100.0, 6000.0, rate)
    return t("customer").filter(keep).select("c_custkey")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.a.example/' || p_size || '?x=1&y=2,https://shop.a.example/,https://example/' ELSE '' END AS links FROM part""")
def q121_sitemap(t, spark):
    """A sitemap's urls of the same site, of sites below it and of those above it."""
    xml = F.concat(F.lit("<urlset><url><loc> https://www.a.example/"), F.col("p_size"), F.lit("?x=1&amp;y=2 </loc></url><url><loc>https://shop.a.example/</loc></url><url><loc>https://example/</loc></url><url><loc>https://b.example/</loc></url><url><loc>https://shop.a.example/</loc></url></urlset>"))
    own = F.when(F.col("p_partkey") % 2 == 0, "a.example").otherwise("c.test")
    return t("part").select("p_partkey", F.array_join(identity.sitemap_locations(xml, own), ",").alias("links"))


@query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_totalprice DESC, o_orderkey) AS n FROM d)
SELECT o_custkey, day, count(*) AS entries, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (n <= 20) AS listed FROM r GROUP BY 1, 2""")
def q122_journal_days(t, spark):
    """a journal by day with its entries in order, twenty at most as samples."""
    d = t("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice")
    n = F.row_number().over(Window.partitionBy("o_custkey", "day").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    some = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 20, F.struct("n", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string"))
    return d.withColumn("n", n).groupBy("o_custkey", "day").agg(F.count("*").alias("entries"), F.array_join(some, ",").alias("listed"))


@query("""
WITH u AS (SELECT c_custkey AS k, 0 AS source, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, row_number() OVER (ORDER BY c_custkey) FROM customer),
l AS (SELECT * FROM u WHERE n <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source) AS i FROM l) SELECT k, CAST(source AS BIGINT) AS source FROM r WHERE i = 1 ORDER BY source, k LIMIT 40""")
def q123_limited_union(t, spark):
    """A4, H4: the union of limited queries, an id's first query stays, 40 in all (the limits are the feature)."""
    c = t("customer").select(F.col("c_custkey").alias("k"))
    return resolve.ordered_union_distinct([c.filter("k % 2 = 0").orderBy("k").limit(30), c.orderBy("k").limit(30)], "k").orderBy("source", "k").limit(40)


@query("""
WITH known AS (SELECT s_suppkey AS k, round(s_acctbal, 2) AS price, s_suppkey % 3 AS age FROM supplier), page AS (SELECT s_suppkey AS k, round(s_acctbal * 2, 2) AS price FROM supplier WHERE s_suppkey % 2 = 0)
SELECT known.k, CASE WHEN age > 0 AND page.k IS NOT NULL THEN page.price ELSE known.price END AS price, CASE WHEN age = 0 THEN 'fresh' WHEN page.k IS NULL THEN 'missing' WHEN page.price = known.price THEN 'unchanged' ELSE 'refreshed' END AS state FROM known LEFT JOIN page USING (k)""")
def q124_refresh_known(t, spark):
    """N: known offers refreshed from pages read again: fresh ones stay, others take the page's price, if it still has one."""
    known = t("supplier").select(F.col("s_suppkey").alias("k"), F.round("s_acctbal", 2).alias("price"), (F.col("s_suppkey") % 3).alias("age"))
    read = t("supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.round(F.col("s_acctbal") * 2, 2).alias("price"))
    return serve.refresh_known(known, read, ["k"], "price", F.col("age") > 0).select("k", "price", "state")


@query("""
WITH v AS (SELECT s_suppkey, s_nationkey, 'https://m.example/' || s_suppkey AS url, round(s_acctbal, 2) AS price FROM supplier), c AS (SELECT c_custkey AS candidate, 'http://www.m.example/' || c_custkey || '/' AS url FROM customer WHERE c_custkey % 2 = 0)
SELECT s_suppkey AS venue, candidate, CASE WHEN price <= 0 THEN 'no_price' WHEN candidate IS NULL THEN 'staged' ELSE 'imported' END AS decision FROM v LEFT JOIN c ON candidate = s_suppkey""")
def q125_import_marketplace(t, spark):
    """N, E1: a marketplace's venues meet candidates by url; matched and priced ones are imported, others staged."""
    venues = t("supplier").select(F.col("s_suppkey").alias("venue"), F.concat(F.lit("https://m.example/"), F.col("s_suppkey")).alias("url"), F.round("s_acctbal", 2).alias("price"))
    candidates = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("candidate"), F.concat(F.lit("http://www.m.example/"), F.col("c_custkey"), F.lit("/")).alias("url"))
    return serve.import_marketplace(venues, candidates, "venue", "candidate", "price").select("venue", "candidate", "decision")


UNITS = [("€90 per 2 areas", "area", 2.0, "EUR"), ("€90/ml", "ml", None, "EUR"), ("3 sessions for €90", "session", 3.0, "EUR"), ("90 GBP, from 1,5 ml", "ml", 1.5, "GBP"), ("$5 coffee, far away from it all, then a peel for € 90", None, None, "USD"), ("in € and more words that are far away: 90", None, None, "EUR"), ("ask us", None, None, None), (None, None, None, None)]


@query("WITH k(kind, unit, quantity, currency) AS (" + values([(k, *r[1:]) for k, r in enumerate(UNITS)]) + f") SELECT p_partkey, unit, CAST(quantity AS DOUBLE) AS quantity, currency FROM part JOIN k ON kind = p_partkey % {len(UNITS)}")
def q126_label_units(t, spark):
    """Units and quantities of price labels, and the currency beside their first number."""
    rows = kinds(t, spark, [r[:1] for r in UNITS], "label string")
    got = evidence.unit_of(F.col("label"))
    symbols = [("€", "EUR"), ("$", "USD"), ("£", "GBP")]
    return rows.select("p_partkey", got["unit"].alias("unit"), got["quantity"].alias("quantity"), evidence.currency_near(F.col("label"), symbols).alias("currency"))


SCORES = ["/prices/botox", "/services", "/treatments/botox-rome", "/menu.pdf", "/blog/pricing", "/book/pricing", "/", "/booking", "/fees", "/prices.jpg", "/paris/prices", "/peels/prices", "/rome/paris/menu", "/special-offers/prices"]


@query(r"""
WITH k(kind, path) AS (""" + values(list(enumerate(SCORES))) + r"""),
u AS (SELECT page_id, string_split(url, '?')[1] AS base, path FROM pages JOIN k ON kind = page_id % """ + str(len(SCORES)) + r"""),
p AS (SELECT page_id, lower(regexp_extract(string_split(base, '#')[1], '^[a-zA-Z]+://[^/?#]*(.*)$', 1) || path) AS p FROM u),
w AS (SELECT *, regexp_split_to_array(p, '[^a-z0-9]+') AS t, string_split(regexp_replace(p, '\.[a-z]+$', ''), '/') AS s FROM p),
b AS (SELECT *, CASE WHEN list_has_any(t, ['prices', 'pricing']) THEN 3 WHEN list_contains(t, 'services') THEN 2 WHEN list_has_any(t, ['treatments', 'en']) THEN 1 ELSE 0 END AS k, list_contains(t, 'botox') AS own,
  list_has_any(s, ['deals', 'offers', 'promotions', 'special-offers']) AS offer, list_has_any(s, ['appointment', 'book', 'booking', 'book-now', 'book-online']) AS book FROM w),
c AS (SELECT *, greatest(k, CASE WHEN ends_with(p, '.pdf') THEN 3 ELSE 0 END) + CAST(own AS INTEGER) AS n FROM b)
SELECT page_id, CAST(CASE WHEN p LIKE '%.jpg' OR (list_contains(t, 'paris') AND NOT list_contains(t, 'rome')) OR (list_contains(t, 'peels') AND NOT own) THEN 0 ELSE
  CASE WHEN list_has_any(s, ['fees', 'price-list', 'pricelist', 'prices', 'tariff']) AND NOT offer AND NOT book THEN greatest(n, 5) WHEN book THEN greatest(n, 4) WHEN offer OR list_has_any(s, ['article', 'blog', 'faq', 'guide', 'guides', 'news']) THEN least(n, 1) ELSE n END
  + CASE WHEN list_contains(t, 'rome') THEN 4 ELSE 0 END END AS INTEGER) AS score FROM c""")
def q127_url_score(t, spark):
    """The score of the pages' urls, each with one of some paths behind it: zeros, floors, caps and the city."""
    table = spark.createDataFrame(list(enumerate(SCORES)), "kind int, path string")
    base = F.regexp_replace("url", r"[?#].*$", "")
    rows = t("pages").select("page_id", base.alias("base"), F.pmod("page_id", F.lit(len(SCORES))).cast("int").alias("kind")).join(F.broadcast(table), "kind")  # a row a kind
    score = evidence.url_score(F.concat("base", "path"), ["botox"], ["prices", "pricing"], ["services"], ["treatments", "en"], ["rome"], ["paris"], ["peels"])
    return rows.select("page_id", score.alias("score"))


@query("""
WITH e AS (SELECT user_id, epoch_ms(max(ts)) AS t, max(event_id) % 3 AS k FROM events GROUP BY 1)
SELECT user_id, CASE WHEN k = 0 THEN 'lease_held' WHEN k = 1 THEN 'start' ELSE 'ttl_fresh' END AS decision FROM e""")
def q128_lease_heartbeat(t, spark):
    """A lease counts only while its heartbeat is fresh."""
    e = t("events").groupBy("user_id").agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("t"), (F.max("event_id") % 3).alias("k"))
    k, now = F.col("k"), F.col("t") + 1000
    lease = F.when(k <= 1, F.col("t") + 60_000)
    beat = F.when(k == 0, F.col("t")).otherwise(F.col("t") - 800_000)
    decided = jobs.lease_decision(now, lease, F.when(k == 2, "done"), F.lit(None).cast("long"), F.col("t") + 5000, beat)
    return e.select("user_id", decided.alias("decision"))


@query("""
WITH e AS (SELECT c_custkey, c_custkey % 300 AS a, c_custkey % 170 AS b, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal, 2) END AS rating, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer WHERE c_acctbal > 0),
m AS (SELECT s_suppkey, arg_min(struct_pack(rating, name), c_custkey) AS r FROM supplier JOIN e ON s_suppkey % 500 = a OR s_suppkey % 400 = b GROUP BY 1)
SELECT s.s_suppkey, coalesce(r.rating, round(s_acctbal, 2)) AS rating, coalesce(r.name, s_name) AS name FROM supplier s LEFT JOIN m USING (s_suppkey)""")
def q130_overlay_first(t, spark):
    """Ratings and names from the first enriched row that shares a key and has something to say; what it lacks stays."""
    key = lambda kind, c: F.concat(F.lit(kind), c)
    base = t("supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("rating"), F.col("s_name").alias("name"), F.array(key("a", F.col("s_suppkey") % 500), key("b", F.col("s_suppkey") % 400)).alias("keys"))
    k = F.col("c_custkey")
    extra = t("customer").select(k.alias("ord"), F.when(k % 5 > 0, F.round("c_acctbal", 2)).alias("rating"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.array(key("a", k % 300), key("b", k % 170)).alias("keys"), "c_acctbal")
    return resolve.overlay_first(base, extra, "s_suppkey", "keys", "ord", F.col("c_acctbal") > 0, ["rating", "name"]).select("s_suppkey", "rating", "name")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Istanbul' WHEN 1 THEN 'Istanbul' WHEN 2 THEN 'Rome' ELSE 'City ' || c_nationkey END AS canonical FROM customer""")
def q131_canonical_place(t, spark):
    """Places by folded alias, and parts of a metropolis as the metropolis."""
    k = F.col("c_custkey") % 4
    place = F.when(k == 0, "İstanbul-Şişli").when(k == 1, "Constantinople").when(k == 2, " roma ").otherwise(F.concat(F.lit("City "), F.col("c_nationkey")))
    aliases = spark.createDataFrame([("Constantinople", "Istanbul"), ("Roma", "Rome"), ("Istanbul Sisli", "Sisli")], "alias string, city string")
    metros = spark.createDataFrame([("Şişli", "Istanbul")], "part string, city string")
    return resolve.canonical_place(t("customer").select("c_custkey", place.alias("place")), "place", aliases, metros).select("c_custkey", "canonical")


#: resolved, verified, candidates, status, lease, started, completed, retry (ms before or after now), failure, reason, start.
DISCOVERIES = [
    (False, 9, 9, "done", None, None, None, None, None, "city_unresolved", "no"), (True, 4, 9, "done", None, None, None, None, None, "pool_healthy", "no"), (True, 1, 9, None, None, None, None, None, None, "partial_without_state", "yes"),
    (True, None, None, None, None, None, None, None, None, "unknown_coverage", "yes"), (True, 1, 9, "running", 5, -1, None, None, None, "lease_held", "no"), (True, 1, 9, "running", -5, -1, None, None, None, "already_running", "no"),
    (True, 1, 9, "running", None, -9000000, None, None, None, "stale_running", "yes"), (True, 1, 9, "failed", None, None, -5, 7, "quota", "retry_backoff", "no"), (True, None, 9, "done", None, None, -5, None, None, "thin_cooldown", "no"),
    (True, 1, 9, "failed", None, None, -5, None, "quota", "quota_backoff", "no"), (True, 1, 20, "failed", None, None, -5, None, "other", "failed", "yes"), (True, None, 9, "done", None, None, -90000000, None, None, "done", "yes"),
]


@query("WITH k(kind, reason, start) AS (" + values([(k, *r[-2:]) for k, r in enumerate(DISCOVERIES)]) + f") SELECT p_partkey, reason, start = 'yes' AS start FROM part JOIN k ON kind = p_partkey % {len(DISCOVERIES)}")
def q132_discovery_decision(t, spark):
    """L9, B.6: whether a market's discovery starts, by the first of its rules."""
    rows = kinds(t, spark, [r[:-2] for r in DISCOVERIES], "resolved boolean, verified int, candidates int, status string, lease long, started long, completed long, retry long, failure string")
    now = F.lit(1_700_000_000_000)
    at = lambda c: now + F.col(c)
    got = jobs.discovery_decision(now, F.col("resolved"), F.col("verified"), F.col("candidates"), F.col("status"), at("lease"), at("started"), at("completed"), at("retry"), F.col("failure"))
    return rows.select("p_partkey", *(c.alias(n) for n, c in got.items()))
