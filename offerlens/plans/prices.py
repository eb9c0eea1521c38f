"""Named queries of the price call and of the joins behind it; their SQL computes the same rows from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import evidence, identity, sanity
from offerlens.functions.occurrences import occurrences
from offerlens.functions.text import haversine_km, host
from offerlens.operators import prices
from offerlens.plans.catalog import dealt, query
from offerlens.plans.trust import values
from offerlens.streaming import jobs, keyed

FAMILIES = ["ring", "bolt", "gear", "plate", "widget"]
REQUESTS = [("en", "ring"), ("en", "bolt"), ("en", "plate"), ("fr", "gear"), ("de", "plate"), ("es", "widget")]
URL_CITY = r"^[a-zA-Z]+://[^/?#]+/([a-z]{2})/"


def menu_pages(t):
    """pages with the menu of the part of the same number: its name (every fourth a voucher for it), a quantity without a name, and every fifth a flight."""
    money = lambda c: F.format_string("%.2f", c)
    row = lambda label, price: F.concat(F.lit("<tr><td>"), label, F.lit("</td><td>€"), price, F.lit("</td></tr>"))
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_name"), F.lit(" gift voucher"))).otherwise(F.col("p_name"))
    flight = F.when(F.col("p_size") % 5 == 0, row(F.concat(F.lit("flights and "), F.col("p_name")), money(F.col("p_retailprice") / 2))).otherwise("")
    menu = F.concat(F.lit("<table><tr><th>Service</th><th>Price</th></tr>"), row(name, money(F.col("p_retailprice"))), row(F.concat(F.lower("p_type"), F.lit(" 2 ml")), money(F.col("p_retailprice") + 10)), flight, F.lit("</table>"))
    p = t("part").select(F.col("p_partkey").alias("page_id"), menu.alias("menu"))
    return t("pages").join(p, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("menu", F.lit(""))).alias("html"))


def market(t, spark):
    """requests, candidates and pool: hosts of the pages and some without pages; a host whose name has a length of a multiple of 7 is blocked, of 5 priced in the pool."""
    requests = spark.createDataFrame(REQUESTS, "city string, family string")
    hosts = t("pages").select(host(F.col("url")).alias("host"), F.regexp_extract("url", URL_CITY, 1).alias("city"))
    others = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example")).alias("host"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("city"))
    candidates = hosts.unionByName(others).distinct().withColumn("blocked", F.length("host") % 7 == 0)
    pool = candidates.filter(F.length("host") % 5 == 0).select("host", "city", F.lit("ring").alias("family"), (F.length("host") * 10).cast("double").alias("amount"), F.lit("EUR").alias("currency"), F.lit("stored ring").alias("label"))
    return requests, candidates, pool


def staged(t, spark):
    requests, candidates, pool = market(t, spark)
    judged = prices.judged_evidence(menu_pages(t), [(f, rf"\b{f}s?\b") for f in FAMILIES], r"\b\d+ ml\b", r"\bhot\b", r"\bold\b")
    city = F.nullif(F.regexp_extract("url", URL_CITY, 1), F.lit(""))
    return requests, pool, prices.provider_stages(requests, candidates, pool, judged, city)


STAGES_SQL = r"""
WITH r(city, family) AS (""" + values(REQUESTS) + r"""),
u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([a-z]{2})/', 1) AS city, html FROM pages),
c AS (SELECT host, city FROM u UNION SELECT 's' || s_suppkey || '.example', (['en', 'fr', 'de', 'es'])[s_nationkey % 4 + 1] FROM supplier),
pool AS (SELECT host, city, 'ring' AS family, CAST(length(host) * 10 AS DOUBLE) AS amount, 'EUR' AS currency, 'stored ring' AS label FROM c WHERE length(host) % 5 = 0),
m AS (SELECT u.*, p_name, p_size, p_retailprice, lower(p_type) || ' 2 ml' AS quantity, list_extract(list_filter(['ring', 'bolt', 'gear', 'plate', 'widget'], lambda f: list_contains(string_split(p_name, ' '), f)), 1) AS family FROM u JOIN part ON page_id = p_partkey),
e AS (
  SELECT host, city AS url_city, page_id, family, CASE WHEN p_name LIKE 'old %' THEN 'market' WHEN p_name LIKE 'hot %' THEN 'add_on' ELSE 'exact' END AS relation, p_name || CASE WHEN p_size % 4 = 0 THEN ' gift voucher' ELSE '' END AS label, round(p_retailprice, 2) AS amount, p_size % 4 = 0 AS rejected FROM m
  UNION ALL SELECT host, city, page_id, family, 'variant', quantity, round(p_retailprice + 10, 2), false FROM m
  UNION ALL SELECT host, city, page_id, family, CASE WHEN p_name LIKE 'old %' THEN 'market' WHEN p_name LIKE 'hot %' THEN 'add_on' ELSE 'exact' END, 'flights and ' || p_name, round(p_retailprice / 2, 2), true FROM m WHERE p_size % 5 = 0),
h AS (SELECT host, bool_or(trim(html) <> '') AS read FROM u GROUP BY 1),
pr AS (SELECT host, true AS priced FROM m GROUP BY 1),
a AS (SELECT c.host, c.city, r.family FROM c JOIN r ON r.city = c.city WHERE length(c.host) % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.host = c.host AND p.city = c.city AND p.family = r.family)),
g AS (SELECT a.city, a.family, a.host, h.host IS NOT NULL AS found, coalesce(h.read, false) AS read, coalesce(priced, false) AS priced,
    coalesce(bool_or(e.relation IN ('exact', 'variant')), false) AS matched, coalesce(bool_or(e.relation IN ('exact', 'variant') AND url_city = a.city), false) AS near,
    min(CASE WHEN e.relation IN ('exact', 'variant') AND NOT rejected AND url_city = a.city THEN {'indirect': e.relation <> 'exact', 'amount': e.amount, 'label': e.label, 'page_id': e.page_id, 'currency': 'EUR', 'relation': e.relation} END) AS offer
  FROM a LEFT JOIN h USING (host) LEFT JOIN pr USING (host) LEFT JOIN e ON e.host = a.host AND e.family = a.family GROUP BY a.city, a.family, a.host, h.host, h.read, priced),
s AS (SELECT *, 1 + CAST(found AS INTEGER) + CAST(found AND read AS INTEGER) + CAST(found AND read AND priced AS INTEGER) + CAST(priced AND matched AS INTEGER) + CAST(priced AND near AS INTEGER) + CAST(near AND offer IS NOT NULL AS INTEGER) AS stage FROM g)
"""


@query(STAGES_SQL + """,
f AS (SELECT p.city, p.family, host, min({'amount': amount, 'currency': currency, 'label': label}) AS o, 'exact' AS relation, 'pool' AS source FROM pool p JOIN r ON r.city = p.city AND r.family = p.family GROUP BY ALL),
b AS (SELECT city, family, host, o.amount AS amount, o.currency AS currency, o.label AS label, relation, source FROM f UNION ALL SELECT city, family, host, offer.amount, offer.currency, offer.label, offer.relation, 'fresh' FROM s WHERE stage = 7),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY city, family ORDER BY source DESC, relation, amount, host) AS INTEGER) AS rank FROM b)
SELECT * FROM k WHERE rank <= 30""")
def q133_procedure_prices(t, spark):
    """N, H1, H8, C4, D6: the price call over pages: the pool's trusted rows, then the best accepted offer of each candidate."""
    requests, pool, stages = staged(t, spark)
    return prices.procedure_prices(requests, pool, stages)


@query(STAGES_SQL + """,
n(k, stage) AS (VALUES (1, 'candidate'), (2, 'page_found'), (3, 'page_fetched'), (4, 'evidence_extracted'), (5, 'procedure_matched'), (6, 'city_matched'), (7, 'accepted'))
SELECT city, family, n.stage, CAST(sum(CASE WHEN s.stage >= k THEN 1 ELSE 0 END) AS BIGINT) AS providers FROM s, n GROUP BY city, family, n.stage""")
def q134_price_funnel(t, spark):
    """N, F4: how many candidates of a request come how far."""
    return prices.funnel(staged(t, spark)[2])


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag = 'R' AS market, l_linestatus = 'F' AND l_quantity > 40 AS extra, l_quantity > 25 AS part, p_name, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' END AS own FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, coalesce(bool_or(own = 'ring') OVER (PARTITION BY l_orderkey), false) AS witness FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, witness, CASE WHEN market THEN 'market' WHEN own = 'ring' AND extra THEN 'add_on' WHEN own = 'ring' AND part THEN 'variant' WHEN own = 'ring' THEN 'exact' WHEN own IS NULL AND part AND witness THEN 'variant' WHEN own IS NULL THEN 'ambiguous' ELSE 'different' END AS relation FROM w""")
def q135_relation_witness(t, spark):
    """A label's relation, where a part without a treatment of its own belongs to the one that another row of its page names."""
    l = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")  # noqa: E741
    found = F.array_compact(F.array(F.when(F.contains("p_name", F.lit("ring")), "ring"), F.when(F.contains("p_name", F.lit("bolt")), "bolt")))
    rows = prices.witnessed(l.withColumn("found", found), "l_orderkey", "found")
    witness = F.array_contains("witnesses", "ring")
    extra = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)
    relation = evidence.relation(F.col("found"), F.lit("ring"), F.col("l_returnflag") == "R", extra, F.col("l_quantity") > 25, witness)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", witness.alias("witness"), relation.alias("relation"))


@query(r"""
WITH t AS (SELECT doc_id, replace(replace(replace(regexp_replace(lower(coalesce(text, '')), '[\n|]', ' | ', 'g'), chr(9), ' '), chr(13), ' '), chr(160), ' ') AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '\d+(?:[.,]\d+)*') AS n, string_split_regex(t, '\d+(?:[.,]\d+)*') AS g FROM t),
o AS (SELECT doc_id, n, g, unnest(range(len(n))) AS i FROM p WHERE len(n) > 0),
b AS (SELECT doc_id, i, n[i + 1] AS raw, array_to_string(list_transform(range(greatest(i - 24, 0), i + 1), lambda k: g[k + 1] || CASE WHEN k < i THEN n[k + 1] ELSE '' END), '') AS before,
  array_to_string(list_transform(range(i, least(i + 8, len(n) - 1) + 1), lambda k: CASE WHEN k = i THEN '' ELSE n[k + 1] END || g[k + 2]), '') AS behind FROM o),
w AS (SELECT *, list_filter(string_split_regex(before, ' +'), lambda x: x <> '') AS l, list_filter(string_split_regex(behind, ' +'), lambda x: x <> '') AS r FROM b)
SELECT doc_id, CAST(i AS INTEGER) AS ord, raw, array_to_string(l[greatest(len(l) - 23, 1):], ' ') AS before, array_to_string(r[:8], ' ') AS behind FROM w""")
def q136_number_occurrences(t, spark):
    """Every number of every whole text with the words before and behind it, from one scan."""
    found = F.inline(occurrences(F.col("text"), r"\d+(?:[.,]\d+)*"))
    return t("documents").select("doc_id", found).select("doc_id", "ord", "raw", "before", "behind")


@query("""
WITH k AS (SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN CASE p_type WHEN 'PROMO' THEN 'flights' ELSE 'hotel' END END AS cue, p_size % 15 AS gap, p_size % 3 = 0 AS cut, p_size % 4 = 0 AS asks FROM part)
SELECT p_partkey, CASE WHEN cue IS NOT NULL AND NOT cut AND gap + 3 <= 9 THEN 'travel_cost_not_procedure' END AS reason FROM k""")
def q137_scope_windows(t, spark):
    """C11: a travel cue counts within ten words before the amount, whatever numbers stand between, at any of its places; a cell border ends its reach."""
    cue = F.when(F.col("p_type") == "PROMO", "flights").when(F.col("p_type") == "SMALL", "hotel").otherwise("peel")
    filler = F.array_join(F.array_repeat(F.lit("so"), (F.col("p_size") % 15).cast("int")), " ")
    price = F.concat(F.lit("€"), F.format_number("p_retailprice", 2))
    text = F.concat_ws(" ", F.lit("now"), price, F.lit("|"), cue, F.when(F.col("p_size") % 3 == 0, "|").otherwise("x"), F.lit("for 2 people"), filler, price)
    rows = dealt(t("part"), "p_partkey").select("p_partkey", "p_retailprice", text.alias("text")).withColumn("found", occurrences(F.col("text")))
    from offerlens.functions.occurrences import of_amount

    found = of_amount(F.col("found"), F.round("p_retailprice", 2))
    return rows.select("p_partkey", sanity.scope_reason(found, sanity.low(F.col("text")), F.lit("peel"), F.round("p_retailprice", 2)).alias("reason"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS b FROM documents),
x AS (SELECT doc_id, unnest(range(len(b))) AS block, b FROM l),
n AS (SELECT doc_id, block, unnest(regexp_extract_all(b[block + 1], '\d+(?:[.,]\d+)*')) AS raw FROM x),
w AS (SELECT DISTINCT doc_id, block, word FROM (SELECT doc_id, block, unnest(regexp_split_to_array(lower(b[block + 1]), '[^\p{L}\d]+')) AS word FROM x) WHERE length(word) >= 4),
c AS (SELECT doc_id, CAST(raw AS BIGINT) AS amount, min(block) AS block FROM n WHERE regexp_full_match(raw, '[1-9]\d{0,5}') GROUP BY ALL),
d AS (SELECT l.doc_id, array_to_string(list_slice(string_split(lower(b[1]), ' '), 1, 2), ' ') AS label FROM l),
k AS (SELECT c.doc_id, amount, label FROM c JOIN d USING (doc_id)),
a AS (SELECT DISTINCT doc_id, block, CAST(raw AS BIGINT) AS amount FROM n WHERE regexp_full_match(raw, '[1-9]\d{0,5}')),
h AS (SELECT DISTINCT k.doc_id, k.amount FROM k JOIN a ON a.doc_id = k.doc_id AND a.amount = k.amount JOIN w ON w.doc_id = a.doc_id AND w.block = a.block WHERE list_contains(regexp_split_to_array(k.label, '[^\p{L}\d]+'), w.word))
SELECT k.doc_id, CAST(k.amount AS DOUBLE) AS amount, label, h.doc_id IS NOT NULL AS locked FROM k LEFT JOIN h ON h.doc_id = k.doc_id AND h.amount = k.amount""")
def q138_shared_block(t, spark):
    """C4: claims of a label (the first words of a text) and an amount (each plain number in it), locked only where one line holds both."""
    d = t("documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("blocks"))
    amounts, words = prices.block_index(d, "doc_id", F.col("blocks"), number=r"\d+(?:[.,]\d+)*", plain=r"[1-9]\d{0,5}", beside=True)
    label = F.array_join(F.slice(F.split(F.lower(F.get("blocks", F.lit(0))), " "), 1, 2), " ")
    claims = amounts.select("doc_id", "cents").distinct().join(d.select("doc_id", label.alias("label")), "doc_id").select(F.concat_ws(":", "doc_id", "cents").alias("claim"), "doc_id", (F.col("cents") / 100).alias("amount"), "label")
    return prices.lock_claims(claims, amounts, words, "doc_id", "claim").select("doc_id", "amount", "label", "locked")


def packed_names(t):
    """Suppliers and customers by packed names: some are equal, some hold another's, some are too short to count."""
    s = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("rose"), F.col("s_suppkey"))).otherwise(F.concat(F.lit("clinic"), F.lpad((F.col("s_suppkey") * 37).cast("string"), 6, "0"))).alias("s_name"))
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("the"), F.lit("clinic"), F.lpad(((F.col("c_custkey") % 500) * 37).cast("string"), 6, "0"), F.lit("garden"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("rose"), F.col("c_custkey") % 100)).otherwise(F.substring(F.concat(F.lit("clinic"), F.lpad(((F.col("c_custkey") % 300) * 37).cast("string"), 6, "0")), 4, 9)).alias("c_name"))
    return s, c


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'rose' || s_suppkey ELSE 'clinic' || lpad(CAST(s_suppkey * 37 AS VARCHAR), 6, '0') END AS a FROM supplier),
c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'theclinic' || lpad(CAST(c_custkey % 500 * 37 AS VARCHAR), 6, '0') || 'garden' WHEN 1 THEN 'rose' || c_custkey % 100 ELSE substring('clinic' || lpad(CAST(c_custkey % 300 * 37 AS VARCHAR), 6, '0'), 4, 9) END AS b FROM customer)
SELECT s_suppkey, c_custkey FROM s, c WHERE a = b OR (length(a) >= 8 AND contains(b, a)) OR (length(b) >= 8 AND contains(a, b))""")
def q139_contained_names(t, spark):
    """E5: providers whose packed names are equal, or one of which holds the other."""
    s, c = packed_names(t)
    return prices.contained_names(s, "s_suppkey", "s_name", c, "c_custkey", "c_name")


@query("""
WITH l AS (SELECT c_custkey, c_nationkey AS country, CASE WHEN c_custkey % 4 = 0 THEN 'city ' || c_custkey % 60 END AS city, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey % 12 END AS region, CASE WHEN c_custkey % 3 > 0 THEN 40 + c_custkey % 50 * 0.02 END AS lat, 'street ' || c_custkey % 90 AS line FROM customer),
r AS (SELECT s_suppkey, s_nationkey AS country, 'city ' || s_suppkey % 60 AS city, s_suppkey % 12 AS region, 40 + s_suppkey % 50 * 0.02 AS lat, 'street ' || s_suppkey % 70 AS line FROM supplier),
m AS (
  SELECT c_custkey, 0 AS k, s_suppkey FROM l JOIN r ON l.country = r.country AND l.city = r.city
  UNION ALL SELECT c_custkey, 1, s_suppkey FROM l JOIN r ON l.region = r.region AND l.country % 5 = r.country % 5
  UNION ALL SELECT c_custkey, 2, s_suppkey FROM l JOIN r ON floor(l.lat * 100) = floor(r.lat * 100) AND 2 * 6371.0 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2))) <= 1
  UNION ALL SELECT c_custkey, 3, s_suppkey FROM l JOIN r USING (line)),
b AS (SELECT c_custkey, min({'k': k, 's': s_suppkey}) AS b FROM m GROUP BY 1)
SELECT c_custkey, b.s AS matched, CASE b.k WHEN 0 THEN 'country_city' WHEN 1 THEN 'region' WHEN 2 THEN 'distance' WHEN 3 THEN 'text' END AS step FROM customer LEFT JOIN b USING (c_custkey)""")
def q140_ranked_match(t, spark):
    """A legacy place to a resolved one by country and city, else region, else distance, else text."""
    k = F.col("c_custkey")
    left = t("customer").select("c_custkey", F.col("c_nationkey").alias("country"), F.when(k % 4 == 0, F.concat(F.lit("city "), k % 60)).alias("city"), F.when(k % 4 != 3, k % 12).alias("region"), F.when(k % 3 > 0, 40 + k % 50 * 0.02).alias("lat"), F.concat(F.lit("street "), k % 90).alias("line"))
    s = F.col("s_suppkey")
    right = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("r_country"), F.concat(F.lit("city "), s % 60).alias("r_city"), (s % 12).alias("r_region"), (40 + s % 50 * 0.02).alias("r_lat"), F.concat(F.lit("street "), s % 70).alias("r_line"))
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", a, b))
    c = F.col
    steps = [
        ("country_city", both(c("country"), c("city")), both(c("r_country"), c("r_city")), None),
        ("region", both(c("region"), c("country") % 5), both(c("r_region"), c("r_country") % 5), None),
        ("distance", F.floor(c("lat") * 100), F.floor(c("r_lat") * 100), (haversine_km(c("lat"), F.lit(0.0), c("r_lat"), F.lit(0.0)) <= 1, ["lat"], ["r_lat"])),
        ("text", c("line"), c("r_line"), None),
    ]
    return prices.ranked_match(left, right, "c_custkey", "s_suppkey", steps)


@query("""
WITH e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS t, event_id AS seq, event_type = 'purchase' AND event_id % 50 = 0 AS finish, CASE WHEN event_id % 13 > 0 THEN 'p' || event_id % 47 END AS provider FROM events),
s AS (SELECT job, min(t) AS started, min(CASE WHEN finish THEN {'t': t, 's': seq} END) AS fin FROM e GROUP BY 1),
o AS (SELECT job, provider, min({'t': t, 's': seq}) AS came, any_value(started) AS started FROM e JOIN s USING (job) WHERE NOT finish AND provider IS NOT NULL AND (fin IS NULL OR {'t': t, 's': seq} < fin) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY came, provider) AS k FROM o),
g AS (SELECT job, count(*) AS n, min(CASE WHEN k = 1 THEN came.t - started END) AS first_ms, min(CASE WHEN k = 6 THEN came.t - started END) AS sixth_ms, string_agg(provider, ',' ORDER BY k) FILTER (WHERE k <= 30) AS shown FROM r GROUP BY 1)
SELECT s.job, coalesce(n, 0) AS n, first_ms, sixth_ms, fin IS NOT NULL AS done, coalesce(shown, '') AS shown FROM s LEFT JOIN g USING (job)""")
def q141_partial_results(t, spark):
    """A job's snapshot: its distinct providers in order of arrival, capped, with the first and the sixth latency; the stream gives the same."""
    finish = (F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)
    provider = F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("p"), F.col("event_id") % 47))
    events = t("events").select(F.col("user_id").alias("job"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"), F.when(finish, "finish").otherwise("row").alias("action"), provider.alias("provider"))
    return keyed.partial_results_batch(events).withColumn("shown", F.concat_ws(",", "shown"))


@query("""
WITH e AS (SELECT user_id AS client, epoch_us(ts) // 1000 AS t, event_id AS seq, event_id % 3 = 0 AS f, event_type AS market, event_id // 7 % 40 AS fs, event_id % 11 AS ds, event_id % 2 AS shown FROM events),
a AS (SELECT *, max(CASE WHEN f THEN fs END) OVER (PARTITION BY client ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
b AS (SELECT *, f AND coalesce(fs > top, true) AS taken FROM a),
c AS (SELECT *, last_value(CASE WHEN taken THEN market END IGNORE NULLS) OVER (PARTITION BY client ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM b),
d AS (SELECT *, coalesce(NOT f AND fs = top AND market = front, false) AS fits FROM c),
g AS (SELECT *, coalesce(max(CASE WHEN fits THEN ds END) OVER (PARTITION BY client, top ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d)
SELECT client, t AS ts_ms, CASE WHEN f THEN 'focus' ELSE 'display' END AS action, market, CASE WHEN f THEN taken ELSE fits AND ds > seen END AS accepted,
  CASE WHEN (f AND taken) OR (NOT f AND fits AND ds > seen) THEN NULL WHEN f THEN 'stale_focus' WHEN top IS NULL THEN 'unknown_client' WHEN fits THEN 'stale_display' ELSE 'stale_focus' END AS reason, NOT f AND fits AND ds > seen AND shown > 0 AS ready FROM g""")
def q142_display_acknowledgement(t, spark):
    """L4: display reports count for the client's current focus alone, in rising order; the stream gives the same."""
    e = F.col("event_id")
    events = t("events").select(F.col("user_id").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), e.alias("seq"), F.when(e % 3 == 0, "focus").otherwise("display").alias("action"), F.col("event_type").alias("market"), (F.floor(e / 7) % 40).alias("focus_seq"), (e % 11).alias("display_seq"), (e % 2).alias("shown"))
    return keyed.acknowledged_batch(events)


@query("""
WITH o AS (SELECT o_orderkey AS k, 1 + o_orderkey % 3 AS version, o_orderstatus = 'P' AS deleted, o_totalprice AS price FROM orders),
c AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS version, l_returnflag = 'R' AS deleted, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, deleted DESC, price DESC) AS r FROM c),
m AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL OR n.version <= o.version THEN {'v': o.version, 'd': o.deleted, 'p': o.price} ELSE {'v': n.version, 'd': n.deleted, 'p': n.price} END AS x FROM o FULL JOIN (SELECT * FROM n WHERE r = 1) n ON o.k = n.k)
SELECT k, x.v AS version, x.d AS deleted, round(x.p, 2) AS price FROM m""")
def q143_mirror(t, spark):
    """A mirror after changes that also delete: the greatest version of a key wins, stale writers are refused, tombstones stay."""
    k = F.col("o_orderkey")
    old = t("orders").select(k.alias("k"), (1 + k % 3).cast("long").alias("version"), (F.col("o_orderstatus") == "P").alias("deleted"), F.col("o_totalprice").alias("price"))
    changes = t("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("version"), (F.col("l_returnflag") == "R").alias("deleted")).agg(F.max("l_extendedprice").alias("price"))
    return jobs.merge_versions(old, changes, ["k"]).withColumn("price", F.round("price", 2))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
k AS (SELECT *, length(host) % 4 AS k FROM u)
SELECT page_id, CASE k WHEN 0 THEN NOT (starts_with(path, '/fr/') OR starts_with(path, '/en/')) OR starts_with(path, '/en/1') WHEN 1 THEN NOT (starts_with(path, '/') AND ends_with(path, '.html')) OR starts_with(path, '/de/') AND length(path) > 999
  WHEN 2 THEN NOT starts_with(path, '/es/') ELSE true END AS allowed FROM k""")
def q144_robots(t, spark):
    """Whether robots rules let a page be read: groups of agents, the longest rule, stars and ends."""
    files = [
        "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nDisallow: /en/ # most\nAllow: /en/1\nDisallow:\nSitemap: https://x.example/s.xml",
        "User-agent: *\nDisallow: /*.html$\n", "User-agent: Bot\nUser-agent: other\nDisallow: /es/\nUser-agent: *\nDisallow: /", "Disallow: /",
    ]
    host, path = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1)
    rows = t("pages").select("page_id", path.alias("path"), F.element_at(F.array(*map(F.lit, files)), (F.length(host) % 4 + 1).cast("int")).alias("robots"))
    rows = rows.withColumn("rules", identity.robots_rules(F.col("robots"), "bot"))
    return rows.select("page_id", identity.robots_allow(F.col("rules"), F.col("path")).alias("allowed"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type, value FROM events),
s AS (SELECT user_id, user_id % 8 AS k, count_if(event_type = 'view') AS venues, count_if(event_type = 'click' AND value > 40) AS services, count_if(event_type = 'purchase' AND value > 45) AS prices, count_if(event_type = 'error' AND value > 30) AS providers, max(t) AS last FROM e GROUP BY 1),
n AS (SELECT *, max(last) OVER () + 600000 AS now FROM s),
f AS (SELECT *, CASE WHEN prices > 0 AND providers > 0 THEN 'complete' WHEN venues > 0 OR services > 0 THEN 'partial' ELSE 'empty' END AS ended FROM n),
x AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'running' WHEN 2 THEN 'empty' WHEN 3 THEN 'failed' WHEN 4 THEN 'complete' ELSE ended END AS status FROM f),
r AS (SELECT *, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'running' THEN CASE WHEN now - last < 2700000 THEN 'already_running' ELSE 'stale_running' END
  WHEN status = 'complete' AND NOT (prices > 0 AND providers > 0) THEN CASE WHEN now - last < 1800000 THEN 'empty_cooldown' ELSE 'complete_but_empty' END
  WHEN status = 'complete' THEN CASE WHEN now - last < 604800000 THEN 'ttl_fresh' ELSE 'ttl_expired' END
  WHEN status IN ('empty', 'partial') THEN status || CASE WHEN now - last < 1800000 THEN '_cooldown' ELSE '_retry' END ELSE status END AS reason FROM x),
d AS (SELECT *, CASE WHEN k = 7 THEN 'failed' WHEN k IN (3, 6) THEN 'failed' WHEN prices <= 0 AND venues <= 0 THEN 'thin' WHEN prices <= 0 THEN 'partial' WHEN venues < 15 OR prices < 4 THEN 'partial' ELSE 'complete' END AS finished FROM r)
SELECT user_id, ended, reason, reason NOT IN ('already_running', 'empty_cooldown', 'partial_cooldown', 'ttl_fresh') AS start, finished, CAST(CASE WHEN k = 3 THEN 21600000 WHEN k = 6 THEN 1800000 WHEN finished = 'thin' THEN 86400000 END AS INTEGER) AS retry_ms FROM d""")
def q145_import_cycle(t, spark):
    """How a market's import and discovery end, and whether the next import starts, from states that events leave."""
    e = t("events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    of = lambda kind, least: F.count_if((F.col("event_type") == kind) & (F.col("value") > least))
    s = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("venues"), of("click", 40).alias("services"), of("purchase", 45).alias("prices"), of("error", 30).alias("providers"), F.max("t").alias("last"))
    s = s.withColumn("now", F.lit(e.agg(F.max("t")).first()[0]).cast("long") + 600_000)  # one number
    k = F.col("user_id") % 8
    ended = jobs.import_status(F.col("venues"), F.col("services"), F.col("prices"), F.col("providers"))
    status = F.when(k == 0, None).when(k == 1, "running").when(k == 2, "empty").when(k == 3, "failed").when(k == 4, "complete").otherwise(ended)
    s = s.withColumns({"ended": ended, "status": status})
    next_import = jobs.import_decision(F.col("now"), F.col("status"), F.col("last"), F.col("last"), F.col("prices"), F.col("providers"))
    done = jobs.discovery_finished(k != 7, F.col("venues") < 15, F.col("venues"), F.col("prices"), F.when(k == 3, "quota").when(k == 6, "timeout"))
    return s.select("user_id", "ended", next_import["reason"].alias("reason"), next_import["start"].alias("start"), done["status"].alias("finished"), done["retry_ms"].alias("retry_ms"))
