"""Named queries of sources and extraction: pages, listings and price files made from the driver's tables by kinds, beside SQL that
states what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.plans.catalog import dealt, query
from offerlens.plans.trust import values
from offerlens.sources import curated
from offerlens.sources import pages as page_source
from offerlens.streaming import jobs

#: A page ({a}: the row's amount) and its evidence: method, label, what is added to the amount, currency.
PAGES = [
    ('<script type="application/ld+json">{"@graph":[{"name":"Peel","offers":{"price":"{a}","priceCurrency":"EUR"}}]}</script>', [("json_ld", "Peel", 0, "EUR")]),
    ("<table><tr><th>Service</th><th>Price (EUR)</th><th>USD</th></tr><tr><td>Lips</td><td>{a}</td><td>9999</td></tr><tr><td>Free</td><td>-</td><td>1</td></tr></table>", [("currency_table", "Lips", 0, "EUR")]),
    ("<table><tr><th>Service</th><th>Before</th><th>Now</th></tr><tr><td>Lips</td><td>€999</td><td>€{a}</td></tr></table>", [("table", "Lips", 0, "EUR")]),
    ('<script type="application/json">{"product":{"title":"Serum","variants":[{"title":"30 ml","price":{a}00},{"title":"Default Title","price":"{a}.50"}]}}</script>', [("product", "Serum - 30 ml", 0, None), ("product", "Serum", 0.5, None)]),
    ('<div class="product-card"><h3>Mask</h3><img src="x"><span class="price"><del>€999</del><ins>€{a}</ins></span></div>', [("product", "Mask", 0, "EUR"), ("text", "Mask", 0, "EUR")]),
    ("<nav><li>Menu €1</li></nav><ul><li>Deep peel - €{a}</li></ul><footer><p>Call €5</p></footer>", [("list", "Deep peel", 0, "EUR")]),
    ("<p>Opening hours 9-17</p>", []),
    ("<h2>Peels</h2><p>Light: £{a}</p><p>light: £{a}</p>", [("text", "Light", 0, "GBP")]),
    ("<table><tr><th>Service</th><th>Price</th></tr><tr><td>Brows</td><td>{a} TRY</td></tr></table><p>€{a}</p>", [("table", "Brows", 0, "TRY")]),
    ("<table><tr><th>Service</th><th>Prices by country</th></tr><tr><td>Lips</td><td>€{a}</td></tr></table><ul><li>Peel - €{a}</li></ul>", [("list", "Peel", 0, "EUR")]),
    ("<section><div><h3>Bring a friend</h3><p>Peel for both: €99</p></div><p>Peel: €{a}</p></section>", [("text", "Peel", 0, "EUR")]),
]
PAGE_ROWS = [(k, n, *r) for k, (_, rows) in enumerate(PAGES) for n, r in enumerate(rows)]


def kind_pages(t, spark, templates, url="https://rose.example/prices"):
    """A page for each part, by kind."""
    table = spark.createDataFrame(list(enumerate(templates)), "kind int, html string")
    rows = dealt(t("part"), "p_partkey").select("p_partkey", (F.col("p_size") + 100).cast("string").alias("a"), F.pmod("p_partkey", F.lit(len(templates))).cast("int").alias("kind"))
    return rows.join(F.broadcast(table), "kind").select(F.col("p_partkey").alias("page_id"), F.lit(url).alias("url"), F.replace("html", F.lit("{a}"), F.col("a")).alias("html"))  # a row a kind


@query("WITH k(kind, ord, method, label, more, currency) AS (" + values(PAGE_ROWS) + f""")
SELECT p_partkey AS page_id, CAST(ord AS INTEGER) AS ord, method, label, CAST(p_size + 100 + more AS DOUBLE) AS amount, currency FROM part JOIN k ON kind = p_partkey % {len(PAGES)}""")
def q40_page_evidence(t, spark):
    """JSON-LD, currency tables, tables, shop products, cards, lists and paragraphs of pages of eleven kinds; comparison tables and companion offers go."""
    return page_source.evidence(kind_pages(t, spark, [h for h, _ in PAGES])).select("page_id", "ord", "method", "label", "amount", "currency")


ASSEMBLED = [
    ("<p>Light peel: €{a}</p>", "Light peel: €{a}", None), ("<p>gift voucher: €{a}</p>", "gift voucher: €{a}", "non_treatment_label"), ("<p>I paid €{a}</p>", "I paid €{a}", "patient_anecdote"),
    ("<p>" + "long words " * 40 + "Peel: €{a}</p>", None, None), ("<p>flights €{a}</p>", "flights €{a}", "travel_cost_not_procedure"),
]


@query("WITH k(kind, span, reason) AS (" + values([(k, *r[1:]) for k, r in enumerate(ASSEMBLED)]) + f""")
SELECT p_partkey AS page_id, replace(span, '{{a}}', CAST(p_size + 100 AS VARCHAR)) AS raw_evidence, reason AS reject_reason, 'official_price_list' AS context FROM part JOIN k ON kind = p_partkey % {len(ASSEMBLED)}""")
def q101_assembled_evidence(t, spark):
    """Evidence with its shrunk span, the page's context and the first reason against it. Spans of over 240 characters are cut."""
    got = page_source.assembled(kind_pages(t, spark, [r[0] for r in ASSEMBLED]))
    long = F.length("raw_evidence") >= page_source.SPAN // 2
    return got.select("page_id", F.when(~long, F.col("raw_evidence")).alias("raw_evidence"), "reject_reason", "context")


MARKDOWN = [("# Menu\n\n| Service | Price |\n|---|---:|\n| **Lips** | €{a} |", "table", "Lips"), ("## Peels\n- Light peel - €{a}\n- [none](https://x)", "list", "Light peel"), ("Brows: €{a}\n\n1. no price", "text", "Brows")]


@query("WITH k(kind, method, label) AS (" + values([(k, *r[1:]) for k, r in enumerate(MARKDOWN)]) + f") SELECT p_partkey AS page_id, method, label, CAST(p_size + 100 AS DOUBLE) AS amount FROM part JOIN k ON kind = p_partkey % {len(MARKDOWN)}")
def q102_markdown_pages(t, spark):
    """Markdown tables, lists and paragraphs as HTML, then their evidence."""
    pages = kind_pages(t, spark, [r[0] for r in MARKDOWN]).withColumn("html", page_source.html_of_markdown("html"))
    return page_source.evidence(pages).select("page_id", "method", "label", "amount")


@query("""
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size + 100 AS VARCHAR) END AS a, CASE WHEN p_partkey % 3 = 0 THEN '"x, \\"}"' END AS b, CASE WHEN p_partkey % 3 = 0 THEN 3 WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS n FROM part""")
def q103_script_literals(t, spark):
    """Literal arguments of a page's state function, read without running it; reading ends at what is no literal."""
    pages = kind_pages(t, spark, ['<script>window.STATE=(function(a,b,c){return {x:a,y:"}",z:[b,c]}}({a},"x, \\"}",void 0));</script>', "<script>window.STATE = function(a,b){ return {x:a} }({a}, call())</script>", "<script>run()</script>"])
    got = pages.withColumn("m", page_source.literals_of("window.STATE")("html"))
    return got.select("page_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"), F.size("m").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2024-03-05' WHEN 2 THEN DATE '2023-01-02' END AS day, CAST(p_partkey % 5 = 1 AS BOOLEAN) AS same_menu FROM part""")
def q104_menu_date(t, spark):
    """The date a menu row is bound to, and whether two menus differ by their dates alone."""
    menus = ["Menu 2023-01-02\nPeel €90 (2024-03-05)", "Menu 5.3.2024\nPeel €90", "Menu 02.01.2023\nx\nPEEL €90\n2024-03-05", "Menu 2024-02-30\nPeel", "Menu 2024-03-05"]
    menu = F.element_at(F.array(*map(F.lit, menus)), (F.pmod("p_partkey", F.lit(len(menus))) + 1).cast("int"))
    same = page_source.menu_fingerprint(menu) == page_source.menu_fingerprint(F.lit("Menu 2020-10-10\n peel  €90"))
    return t("part").select("p_partkey", page_source.menu_date(menu, F.lit("Peel")).alias("day"), same.alias("same_menu"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Face' WHEN 1 THEN 'Laser' END AS "group", CASE p_partkey % 4 WHEN 0 THEN 'Peel' WHEN 1 THEN 'small' ELSE 'Lips' END AS name, CASE p_partkey % 4 WHEN 1 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS amount
FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, NULL, 'Flat', NULL FROM part WHERE p_partkey % 4 = 0""")
def q105_flat_services(t, spark):
    """Services of listings in three shapes, flattened; what is no JSON has none."""
    k, n = F.pmod("p_partkey", F.lit(4)), F.col("p_size").cast("string")
    listing = F.when(k == 0, F.concat(F.lit('{"categories":[{"name":"Face","services":[{"name":"Peel","price":"'), n, F.lit(' EUR"}]}],"services":[{"name":"Flat"}]}')))
    listing = listing.when(k == 1, F.concat(F.lit('{"services":[{"name":"Laser","items":[{"name":"small","priceValue":'), n, F.lit(".5}]}]}"))).when(k == 2, F.concat(F.lit('{"services":[{"name":"Lips","priceValue":'), n, F.lit("}]}"))).otherwise("none")
    return page_source.flatten_services(t("part").select("p_partkey", listing.alias("j")), "p_partkey", "j").select("p_partkey", "group", "name", "amount")


def price_files(t):
    """A price file for each part: one provider with four services, of which one conflicts and one is skipped."""
    p = F.col("p_retailprice")

    def service(**given):
        fields = [F.lit(None).cast("double" if c in curated.NUMBERS else "string").alias(c) if c not in given else given[c].cast("double" if c in curated.NUMBERS else "string").alias(c) for c in [*curated.TEXTS, *curated.NUMBERS]]
        return F.struct(*fields)

    services = F.array(
        service(name=F.lit("Peel"), price=p, source_url=F.lit("https://rose.example/prices/peel"), unit=F.lit("per 2 areas")),
        service(name=F.lit("Peel"), price=p + 5, source_url=F.lit("https://rose.example/"), unit=F.lit("per 2 areas")),
        service(name=F.lit("Lips"), price_min=p, price_max=p * 2, source_url=F.lit("https://rose.example/lips"), currency=F.lit("EUR")),
        service(name=F.lit("Skipped"), source_url=F.lit("https://rose.example/x")),
    )
    place = F.struct(F.lit("1 Road").alias("address"), F.col("p_brand").alias("city"), F.lit(None).cast("string").alias("country"), F.when(F.col("p_size") % 2 == 0, "ca").alias("country_code"), F.lit("").alias("zip"))
    rating = F.when(F.col("p_size") % 3 == 0, F.struct(F.lit(4.5).alias("value"), F.lit(10).cast("long").alias("review_count")))
    clinic = F.struct(F.concat(F.lit("Rose "), F.col("p_partkey")).alias("name"), F.lit("https://www.rose.example").alias("website"), F.lit(None).cast("string").alias("phone"), place.alias("location"), rating.alias("rating"), F.array(F.lit("x")).alias("source_urls"), services.alias("procedures"))
    return dealt(t("part"), "p_partkey").select(F.lit("2024-01-01").alias("checked_at"), F.lit("market").alias("market"), F.lit("CAD").alias("currency_default"), F.array(clinic).alias("clinics"))


@query("""
WITH s AS (SELECT p_partkey, p_brand, p_size, p_retailprice AS p FROM part)
SELECT 'Rose ' || p_partkey AS provider, service_name, round(CASE WHEN service_name = 'Skipped' THEN NULL ELSE amount END, 2) AS amount, CASE WHEN service_name = 'Skipped' THEN 'no_numeric_price' END AS skip_reason, price_type, currency,
  CASE WHEN p_size % 2 = 0 THEN 'CA' ELSE 'US' END AS country_code, '1 Road, ' || p_brand AS address, CASE WHEN p_size % 3 = 0 THEN 4.5 ELSE 0 END::DOUBLE AS rating
FROM s, LATERAL (VALUES ('Peel', p, 'per_area', 'CAD'), ('Peel', p + 5, 'per_area', 'CAD'), ('Lips', p, 'range', 'EUR'), ('Skipped', 0, 'fixed', 'CAD')) v(service_name, amount, price_type, currency)""")
def q106_curated_offers(t, spark):
    """Price files flattened to offers with their provider's attributes, or a reason to skip them."""
    got = curated.offers(curated.exploded(price_files(t)))
    return got.select("provider", "service_name", F.round("amount", 2).alias("amount"), "skip_reason", "price_type", "currency", "country_code", "address", "rating")


@query("""
SELECT 'Rose ' || p_partkey AS provider, service_name, round(p_retailprice, 2) AS amount, CAST(n AS BIGINT) AS n_rows, CAST(n AS BIGINT) AS n_prices FROM part, (VALUES ('Peel', 2), ('Lips', 1)) v(service_name, n)""")
def q107_curated_winners(t, spark):
    """One offer an identity, from the deeper source; with its conflicts."""
    won = curated.winners(curated.offers(curated.exploded(price_files(t))).filter("skip_reason is null"))
    return won.select("provider", "service_name", F.round("amount", 2).alias("amount"), "n_rows", "n_prices")


@query("""
SELECT p_partkey AS service_id, o AS ord, CASE o WHEN 0 THEN p_name ELSE p_name || ' - ' || v END AS label, CASE o WHEN 0 THEN p_retailprice ELSE p_retailprice * o END AS amount
FROM part, (VALUES (CAST(0 AS BIGINT), ''), (1, 'small'), (2, 'large')) x(o, v) WHERE NOT (o = 0 AND p_size % 2 = 0) AND NOT (o = 2 AND p_size % 3 = 0)""")
def q108_variants(t, spark):
    """A service and its variants as one row a priced item; no price is ever inherited."""
    p = F.col("p_retailprice")
    variants = F.array(F.struct(F.lit("small").alias("name"), p.alias("price")), F.struct(F.lit("large").alias("name"), F.when(F.col("p_size") % 3 != 0, p * 2).alias("price")))
    services = t("part").select(F.col("p_partkey").alias("service_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 != 0, p).alias("price"), variants.alias("variants"))
    return page_source.expand_variants(services)


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def q109_page_text(t, spark):
    """The text of pages, without tags."""
    return t("pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("""
WITH e AS (SELECT user_id AS client_id, event_id * 7 % 100 AS seq, epoch_ms(ts) AS ts_ms, event_type AS market_key, event_id FROM events),
f AS (SELECT *, coalesce(seq > max(seq) OVER (PARTITION BY client_id ORDER BY ts_ms, seq, market_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM e),
l AS (SELECT client_id, arg_max(market_key, (seq, ts_ms)) AS front FROM f WHERE accepted GROUP BY 1)
SELECT DISTINCT f.client_id, market_key, CASE WHEN market_key = front THEN 100 ELSE 70 END AS priority FROM f JOIN l USING (client_id) WHERE accepted""")
def q110_focus(t, spark):
    """L4: a client's focus moves by a rising sequence, stale events are ignored; the market in front counts 100, those before it 70."""
    events = t("events").select(F.col("user_id").alias("client_id"), (F.col("event_id") * 7 % 100).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("market_key"))
    return jobs.focus_priorities(jobs.focus(events))
