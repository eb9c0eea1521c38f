"""Named queries of sanity, matching and binding operators. Their texts are made from the driver's tables by kinds; the SQL states
for each kind what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import matching, sanity, text
from offerlens.operators import rank, resolve
from offerlens.plans.catalog import dealt, query

LATE_RULES = [("other_technique", r"\bhair\b", r"\bstrip\b", "")]
FAMILY_RULES = [("hair_adjunct", r"\bhair\b", r"\b(?:prp|minoxidil)\b", r"\btransplant\b"), ("partial_treatment", r"\bnose\b", r"\btip only\b", r"\bprimary\b")]
#: price text, text around, label, url, method, requested, amount (None: the row's own, written for {a}), upper amount, currency, expected reason.
KINDS = [
    ("€{a}", "Peel €{a}", "Peel", "https://rose.example/prices", "table", "peel", None, None, "EUR", None),
    ("", "", "Peel", "https://rose.example/prices", "table", "peel", 0.0, None, "EUR", "missing_price_semantics"),
    ("€{a}", "average price: prices by country €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "market_comparison_table"),
    ("€{a}", "Add to cart €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "product_not_procedure"),
    ("€{a}", "flights and hotel nights €{a}", "Stay", "https://rose.example/x", "table", "peel", None, None, "EUR", "travel_cost_not_procedure"),
    ("2024", "How much is it in 2024? €90", "Peel", "https://rose.example/x", "table", "peel", 2024.0, None, "EUR", "calendar_year_not_price"),
    ("€{a}", "Hyaluron serum €{a}", "Serum", "https://rose.example/x", "table", "filler", None, None, "EUR", "topical_product_not_injectable"),
    ("€{a}", "needle-free lips €{a}", "Lips", "https://rose.example/x", "table", "filler", None, None, "EUR", "needleless_not_injectable"),
    ("€{a}", "Lips €{a}", "Lips", "https://city-nails.example/x", "table", "filler", None, None, "EUR", "technique_unverified"),
    ("€{a}", "credit up to €{a} with a loan", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "financing_credit_limit"),
    ("€{a}", "the average price is €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "market_price_quote"),
    ("€{a}", "PRP for hair €{a}", "PRP", "https://rose.example/x", "table", "hair", None, None, "EUR", "hair_adjunct"),
    ("€{a}", "hair transplant and PRP €{a}", "Hair", "https://rose.example/x", "table", "hair", None, None, "EUR", None),
    ("€{a}", "Peel €{a}", "Peel", "https://market.example/search/peels", "table", "peel", None, None, "EUR", "marketplace_category"),
    ("€{a}", "Gift voucher €{a}", "Voucher", "https://rose.example/x", "table", "peel", None, None, "EUR", "non_treatment_label"),
    ("€{a}", "Peel €{a}", "Peel", "https://rose.example/blog/peels", "text", "peel", None, None, "EUR", "not_owned_price"),
    ("€{a}", "our price for a peel: €{a}", "Peel", "https://rose.example/blog/peels", "text", "peel", None, None, "EUR", None),
    ("€{a}", "theme preview €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "theme_placeholder"),
    ("from $399.95", "Peel from $399.95", "Peel", "https://rose.example/x", "table", "peel", 399.95, None, "USD", "theme_placeholder"),
    ("${a}", "Peel ${a}", "Peel", "https://rose.example.uk/x", "table", "peel", None, None, "USD", "tld_currency_mismatch"),
    ("+44 20 7946 0958", "Call +44 20 7946 0958", "Peel", "https://rose.example/x", "text", "peel", 7946.0, None, "GBP", "phone_number"),
    ("₺50000000", "Peel ₺50000000", "Peel", "https://rose.example/x", "table", "peel", 50000000.0, None, "TRY", "implausible_digits"),
    ("₩50000000", "Peel krw 50000000", "Peel", "https://rose.example/x", "table", "peel", 50000000.0, None, "KRW", None),
    ("{a} Main Street", "{a} Main Street", "Peel", "https://rose.example/x", "text", "peel", None, None, "EUR", "address_number"),
    ("{a} minutes", "Peel, {a} minutes", "Peel", "https://rose.example/x", "text", "peel", None, None, "", "duration"),
    ("€{a}", "Peel €{a}, 45 minutes", "Peel", "https://rose.example/x", "text", "peel", None, None, "EUR", None),
    ("{a}% off", "Peel {a}% off", "Peel", "https://rose.example/x", "text", "peel", None, None, "", "percent_without_currency"),
    ("{a}", "{a} reviews", "Peel", "https://rose.example/x", "text", "peel", None, None, "", "review_count"),
    ("2021", "opened 2021", "Peel", "https://rose.example/x", "text", "peel", 2021.0, None, "", "bare_year"),
    ("{a}", "Peel {a}", "Peel", "https://rose.example/x", "text", "peel", None, None, "", "no_price_semantics"),
    ("{a}", "Peel {a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "", None),
    ("{a} grafts", "a session of {a} grafts", "Hair", "https://rose.example/x", "table", "hair", None, None, "", "unit_count"),
    ("€{a}", "Peel €{a}", "Peel", "https://rose.example/financing", "table", "peel", None, None, "EUR", "finance_page"),
    ("€{a}/month", "Peel €{a}/month", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "monthly_financing"),
    ("about €{a}", "Peel about €{a}", "Peel", "https://rose.example/x", "text", "peel", None, None, "EUR", "approximate_quote"),
    ("€{a}", "series of 4 €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "larger_package"),
    ("£5,000 - £8,000", "Nose £5,000 - £8,000", "Nose", "https://rose.example/x", "table", "nose", 5000.0, 8000.0, "GBP", "market_price_spread"),
    ("€{a}", "I paid €{a}", "Peel", "https://rose.example/x", "text", "peel", None, None, "EUR", "patient_anecdote"),
    ("€{a}", "elsewhere €{a}", "Peel", "https://rose.example/x", "text", "peel", None, None, "EUR", "competitor_quote"),
    ("€{a} per graft", "€{a} per graft", "Hair", "https://rose.example/x", "table", "hair", None, None, "EUR", "implausible_per_unit"),
    ("€9999", "Peel €9999", "Peel", "https://rose.example/x", "table", "peel", 9999.0, None, "EUR", "implausible_amount"),
    ("€{a}", "flights for 2 people €{a}", "Stay", "https://rose.example/x", "table", "peel", None, None, "EUR", "travel_cost_not_procedure"),
    ("€{a}.50", "hotel | Peel €{a}.50", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", None),
    ("€{a}", "date:future", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "future"), ("€{a}", "date:missing", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "missing"),
    ("€{a}", "date:ambiguous", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "ambiguous"), ("€{a}", "date:invalid", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "invalid"),
    ("€{a}", "currency:viewer", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "currency_provenance"),
    ("€{a}", "patients ask: peel €{a}", "Peel", "https://rose.example/questions/7", "table", "peel", None, None, "EUR", "medical_question"),
    ("€{a}", "Peel €{a}", "Peel", "https://www.cliniclist.example/x", "table", "peel", None, None, "EUR", "directory_or_agency_price"),
    ("€{a}", "our price: peel €{a}", "Peel", "https://rose.example/price-in-rome", "table", "peel", None, None, "EUR", "market_information"),
    ("€9000", "2 grafts for €9000", "Hair", "https://rose.example/x", "table", "hair", 9000.0, None, "EUR", "effective_per_graft"),
    ("€{a}", "hair transplant by strip €{a}", "Hair", "https://rose.example/x", "table", "hair", None, None, "EUR", "other_technique"),
    ("€{a}", "usually €{a}, our price", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", None), ("€{a}", "usually €{a}", "Peel", "https://rose.example/x", "table", "peel", None, None, "EUR", "market_average"),
]


def values(rows) -> str:
    """Rows as SQL VALUES."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def kinds_offer(t, spark):
    """part rows with the texts of their kind, and their columns as an Offer."""
    names = "price, text, label, url, method, requested, fixed, upper, currency, expected"
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(KINDS)], "kind int, " + ", ".join(f"{n} {'double' if n in ('fixed', 'upper') else 'string'}" for n in names.split(", ")))
    rows = dealt(t("part"), "p_partkey").select("p_partkey", F.pmod("p_partkey", F.lit(len(KINDS))).cast("int").alias("kind"), (F.col("p_size") * 10 + 200).cast("double").alias("own")).join(F.broadcast(table), "kind")  # a row a kind
    amount = F.coalesce("fixed", "own")
    filled = lambda c: F.replace(F.col(c), F.lit("{a}"), F.col("own").cast("long").cast("string"))
    rows = rows.select("p_partkey", amount.alias("amount"), filled("price").alias("price"), filled("text").alias("text"), "label", "url", "method", "requested", "upper", "currency")
    rows = rows.withColumn("found", sanity.places(F.col("price"), F.col("text")))
    offer = sanity.Offer(F.col("amount"), F.col("price"), F.col("text"), F.col("label"), F.col("currency"), F.col("url"), F.col("method"), F.col("upper"), F.col("requested"), F.lit("Rose"), F.lit(""), in_band=~F.col("amount").between(9000, 10000), date_failure=F.nullif(F.regexp_extract("text", r"^date:(\w+)$", 1), F.lit("")), currency_failure=F.nullif(F.regexp_extract("text", r"^currency:(\w+)$", 1), F.lit("")), found=F.col("found"))
    return rows, offer


POLICY = sanity.Policy(family_rules=FAMILY_RULES, late_rules=LATE_RULES, directory_hosts=["cliniclist.example"], dummies=[399.95])


@query("WITH k(kind, reason) AS (" + values([(k, r[-1]) for k, r in enumerate(KINDS)]) + f") SELECT p_partkey, reason FROM part JOIN k ON kind = p_partkey % {len(KINDS)}")
def q88_sanity_cascade(t, spark):
    """The ordered cascade of reasons over texts of 55 kinds."""
    rows, offer = kinds_offer(t, spark)
    return rows.select("p_partkey", sanity.reject_reason(offer, F.col("requested") == "filler", POLICY).alias("reason"))


@query("WITH k(kind, reason) AS (" + values([(k, r[-1]) for k, r in enumerate(KINDS)]) + f""")
SELECT p_partkey, reason IS NOT NULL AND reason NOT IN ('missing_price_semantics', 'no_price_semantics', 'missing', 'ambiguous', 'invalid', 'future', 'currency_provenance') AS reselect FROM part JOIN k ON kind = p_partkey % {len(KINDS)}""")
def q89_reselect(t, spark):
    """Stored prices that must be chosen anew."""
    rows, offer = kinds_offer(t, spark)
    return rows.select("p_partkey", sanity.needs_reselect(offer, F.col("requested") == "filler", POLICY).alias("reselect"))


CONTEXTS = [
    ("https://a.example/x", "these prices are examples", "", "explicit_non_owned_prices", False), ("https://a.example/x", "this is not a clinic", "", "non_clinic_booking_platform", False),
    ("https://a.example/cost-of-peels-in-rome", "peels", "", "country_cost_guide", False), ("https://a.example/x", "compared to europe", "", "foreign_price_comparison", False),
    ("https://a.example/x", "compared with others", "", "comparison_article", False), ("https://a.example/x", "on average 90", "", "market_average", False),
    ("https://a.example/blog/x", "peels", "", "blog", False), ("https://a.example/blog/x", "at our clinic", "", "blog", True), ("https://a.example/price-list", "peels", "", "official_price_list", True),
    ("https://a.example/x", "our package is", "", "official_package_price", True), ("https://a.example/x", "starting at 90", "", "official_service_price", True), ("https://a.example/x", "peels", "90", "unknown", True),
]


@query("WITH k(kind, context, owned) AS (" + values([(k, r[3], "yes" if r[4] else "no") for k, r in enumerate(CONTEXTS)]) + f") SELECT p_partkey, context, owned = 'yes' AS owned FROM part JOIN k ON kind = p_partkey % {len(CONTEXTS)}")
def q90_page_context(t, spark):
    """The eleven kinds of page, and whether a price there is the provider's own."""
    table = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(CONTEXTS)], "kind int, url string, text string, title string")
    rows = t("part").select("p_partkey", F.pmod("p_partkey", F.lit(len(CONTEXTS))).cast("int").alias("kind")).join(F.broadcast(table), "kind")  # a row a kind
    context = sanity.page_context(F.col("url"), F.col("text"), F.col("title"))
    return rows.withColumn("context", context).select("p_partkey", "context", sanity.is_owned(F.col("context"), F.col("text")).alias("owned"))


VOCABULARY = [("filler", "lip_filler", 0.94, r"\blip (?:filler|gloss)\b"), ("filler", "filler", 0.94, r"\bfillers?\b"), ("laser", "laser", 0.9, r"\blasers?\b"), ("peel", "chemical_peel", 0.9, r"\bpeel(?:s|ing)?\b"), ("skin", "booster", 0.7, r"\bbooster\b")]
COMPETING = [("*", "wrong_family_financing", r"\b(?:financing|payment plan)\b"), ("filler", "wrong_family_lip_lift", r"\blip lift\b"), ("*", "wrong_family_consultation", r"\bconsultation\b")]
TOGETHER = [("skin", "peel")]
SUBTYPES, GENERIC = [("hair", r"\b(?:underarms?|bikini|legs?|hair removal)\b"), ("skin", r"\b(?:resurfacing|rejuvenation|pigment)\b")], r"^laser(?: treatments?)?$"
POOLS = {"filler": "fillers", "lip_filler": "lips", "laser:hair": "laser hair", "laser:skin": "laser skin"}
#: label, requested, family, canonical, confidence, rejected; subtype; pool, reason.
LABELS = [
    ("Lip-Filler 1 ml", "filler", "filler", "lip_filler", 0.94, None, "generic", "lips", None), ("Fïllers", "peel", "filler", "filler", 0.0, "wrong_family_filler", "generic", None, "wrong_family_filler"),
    ("Lip lift", "filler", "other", "", 0.0, "wrong_family_lip_lift", "generic", None, "wrong_family_lip_lift"), ("Laser underarms", "laser", "laser", "laser", 0.9, None, "hair", "laser hair", None),
    ("Laser  resurfacing", "laser", "laser", "laser", 0.9, None, "skin", "laser skin", None), ("Laser treatment", "laser", "laser", "laser", 0.9, None, "generic", None, "generic_subtype"),
    ("Laser legs and pigment", "laser", "laser", "laser", 0.9, None, "mixed", None, "no_pool_key"), ("Peeling", "skin", "peel", "chemical_peel", 0.9, None, "generic", None, "no_pool_key"),
    ("Booster", "skin", "skin", "booster", 0.7, None, "generic", None, "unknown_procedure"), ("Consultation for fillers", "filler", "other", "", 0.0, "wrong_family_consultation", "generic", None, "wrong_family_consultation"),
    ("", "filler", "other", "", 0.0, "empty_label", "generic", None, "empty"), ("Massage", "filler", "other", "", 0.0, None, "generic", None, "unknown_procedure"), ("Filler", "", "filler", "filler", 0.94, None, "generic", "fillers", None),
]


def labelled(t, spark):
    table = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(LABELS)], "kind int, label string, requested string")
    return dealt(t("part"), "p_partkey").select("p_partkey", F.pmod("p_partkey", F.lit(len(LABELS))).cast("int").alias("kind")).join(F.broadcast(table), "kind")  # a row a kind


@query("WITH k(kind, family, canonical, confidence, reject) AS (" + values([(k, *r[2:6]) for k, r in enumerate(LABELS)]) + f") SELECT p_partkey, family, canonical, CAST(confidence AS DOUBLE) AS confidence, reject FROM part JOIN k ON kind = p_partkey % {len(LABELS)}")
def q91_label_match(t, spark):
    """Labels to family, canonical name and confidence, with the reasons of competing families."""
    match = matching.label_match(F.col("label"), F.col("requested"), VOCABULARY, COMPETING, TOGETHER)
    return labelled(t, spark).select("p_partkey", *(c.alias(n) for n, c in match.items()))


@query("WITH k(kind, subtype, pool, reason) AS (" + values([(k, *r[6:9]) for k, r in enumerate(LABELS)]) + f""")
SELECT p_partkey, subtype, subtype = 'hair' OR subtype = 'mixed' AS fits_hair, pool, reason FROM part JOIN k ON kind = p_partkey % {len(LABELS)}""")
def q92_pool_decision(t, spark):
    """Subtypes of labels, and the pool a service goes to or why it goes to none."""
    match = matching.label_match(F.col("label"), F.col("requested"), VOCABULARY, COMPETING, TOGETHER)
    # as columns of their own: the decision names them many times, and would work each out as often
    rows = labelled(t, spark).select("p_partkey", "label", F.struct(*(c.alias(n) for n, c in match.items())).alias("match"), matching.subtype(F.col("label"), SUBTYPES, GENERIC).alias("kind"))
    match, kind = {n: F.col(f"match.{n}") for n in match}, F.col("kind")
    laser = F.when(match["family"] == "laser", kind)  # other families have no subtypes
    pool = matching.pool_decision(F.col("label"), match, F.coalesce(laser, F.lit("-")), POOLS, F.lit(True))
    return rows.select("p_partkey", kind.alias("subtype"), matching.subtype_fits(kind, F.lit("hair")).alias("fits_hair"), *(c.alias(n) for n, c in pool.items()))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag = 'R' AS part, round(l_discount + CASE WHEN l_linestatus = 'F' THEN 0.12 ELSE -0.1 END + CASE WHEN l_tax > 0.04 THEN 0.25 ELSE 0 END, 2) AS score FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, score, l_quantity, part) AS i FROM s),
f AS (
  WITH RECURSIVE g AS (
    SELECT l_orderkey, i, l_linenumber, l_quantity, part, score FROM n WHERE i = 1
    UNION ALL
    SELECT g.l_orderkey, n.i, CASE WHEN b THEN n.l_linenumber ELSE g.l_linenumber END, CASE WHEN b THEN n.l_quantity ELSE g.l_quantity END, CASE WHEN b THEN n.part ELSE g.part END, CASE WHEN b THEN n.score ELSE g.score END
    FROM g JOIN n ON n.l_orderkey = g.l_orderkey AND n.i = g.i + 1, LATERAL (SELECT n.score > g.score OR (n.score = g.score AND n.l_quantity < g.l_quantity AND NOT (n.part AND NOT g.part)) AS b))
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) AS last FROM g)
SELECT l_orderkey, l_linenumber, l_quantity, score FROM f WHERE last = 1""")
def q93_best_evidence(t, spark):
    """Scored evidence folded in order; of equal scores the cheaper wins unless it is only a part."""
    method = F.when(F.col("l_linestatus") == "F", "table").otherwise("text")
    score = F.round(matching.evidence_score(F.col("l_discount"), method, [(0.25, F.col("l_tax") > 0.04)]), 2)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_returnflag") == "R").alias("part"), score.alias("score"))
    return matching.best_evidence(rows.withColumn("line", F.col("l_linenumber")), ["l_orderkey"], ["l_linenumber"], "score", "l_quantity", "part", ["line"]).select("l_orderkey", F.col("line").alias("l_linenumber"), "l_quantity", "score")


@query("""
WITH l AS (SELECT o_orderkey, o_custkey % 50 AS k, floor(o_totalprice / 1000) AS a, floor(o_totalprice / 1000) + 5 AS b FROM orders),
r AS (SELECT c_custkey % 50 AS k, CAST(c_custkey % 400 AS DOUBLE) + CASE c_custkey % 3 WHEN 0 THEN 0.004 WHEN 1 THEN -0.004 ELSE 0.02 END AS c, CAST(c_custkey % 400 AS DOUBLE) + 5 AS d, c_mktsegment AS v FROM customer)
SELECT o_orderkey, CASE WHEN min(v) = max(v) THEN min(v) END AS bound, coalesce(min(v) <> max(v), false) AS ambiguous FROM l LEFT JOIN r ON l.k = r.k AND abs(a - c) <= 0.011 AND abs(b - d) <= 0.011 GROUP BY o_orderkey""")
def q94_tolerance_binding(t, spark):
    """Records bind to labels with both bounds within 0.011, by an equi-join on cells; several values are ambiguous."""
    a = F.floor(F.col("o_totalprice") / 1000).cast("double")
    labels = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), a.alias("low"), (a + 5).alias("high"))
    c, off = (F.col("c_custkey") % 400).cast("double"), F.element_at(F.array(F.lit(0.004), F.lit(-0.004), F.lit(0.02)), (F.col("c_custkey") % 3 + 1).cast("int"))
    records = t("customer").select((F.col("c_custkey") % 50).alias("k"), (c + off).alias("low"), (c + 5).alias("high"), "c_mktsegment")
    return resolve.tolerance_binding(labels, records, ["k"], "low", "high", "c_mktsegment").select("o_orderkey", "bound", "ambiguous")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '[?#].*$|/+$', '') AS u FROM pages),
l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'x.' || u ELSE u END AS u FROM a),
e AS (SELECT l.page_id, l.u, min(a.page_id) AS m FROM l LEFT JOIN a ON a.u = l.u GROUP BY ALL),
s AS (SELECT right(u, 24) AS s, min(page_id) AS m FROM a WHERE length(u) >= 24 GROUP BY 1)
SELECT e.page_id, coalesce(e.m, s.m) AS matched, CASE WHEN e.m IS NOT NULL THEN 'url' WHEN s.m IS NOT NULL THEN 'suffix' END AS how FROM e LEFT JOIN s ON e.m IS NULL AND length(e.u) >= 24 AND right(e.u, 24) = s.s""")
def q95_url_match(t, spark):
    """Venues by normalised url, else by its last 24 characters, the first of equals. Every third page is looked up under another host."""
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"://(?:www\.)?", "://x.")).otherwise(F.col("url"))
    return resolve.url_match(t("pages").select("page_id", url.alias("url")), t("pages").select(F.col("page_id").alias("other"), "url"), "page_id", "other").select("page_id", "matched", "how")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'id' WHEN o_custkey % 5 = 0 THEN 'name' WHEN o_custkey % 7 = 0 THEN 'old' END AS found_by FROM orders""")
def q96_first_by_chain(t, spark):
    """The first stored row along a chain of keys: id, name, previous revision."""
    k = F.col("o_custkey")
    keys = lambda d, c: d.select(F.concat(F.lit("id:"), c).alias("id"), F.concat(F.lit("name:"), c).alias("name"), F.concat(F.lit("old:"), c).alias("old"), c.alias("c"))
    every = keys(t("orders").select("o_custkey").distinct(), k)
    stored = every.filter("c % 3 = 0").select(F.col("id").alias("key"), F.lit("id").alias("found_by")).unionByName(every.filter("c % 5 = 0").select(F.col("name").alias("key"), F.lit("name").alias("found_by"))).unionByName(every.filter("c % 7 = 0").select(F.col("old").alias("key"), F.lit("old").alias("found_by")))
    wanted = t("orders").select("o_orderkey", "o_custkey")
    chain = [F.concat(F.lit(f"{kind}:"), k) for kind in ("id", "name", "old")]
    return resolve.first_by_chain(wanted, stored, "key", chain, "o_orderkey").select("o_orderkey", "found_by")


@query("""
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'unknown' END AS toxin, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'failed' ELSE toxin END AS toxin, CASE WHEN c_nationkey % 3 = 1 THEN 'failed' ELSE 'unknown' END AS filler, CASE WHEN c_nationkey % 3 = 2 THEN 3 ELSE 2 END AS n_families FROM a""")
def q97_map_patch(t, spark):
    """I10, K: a patch of one family's state on a map; other entries stay."""
    c = F.col("c_custkey")
    old = F.create_map(F.lit("toxin"), F.when(c % 2 == 0, "verified").otherwise("unknown"), F.lit("filler"), F.lit("unknown"))
    family = F.element_at(F.array(*map(F.lit, ("toxin", "filler", "peel"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    new = resolve.patch_map(old, family, F.lit("failed"))
    return t("customer").select("c_custkey", new["toxin"].alias("toxin"), new["filler"].alias("filler"), F.size(new).alias("n_families"))


@query("""
WITH e AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 7 + s_nationkey) % 4 AS exposure, s_suppkey % 5 = 0 AS sibling FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY exposure, sibling, md5('11|' || s_suppkey), s_suppkey) AS k FROM e)
SELECT s_nationkey, s_suppkey, CAST(exposure + CASE WHEN k <= 3 THEN 1 ELSE 0 END AS BIGINT) AS exposure, k <= 3 AS shown FROM r""")
def q98_fair_rotation(t, spark):
    """H9: of each market the rows that were shown least, those of a sibling tab behind others, equals drawn by a seed; with the exposures that the next run reads."""
    e = t("supplier").select("s_nationkey", "s_suppkey", ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 4).cast("long").alias("exposure"), (F.col("s_suppkey") % 5 == 0).alias("sibling"))
    return rank.rotated(e, ["s_nationkey"], "s_suppkey", 11, 3).select("s_nationkey", "s_suppkey", "exposure", "shown")


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'rose' || s_suppkey WHEN 1 THEN 'clinicthe' WHEN 2 THEN 'roseof' || s_suppkey ELSE 'ete' END AS packed, CASE s_suppkey % 4 WHEN 3 THEN 'ete' ELSE NULL END AS folded FROM supplier""")
def q99_packed_name(t, spark):
    """Provider names without generic words at their ends, in four folds."""
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("The Rose "), n, F.lit(" Clinic"))).when(k == 1, F.lit("Clinic The")).when(k == 2, F.concat(F.lit("Rose of "), n, F.lit(" Ltd."))).otherwise(F.lit("Été"))
    return t("supplier").select("s_suppkey", text.packed_name(name, ["the", "clinic", "ltd"]).alias("packed"), F.when(k == 3, text.fold_marks(name)).alias("folded"))


@query("""
SELECT c_nationkey, CASE WHEN count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'AUTO') >= 2 THEN round(min(c_acctbal) FILTER (c_acctbal > 0 AND c_mktsegment <> 'AUTO'), 2) END AS low, count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'AUTO') AS n FROM customer GROUP BY 1""")
def q100_comparable_rows(t, spark):
    """Only justified rows (a positive amount, a kind that compares) go into a summary of two rows or more."""
    good = (F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "AUTO")
    n = F.count_if(good)
    return t("customer").groupBy("c_nationkey").agg(F.when(n >= 2, F.round(F.min(F.when(good, F.col("c_acctbal"))), 2)).alias("low"), n.alias("n"))
