"""Who a row belongs to and whether it may be trusted: provider names, places, provenance, the trust gate, the pool sanitiser.

Word lists, host tables and rates are parameters. All native column builders; nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.rules import first_reason
from offerlens.functions.text import haversine_km, name_key, packed_name

#: Generic words at the ends of provider names; words of offers; market names; brand names of marketplaces.
GENERIC = ("the", "clinic", "centre", "center", "ltd", "llc", "medical", "of")
PRICE_WORDS = r"\b(?:prices?|costs?|fees?|offers?|discounts?|sale|deals?|free)\b"
MARKET_WORDS = r"\b(?:average|typical|market|guide|best|top \d+)\b"
SHOP_WORDS = r"^(?:shop|store|online shop|home|menu|booking|services?)$"
#: Ranks of sources, and ways of extraction that are never trusted.
SOURCE_RANKS = {"official": 40, "marketplace_a": 30, "verified_marketplace": 25, "marketplace_b": 20, "verified": 10}
UNTRUSTED_METHODS = r"^(?:ai_|llm|snippet|serp)"
PERMANENT = r"^(?:invalid_identity|wrong_business|not_a_provider|closed)"
TEMPORARY = r"(?:timeout|429|5\d\d|quota|blocked|unreachable)"


def empty(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def identity_reason(name: Column, host_class: Column, provider: Column, brands: Sequence[str] = ()) -> Column:
    """Why a name is no provider's: empty, an amount, an offer, a market's estimate, a generic shop, a marketplace's own brand, a
    publisher's page, or a marketplace page that names no provider; null for a good one."""
    key = name_key(F.coalesce(name, F.lit("")))
    return first_reason([
        ("empty_name", key == ""), ("price_like_name", key.rlike(r"^[\d ]+(?:usd|eur|gbp|try)?$") | F.coalesce(name, F.lit("")).rlike(r"[$€£₺]\s*\d")),
        ("offer_name", key.rlike(PRICE_WORDS)), ("market_estimate", key.rlike(MARKET_WORDS)), ("generic_shop", key.rlike(SHOP_WORDS)),
        ("marketplace_brand", key.isin(*brands) if brands else F.lit(False)), ("publisher_host", host_class == "publisher"),
        ("marketplace_without_provider", host_class.isin("marketplace", "directory") & empty(provider)),
    ])


def same_name(a: Column, b: Column, generic: Sequence[str] = GENERIC, least: int = 8) -> Column:
    """Packed names are equal, or the shorter one, of `least` characters or more, is in the longer."""
    return same_packed(packed_name(F.coalesce(a, F.lit("")), list(generic)), packed_name(F.coalesce(b, F.lit("")), list(generic)), least)


def same_packed(p: Column, q: Column, least: int = 8) -> Column:
    """same_name of names that are packed already."""
    short, long = F.when(F.length(p) <= F.length(q), p).otherwise(q), F.when(F.length(p) <= F.length(q), q).otherwise(p)
    return (p != "") & (q != "") & ((p == q) | ((F.length(short) >= least) & F.contains(long, short)))


def address_overlap(a: Column, b: Column) -> Column:
    """At least two words of three letters or more of the first address are in the second, or its only one."""
    return words_overlap(address_words(a), name_key(F.coalesce(b, F.lit(""))))


def address_words(address: Column) -> Column:
    """Words of three letters or more."""
    return F.filter(F.split(name_key(F.coalesce(address, F.lit(""))), " "), lambda w: F.length(w) >= 3)


def words_overlap(words: Column, key: Column) -> Column:
    """address_overlap of the first address's words and the second one's name_key."""
    hits = F.size(F.filter(words, lambda w: F.contains(key, w)))
    return (F.size(words) > 0) & (hits >= F.least(F.lit(2), F.size(words)))


def same_place(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, metres: float = 450) -> Column:
    return F.coalesce(haversine_km(lat_a, lon_a, lat_b, lon_b) * 1000 <= metres, F.lit(False))


def match_strength(name: Column, near: Column, address: Column, phone: Column) -> Column:
    """strong: the name and one more sign; weak: the name alone; else the name differs."""
    more = F.coalesce(phone, F.lit(False)) | F.coalesce(near, F.lit(False)) | F.coalesce(address, F.lit(False))  # the cheapest first
    return F.when(~F.coalesce(name, F.lit(False)), "name_mismatch").when(more, "strong").otherwise("weak_name_only")


def country_code(text: Column, currency: Column, aliases: dict[str, str], by_currency: dict[str, str], default: str = "US") -> Column:
    """A country's code from its name or alias, two letters as they are, else from the currency, else the default."""
    key = name_key(F.coalesce(text, F.lit("")))
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    return F.coalesce(F.element_at(table(aliases), key), F.when(key.rlike("^[a-z]{2}$"), F.upper(key)), F.element_at(table(by_currency), F.upper(F.trim(currency))), F.lit(default))


def locality(country: Column, city: Column, lat: Column, lon: Column, city_country: dict[str, str]) -> dict[str, Column]:
    """country (UK as GB, else by the city where it is missing), lat and lon (null unless both are finite and on the globe)."""
    by_city = F.element_at(F.create_map(*(F.lit(x) for pair in city_country.items() for x in pair)), name_key(F.coalesce(city, F.lit(""))))
    code = F.upper(F.trim(country))
    a, b = lat.try_cast("double"), lon.try_cast("double")
    sound = F.coalesce(a.between(-90, 90) & b.between(-180, 180) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
    return {"country": F.coalesce(F.when(code == "UK", F.lit("GB")), F.when(code.rlike("^[A-Z]{2}$"), code), by_city), "lat": F.when(sound, a), "lon": F.when(sound, b)}


def currency_failure(source_type: Column, basis: Column, currency: Column, source_host: Column, stable_host: str, stable_currency: str) -> Column:
    """Why a marketplace's currency can't be trusted: converted by the platform (but for one currency on one host), or shown in the
    viewer's."""
    market = source_type == "marketplace"
    return first_reason([("conversion_unstable", market & (basis == "platform_converted") & ~((source_host == stable_host) & (currency == stable_currency))), ("original_currency_unverified", market & (basis == "viewer_localized"))])


def freshness(age_days: Column, ttl: int, revision: Column, current: Column, usable: int = 0) -> Column:
    """fresh within the time to live and of the current revision, stale_usable within `usable` days, else expired."""
    same = F.coalesce(revision == current, F.lit(False))
    return F.when(same & (age_days <= ttl), "fresh").when(same & (age_days <= usable), "stale_usable").otherwise("expired")


def trust_reasons(identity: Column, status: Column, reverify: Column, flagged: Column, amount: Column, price_text: Column, label: Column, url: Column, currency: Column, relation: Column, provenance: Column, sane: Column, method: Column, source_type: Column) -> list[tuple[str, Column]]:
    """The trust gate: eleven reasons in the order in which they count."""
    verified = F.coalesce(flagged, F.lit(False)) | (status == "official_website")
    literal = (amount > 0) & ~empty(price_text) & ~empty(label) & ~empty(url) & ~empty(method)
    return [
        ("invalid_identity", identity.isNotNull()), ("legacy_untrusted", status == "legacy_untrusted"), ("needs_reverification", F.coalesce(reverify, F.lit(False)) & ~F.coalesce(verified & literal, F.lit(False))),
        ("not_verified_flag", ~F.coalesce(verified & ~status.startswith("legacy_"), verified)), ("missing_literal_evidence", ~F.coalesce(literal, F.lit(False))), ("missing_currency", empty(currency)),
        ("bad_procedure_relation", ~F.coalesce(relation.isin("exact", "variant"), F.lit(False))), ("provenance", provenance.isNotNull()), ("sanity_reject", ~F.coalesce(sane, F.lit(False))),
        ("untrusted_extraction_method", F.lower(method).rlike(UNTRUSTED_METHODS)), ("untrusted_source_type", F.lower(source_type).isin("search_snippet", "scraper")),
    ]


def sanitise_pool(rows: DataFrame, checks: Sequence[tuple[str, Column, str]], prices: Sequence[str]) -> DataFrame:
    """rows after the pool's checks (reason, predicate, action): the first that holds drops the row (`drop`), or strips its prices and
    keeps its identity as a stub (`strip`); with sanitised, the reason. Rows that pass stay as they are."""
    reason = first_reason([(r, p) for r, p, _ in checks])
    strips = [r for r, _, action in checks if action == "strip"]
    judged = rows.withColumn("sanitised", reason)
    kept = judged.filter(F.col("sanitised").isNull() | F.col("sanitised").isin(*strips))
    return kept.withColumns({p: F.when(F.col("sanitised").isNull(), F.col(p)) for p in prices})


def compare_filter(rating: Column, least_rating: float, name: Column, cue: str | None, amount: Column, low: float | None, high: float | None, rate: Column | None = None) -> Column:
    """Rating at least the least (within 1e-9), a cue in the name if one is asked for, and the amount, converted if there is a rate,
    within bounds; an open bound takes all, but a missing amount fails any bound."""
    a = amount / rate if rate is not None else amount
    ok = F.coalesce(rating >= least_rating - 1e-9, F.lit(False))
    if cue:
        ok = ok & F.coalesce(F.lower(name).rlike(cue), F.lit(False))
    for bound, test in ((low, lambda b: a >= b), (high, lambda b: a <= b)):
        if bound is not None:
            ok = ok & F.coalesce(test(bound), F.lit(False))
    return ok


def source_rank(kind: Column, ranks: dict[str, int] = SOURCE_RANKS) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), kind), F.lit(0))


def failure_class(reason: Column) -> Column:
    """permanent, temporary or, without a known reason, retry."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(r == "", "none").when(r.rlike(PERMANENT), "permanent").when(r.rlike(TEMPORARY), "temporary").otherwise("retry")


def convert(amount: Column, source: Column, target: Column, units_per_usd: dict[str, float]) -> Column:
    """An amount in another currency through units per dollar; an unknown code counts as 1."""
    rate = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in units_per_usd.items() for x in pair)), F.upper(F.trim(c))), F.lit(1.0))
    return amount / rate(source) * rate(target)


def sitemap_locations(xml: Column, own_host: Column) -> Column:
    """The <loc> urls of a sitemap whose host is the site's own, one below it, or one above it; each once."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    of = lambda u: bare(F.regexp_extract(u, r"^https?://([^/?#:]+)", 1))
    own = bare(own_host)
    fits = lambda h: (h != "") & ((h == own) | h.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), h)))
    return F.array_distinct(F.filter(found, lambda u: fits(of(u))))


RULES = "array<struct<allow:boolean,path:string>>"


def robots_rules(text: Column, agent: str) -> Column:
    """The rules of a robots file for an agent: of all groups that name it, else of those for `*`; an array of (allow, path). Lines of user agents in
    a row open one group; comments, other lines and rules without a path count for nothing; a null file has no rules."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n|\r"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    parts = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    none = F.array().cast(RULES)
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("own"), F.lit(False).alias("star"), F.lit(False).alias("named"), none.alias("mine"), none.alias("all"))

    def step(a: Column, x: Column) -> Column:
        names, rule = x["key"] == "user-agent", x["key"].isin("allow", "disallow") & (x["value"] != "")
        is_own, is_star = F.lower(x["value"]) == agent.lower(), x["value"] == "*"
        one = F.array(F.struct((x["key"] == "allow").alias("allow"), x["value"].alias("path"))).cast(RULES)
        return F.struct(
            F.when(names, F.lit(True)).when(x["key"].isin("allow", "disallow"), F.lit(False)).otherwise(a["open"]).alias("open"),
            F.when(names, (a["open"] & a["own"]) | is_own).otherwise(a["own"]).alias("own"), F.when(names, (a["open"] & a["star"]) | is_star).otherwise(a["star"]).alias("star"), (a["named"] | (names & is_own)).alias("named"),
            F.when(rule & a["own"], F.concat(a["mine"], one)).otherwise(a["mine"]).alias("mine"), F.when(rule & a["star"], F.concat(a["all"], one)).otherwise(a["all"]).alias("all"),
        )

    end = F.aggregate(parts, start, step)
    return F.when(end["named"], end["mine"]).otherwise(end["all"])


def robots_allow(rules: Column, path: Column) -> Column:
    """Whether a path may be read: the longest rule that fits decides, an allowing one among equals; without any it may. A star fits any text, a
    dollar at the end the path's end."""
    pattern = lambda p: F.concat(F.lit(r"^\Q"), F.replace(F.regexp_replace(p, r"\$$", ""), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"), F.when(p.endswith("$"), "$").otherwise(""))
    fits = F.filter(rules, lambda r: F.rlike(path, pattern(r["path"])))
    return F.coalesce(F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"], F.lit(True))
