"""Price sanity: detectors of numbers that are no owned price, as column builders, and the ordered cascade of their reasons.

Every word list is a parameter (`cues`): detectors look for phrases of a cue in a row, or in so many words before or behind the places
where the amount stands (`occurrences`): any of these places counts, however the amount is written there, and whatever other
numbers stand between. All are native expressions. A null text counts as empty, a null amount as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.cues import CUES, PATHS, pattern
from offerlens.functions.occurrences import MONEY, anywhere, last_words, next_words, occurrences, of_amount
from offerlens.functions.rules import first_reason
from offerlens.functions.text import host

#: Currencies of which a dollar buys over a hundred units, and currencies that a host's last label asks for.
SMALL_UNITS = ("AMD", "ARS", "CLP", "COP", "CRC", "HUF", "IDR", "IQD", "ISK", "JPY", "KRW", "KZT", "LBP", "NGN", "PKR", "RSD", "VND")
HOST_CURRENCY = {"uk": "GBP", "ch": "CHF", "pl": "PLN"}
#: Ways of extraction that find a number beside a label only, and those that read a structure.
WEAK_METHODS, STRUCTURED_METHODS = ("text", "snippet", "regex"), ("json_ld", "table", "product", "currency_table")


def low(*texts: Column) -> Column:
    """Texts in lower case, joined by a blank, every blank a plain one."""
    return F.translate(F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))), " \n\t", "   ")


def says(text: Column, cue: str, cues=CUES) -> Column:
    """The text, in lower case, has a phrase of the cue."""
    return text.rlike(pattern(cues[cue]))


@dataclass
class Offer:
    """The columns that the cascade looks at. text: what was read around the price; price: the price text itself; found: the
    occurrences of numbers in both (`places`), which a caller may have as a column already."""

    amount: Column
    price: Column
    text: Column
    label: Column
    currency: Column
    url: Column
    method: Column
    amount_max: Column
    requested: Column
    provider: Column
    page_text: Column
    date_failure: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    currency_failure: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    in_band: Column = field(default_factory=lambda: F.lit(True))
    found: Column | None = None


def places(price: Column, text: Column) -> Column:
    """All numbers of a price text and of what was read around it, as two rows."""
    return occurrences(F.concat_ws("\n", F.coalesce(price, F.lit("")), F.coalesce(text, F.lit(""))))


def cue_before(found: Column, cue: str, words: int, cues=CUES) -> Column:
    """Somewhere the cue stands in the words right before the number."""
    return anywhere(found, lambda o: says(last_words(o, words), cue, cues))


def cue_behind(found: Column, cue: str, words: int, cues=CUES) -> Column:
    return anywhere(found, lambda o: says(next_words(o, words), cue, cues))


def has_currency(found: Column) -> Column:
    """The number stands beside a currency."""
    return anywhere(found, lambda o: o["currency"].isNotNull())


def looks_like_phone(text: Column, cues=CUES) -> Column:
    """A run of digits of an international number's length that begins as one, or of seven digits or more right behind a phone cue."""
    runs = F.regexp_extract_all(text, F.lit(r"((?<![\d+])(?:\+|00)\d[\d ().\-/]{6,}\d)"), 1)
    abroad = F.exists(runs, lambda r: F.length(F.regexp_replace(r, r"\D", "")).between(9, 15))
    return F.coalesce(abroad, F.lit(False)) | text.rlike(pattern(cues["phone"]) + r"[\s:]*(?:us|at|on|me)?[\s:]*\+?(?:[ ().\-/]*\d){7,}")


def looks_like_address(found: Column, cues=CUES) -> Column:
    """A house or a floor: an address word is the next or the one after, or the last before, and no currency stands there."""
    return anywhere(found, lambda o: o["currency"].isNull() & (says(next_words(o, 2), "address", cues) | says(last_words(o, 1), "address", cues)))


def looks_like_duration(found: Column, cues=CUES) -> Column:
    return ~has_currency(found) & cue_behind(found, "duration", 1, cues)


def looks_like_instalment(found: Column, text: Column, cues=CUES) -> Column:
    return (cue_behind(found, "monthly", 3, cues) | cue_before(found, "monthly", 3, cues)) & ~says(text, "piece", cues)


def looks_like_year(text: Column, amount: Column, cues=CUES) -> Column:
    return amount.between(1900, 2100) & (amount == F.floor(amount)) & ~text.rlike(MONEY) & ~says(text, "pricing", cues)


def looks_like_calendar_question(found: Column, amount: Column, cues=CUES) -> Column:
    """`how much ... 2024?` asks in a year; the year is no price."""
    asked = anywhere(found, lambda o: says(last_words(o, 8), "question", cues) & o["behind"].rlike(r"^\s*\?"))
    return amount.between(1990, 2100) & (amount == F.floor(amount)) & asked


def looks_like_count(found: Column, text: Column, amount: Column, unit: str, least: int = 50) -> Column:
    """The amount is a number of units (`3000 grafts`), not a price for one."""
    counted = anywhere(found, lambda o: next_words(o, 1).rlike(rf"^{unit}s?\b"))
    return (amount >= least) & counted & ~text.rlike(rf"(?:\bper|/|\ba)\s*{unit}\b") & ~has_currency(found)


def looks_approximate(found: Column, cues=CUES) -> Column:
    return cue_before(found, "approximate", 2, cues) | cue_behind(found, "approximate", 2, cues)


def looks_like_credit_limit(found: Column, text: Column, cues=CUES) -> Column:
    return cue_before(found, "cap", 4, cues) & says(text, "finance", cues)


def looks_like_market_copy(text: Column, cues=CUES) -> Column:
    return says(text, "average", cues) & ~says(text, "own", cues)


def is_placeholder(text: Column, amount: Column, dummies: Sequence[float] = (), cues=CUES) -> Column:
    """Filler text of a shop theme, or one of the amounts that a theme's samples bear."""
    dummy = F.coalesce(*(F.when(F.abs(amount - d) < 0.02, F.lit(True)) for d in dummies), F.lit(False))
    return says(text, "placeholder", cues) | dummy


def host_currency_conflict(url: Column, currency: Column, wanted: dict[str, str] = HOST_CURRENCY) -> Column:
    """A dollar price on a host whose last label asks for another currency."""
    label = F.element_at(F.split(host(url), r"\."), -1)
    ask = F.element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), label)
    return (F.upper(F.trim(currency)) == "USD") & (ask != "USD")


def too_many_digits(amount: Column, currency: Column) -> Column:
    return amount >= F.when(F.upper(F.trim(currency)).isin(*SMALL_UNITS), F.lit(1e11)).otherwise(F.lit(1e7))


def rounded_spread(low_amount: Column, high_amount: Column, step: int = 1000, least: float = 1500, most: float = 5000) -> Column:
    """Round bounds some thousands apart: a market's range, not a menu's."""
    span = high_amount - low_amount
    return F.coalesce((low_amount % step == 0) & (high_amount % step == 0) & span.between(least, most), F.lit(False))


def max_hint(price: Column, amount: Column) -> Column:
    """The upper bound that a price text names, the amount without one."""
    numbers = occurrences(price)
    joined = F.filter(numbers, lambda o: (o["ord"] > 0) & o["before"].rlike(rf"[–—-]\s*{MONEY}?\s*$"))
    return F.greatest(F.coalesce(F.get(joined, F.lit(0))["amount"], amount), amount)


def path_words(url: Column) -> Column:
    """Words of a url's path."""
    return F.split(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1), "[^a-z0-9]+")


def path_says(url: Column, kind: str, paths=PATHS) -> Column:
    return F.arrays_overlap(path_words(url), F.array(*map(F.lit, paths[kind])))


def is_guide(url: Column) -> Column:
    """A segment of the path asks what something costs somewhere: a price word beside `in`, `of`, `guide`, `average` or `much`."""
    segments = F.split(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1), "/")
    words = lambda s: F.split(s, "[^a-z0-9]+")
    holds = lambda s, *w: F.arrays_overlap(words(s), F.array(*map(F.lit, w)))
    return F.exists(segments, lambda s: holds(s, "cost", "costs", "price", "prices") & holds(s, "in", "of", "guide", "average", "much"))


def page_context(url: Column, text: Column, title: Column, cues=CUES) -> Column:
    """What kind of page a price stands on, the first that fits of eleven: five that never own their prices, three that do."""
    t = low(title, text)
    return F.coalesce(
        first_reason([
            ("explicit_non_owned_prices", says(t, "disclaimer", cues)),
            ("non_clinic_booking_platform", says(t, "not_provider", cues)),
            ("country_cost_guide", is_guide(url)),
            ("foreign_price_comparison", says(t, "comparison", cues) & says(t, "abroad", cues)),
            ("comparison_article", says(t, "comparison", cues)),
            ("market_average", looks_like_market_copy(t, cues)),
            ("blog", path_says(url, "blog") | says(t, "article", cues)),
            ("official_price_list", path_says(url, "prices") | t.rlike(r"\bprice list\b")),
            ("official_package_price", says(t, "package_page", cues)),
            ("official_service_price", says(t, "start_price", cues)),
        ]),
        F.lit("unknown"),
    )


NEVER_OWNED = ("explicit_non_owned_prices", "non_clinic_booking_platform")
ASKS_FOR_OWN_WORDS = ("country_cost_guide", "foreign_price_comparison", "comparison_article", "market_average", "blog")
OWNED = ("official_price_list", "official_package_price", "official_service_price")


def is_owned(context: Column, evidence: Column, cues=CUES) -> Column:
    """Whether the evidence is the provider's own price: never on some pages, on others only with words that say so."""
    t = low(evidence)
    never = context.isin(*NEVER_OWNED) | says(t, "disclaimer", cues) | says(t, "not_provider", cues) | says(t, "companion", cues) | says(t, "comparison", cues)
    return ~never & (~context.isin(*ASKS_FOR_OWN_WORDS) | says(t, "own", cues))


def is_medical_question(url: Column, text: Column, hosts: Sequence[str] = (), cues=CUES) -> Column:
    """A page on which patients ask and doctors answer: a host of the list, or a path of questions with words that say so."""
    h = host(url)
    listed = F.coalesce(*(F.when((h == x) | h.endswith("." + x), F.lit(True)) for x in hosts), F.lit(False))
    return listed | (path_says(url, "questions") & says(low(text), "medical_question", cues))


def scope_reason(found: Column, text: Column, label: Column, amount: Column, cues=CUES) -> Column:
    """Why a number in the row belongs to something else than the treatment: read in the words before and behind each of its places,
    and in a label that begins with it. found: the occurrences of the amount."""
    return first_reason([
        ("market_comparison_table", says(text, "comparison", cues)),
        ("product_not_procedure", says(low(label), "product", cues) | cue_before(found, "product", 10, cues)),
        ("travel_cost_not_procedure", says(F.regexp_extract(low(label), r"^\s*(\S+(?:\s+\S+)?)", 1), "travel", cues) | cue_before(found, "travel", 10, cues)),
        ("calendar_year_not_price", looks_like_calendar_question(found, amount, cues)),
    ])


def technique_reason(label: Column, evidence: Column, provider: Column, url: Column, cues=CUES) -> Column:
    """Why a row is no injection: a topical product, a pen without a needle, or a beauty provider without a clinical word."""
    local, identity = low(label, evidence), F.translate(low(provider, url), "-_/.", "    ")
    return first_reason([
        ("topical_product_not_injectable", says(local, "topical", cues)),
        ("needleless_not_injectable", says(local, "needleless", cues)),
        ("technique_unverified", says(identity, "beauty", cues) & ~says(local, "clinical", cues)),
    ])


def per_unit(found: Column, amount: Column, unit: str) -> Column:
    """The amount over the number of units that the row names beside it; null without one."""
    counts = F.filter(found, lambda o: next_words(o, 1).rlike(rf"^{unit}s?\b") & (o["amount"] > 0) & o["currency"].isNull())
    return amount / F.get(counts, F.lit(0))["amount"]


@dataclass
class Policy:
    """What a market's cascade is set to. family_rules, late_rules: (reason, pattern of the requested treatment, pattern of the row, pattern that
    excuses the row); the first stand where the neighbours of a treatment are told apart from it, the others behind the market's averages.
    unit, unit_band: the counted unit and what one may cost; dummies: amounts of theme samples."""

    unit: str = "graft"
    unit_band: tuple[float, float] = (0.0, 100.0)
    family_rules: Sequence[tuple[str, str, str, str]] = ()
    late_rules: Sequence[tuple[str, str, str, str]] = ()
    directory_hosts: Sequence[str] = ()
    question_hosts: Sequence[str] = ()
    dummies: Sequence[float] = ()


def reasons(o: Offer, injectable: Column, policy: Policy | None = None, cues=CUES) -> list[tuple[str, Column]]:
    """The cascade: (reason, predicate) in the order in which they count. The first that holds is the offer's reason."""
    policy = policy or Policy()
    text, price = low(o.price, o.text), low(o.price)
    everything = low(o.requested, o.price, o.text)
    every = o.found if o.found is not None else places(o.price, o.text)
    found = of_amount(every, o.amount)
    weak, structured = o.method.isin(*WEAK_METHODS), F.coalesce(o.method.isin(*STRUCTURED_METHODS), F.lit(False))
    scope, technique = scope_reason(found, text, o.label, o.amount, cues), F.when(injectable, technique_reason(o.label, o.text, o.provider, o.url, cues))
    money = (F.trim(F.coalesce(o.currency, F.lit(""))) != "") | text.rlike(MONEY)
    context = page_context(o.url, o.page_text, o.requested, cues)
    h = host(o.url)
    listed = F.coalesce(*(F.when((h == x) | h.endswith("." + x), F.lit(True)) for x in policy.directory_hosts), F.lit(False))
    rule = lambda rows: [(reason, low(o.requested).rlike(asked) & everything.rlike(row) & ~(everything.rlike(excuse) if excuse else F.lit(False))) for reason, asked, row, excuse in rows]
    named = lambda kinds, c: [(k, c == k) for k in kinds]
    unit, each = policy.unit, per_unit(every, o.amount, policy.unit)
    return [
        ("missing_price_semantics", ~F.coalesce(o.amount > 0, F.lit(False))),
        *named(("missing", "ambiguous", "invalid", "future"), o.date_failure),
        ("currency_provenance", o.currency_failure.isNotNull()),
        ("medical_question", is_medical_question(o.url, F.concat_ws(" ", o.page_text, o.text), policy.question_hosts, cues)),
        *named(("market_comparison_table", "product_not_procedure", "travel_cost_not_procedure", "calendar_year_not_price"), scope),
        *named(("topical_product_not_injectable", "needleless_not_injectable", "technique_unverified"), technique),
        ("financing_credit_limit", looks_like_credit_limit(found, text, cues)),
        ("market_price_quote", text.rlike(pattern(cues["average"]) + r"\s+(?:\p{L}+\s+)?prices?\b")),
        *rule(policy.family_rules),
        ("directory_or_agency_price", listed),
        ("marketplace_category", path_says(o.url, "category")),
        ("non_treatment_label", says(text, "voucher", cues)),
        ("not_owned_price", ~is_owned(context, F.concat_ws(" ", o.label, o.text, o.price), cues)),
        ("theme_placeholder", is_placeholder(everything, o.amount, policy.dummies, cues)),
        ("tld_currency_mismatch", host_currency_conflict(o.url, o.currency)),
        ("phone_number", looks_like_phone(price, cues) | looks_like_phone(text, cues)),
        ("implausible_digits", too_many_digits(o.amount, o.currency)),
        ("address_number", weak & looks_like_address(found, cues)),
        ("duration", looks_like_duration(found, cues)),
        ("percent_without_currency", price.rlike(r"\d\s*%") & ~price.rlike(MONEY)),
        ("review_count", says(text, "review", cues)),
        ("bare_year", looks_like_year(text, o.amount, cues) & ~structured),
        ("no_price_semantics", ~structured & ~money & ~says(text, "pricing", cues)),
        ("unit_count", looks_like_count(found, text, o.amount, unit)),
        ("market_information", is_guide(o.url)),
        ("finance_page", path_says(o.url, "finance")),
        ("monthly_financing", looks_like_instalment(found, text, cues)),
        ("market_average", looks_like_market_copy(text, cues)),
        (f"effective_per_{unit}", ~each.between(*policy.unit_band)),
        *rule(policy.late_rules),
        ("approximate_quote", looks_approximate(found, cues) & weak),
        ("larger_package", says(text, "package", cues)),
        ("market_price_spread", rounded_spread(o.amount, F.greatest(F.coalesce(o.amount_max, o.amount), max_hint(price, o.amount)))),
        ("patient_anecdote", says(text, "anecdote", cues)),
        ("competitor_quote", says(text, "competitor", cues)),
        ("implausible_per_unit", text.rlike(rf"(?:\bper|/)\s*{unit}\b") & (o.amount > policy.unit_band[1])),
        ("implausible_amount", ~o.in_band),
    ]


def reject_reason(o: Offer, injectable: Column, policy: Policy | None = None, cues=CUES) -> Column:
    """The offer's first reason; null for a good one."""
    return first_reason(reasons(o, injectable, policy, cues))


def needs_reselect(o: Offer, injectable: Column, policy: Policy | None = None, cues=CUES) -> Column:
    """Whether a stored price must be chosen anew: its url or text would be rejected today, it spans fourfold, or its label is a saving."""
    today = {"missing", "ambiguous", "invalid", "future", "currency_provenance", "no_price_semantics", "missing_price_semantics"}
    again = first_reason([(r, p) for r, p in reasons(o, injectable, policy, cues) if r not in today])
    wide = F.coalesce(o.amount_max >= 4 * o.amount, F.lit(False))
    return again.isNotNull() | wide | says(low(o.label), "saving", cues)
