"""Columns that judge evidence: literal amounts, price texts, units, relations, ranks of sources, provenance of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.rules import first_reason
from offerlens.functions.text import currency_of, locale_number, numbers_in


def amount_forms(amount: Column) -> Column:
    """An amount as it may be written: its whole part plain, or grouped by comma, dot or space, and its cents. Whole amounts may bear
    two zeros; cents that end in zero may lack it."""
    cents = F.round(amount * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), (cents % 100).cast("long")
    grouped = F.format_number(whole, 0)
    wholes = F.array(whole.cast("string"), grouped, F.translate(grouped, ",", "."), F.translate(grouped, ",", " "))
    two = F.lpad(rest.cast("string"), 2, "0")
    ends = F.when(rest == 0, F.array(F.lit(""), F.lit(".00"), F.lit(",00"))).when(rest % 10 == 0, F.array(*(F.concat(F.lit(m), x) for m in ".," for x in (two, F.substring(two, 1, 1))))).otherwise(F.array(*(F.concat(F.lit(m), two) for m in ".,")))
    return F.array_distinct(F.flatten(F.transform(wholes, lambda w: F.transform(ends, lambda e: F.concat(w, e)))))


def literally_in(source: Column, amount: Column) -> Column:
    """Whether the source writes the amount, not as a part of a longer number."""
    padded = F.concat(F.lit(" "), source, F.lit(" "))
    pattern = lambda form: F.concat(F.lit(r"(?<![\d.,])\Q"), form, F.lit(r"\E(?![.,]?\d)"))
    return F.coalesce(F.exists(amount_forms(amount), lambda form: F.rlike(padded, pattern(form))), F.lit(False))


def price_text(label: Column) -> dict[str, Column]:
    """price_min, price_max (only above the minimum) and price_type of a price label: range, from, approximate or fixed."""
    n = F.filter(numbers_in(label), lambda x: x > 0)
    low, high = F.array_min(F.slice(n, 1, 2)), F.array_max(F.slice(n, 1, 2))
    ranged = F.lower(label).rlike(r"\d\s*\D{0,3}\s*(?:-|–|to)\s*\D{0,3}\s*\d")
    kind = F.coalesce(F.when(F.lower(label).rlike(r"^\s*(?:about|approx|ca\.|~)"), F.lit("approximate")), F.when(ranged & (high > low), F.lit("range")), F.when(F.lower(label).rlike(r"^\s*(?:from|ab|desde)\b"), F.lit("from")), F.lit("fixed"))
    first = F.when(ranged, low).otherwise(F.get(n, F.lit(0)))
    return {"price_min": first, "price_max": F.when(ranged & (high > low), high), "price_type": F.when(F.size(n) > 0, kind)}


def standard_unit(label: Column, synonyms: Sequence[tuple[str, str]]) -> Column:
    """Standard name of a unit label: the leading `per` and a quantity go, then the first synonym the rest starts with."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"^per\s+", ""), r"^\d+(?:[.,]\d+)?\s*", "")
    return F.coalesce(*(F.when(F.startswith(bare, F.lit(word)), F.lit(unit)) for word, unit in synonyms))


def signals(text: Column, vocabulary: Sequence[tuple[str, str]]) -> Column:
    """Names whose word the text holds, in the vocabulary's order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(word)), F.lit(name)) for word, name in vocabulary))))


def relation(found: Column, wanted: Column, market: Column, extra: Column, part: Column | None = None, witness: Column | None = None) -> Column:
    """Relation of a label's signals to the wanted one: the first rule that holds.

    part: the label names a quantity, a brand or an area, as a variant of the wanted treatment does. witness: another row of the page
    has the wanted signal; beside it a row that names a part and no signal of its own is a variant, too."""
    has = F.array_contains(found, wanted)
    part, witness = (F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for c in (part, witness))
    lone = F.size(found) == 0
    rules = [("market", market), ("add_on", has & extra), ("bundle", has & (F.size(found) > 1)), ("variant", has & part), ("exact", has), ("variant", lone & part & witness), ("ambiguous", lone)]
    return F.coalesce(first_reason(rules), F.lit("different"))


def shares_block(block: Column, label: Column, amount: Column, least: int = 4) -> Column:
    """Whether one block of a page holds both: the amount as it may be written, and the label or one of its words of `least` characters
    or more (a label of short words alone asks for the amount only; an empty one holds nowhere)."""
    text, name = F.lower(block), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    words = F.filter(F.split(name, r"[^\p{L}\d]+"), lambda w: F.length(w) >= least)
    named = F.contains(text, name) | (F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, w))
    return literally_in(block, amount) & (name != "") & F.coalesce(named, F.lit(False))


def date_failure(text: Column, now: Column) -> Column:
    """Why a published date can't be trusted: missing, ambiguous (not ISO), invalid (no such day) or over a day ahead; null if it can."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = F.when(iso, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return first_reason([("missing", text.isNull() | (text == "")), ("ambiguous", ~iso), ("invalid", day.isNull()), ("future", day > F.date_add(now.cast("date"), 1))])


def amount_label(low: Column, high: Column, kind: Column, symbol: Column) -> Column:
    """Shown label: whole amounts (cut, not rounded) with thousands separators, `from` or a range where it is one."""
    shown = lambda x: F.concat(symbol, F.format_number(x.cast("long"), 0))
    return F.when(low.isNull(), F.lit("")).when(high > low, F.concat(shown(low), F.lit(" - "), shown(high))).when(kind == "from", F.concat(F.lit("from "), shown(low))).otherwise(shown(low))


def phone_key(text: Column, digits: int = 9) -> Column:
    """The last digits of a phone number; null with fewer."""
    bare = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(bare) >= digits, F.right(bare, F.lit(digits)))


def versions(text: Column) -> Column:
    """major, minor and patch as an array that compares as versions do; missing or odd parts count as 0."""
    parts = F.split(text, r"\.")
    return F.array(*(F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(0)) for k in range(3)))


def mojibake_repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is put right; whatever isn't such text stays as it is."""
    latin = text.rlike(r"^[\x00-\xff]*$") & text.rlike(r"[\xc2-\xf4][\x80-\xbf]")
    raw = F.encode(F.when(latin, text), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(text)


def lead_name(title: Column, host: Column, generic: Sequence[str]) -> Column:
    """A provider's name from a search hit: the first part of the title that isn't generic, else the brand label of the host."""
    trimmed = lambda p: F.trim(p)  # noqa: E731  trim itself would take the place as the characters to trim
    parts = F.filter(F.transform(F.split(title, r"\s+[|\-–]\s+"), trimmed), lambda p: (p != "") & ~F.lower(p).isin(*generic))
    brand = F.element_at(F.split(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), r"\."), 1)
    return F.coalesce(F.get(parts, F.lit(0)), brand)


#: Unit words to standard units (a parameter of unit_of).
UNITS = [
    ("units", "unit"), ("unit", "unit"), ("u", "unit"), ("ml", "ml"), ("cc", "ml"), ("syringes", "syringe"), ("syringe", "syringe"), ("vials", "vial"), ("vial", "vial"), ("sessions", "session"), ("session", "session"), ("visits", "session"),
    ("areas", "area"), ("area", "area"), ("zones", "area"), ("zone", "area"), ("grafts", "graft"), ("graft", "graft"), ("hours", "hour"), ("hour", "hour"), ("threads", "thread"), ("thread", "thread"), ("packages", "package"), ("package", "package"), ("persons", "person"), ("person", "person"),
]


def unit_of(label: Column, units: Sequence[tuple[str, str]] = UNITS) -> dict[str, Column]:
    """unit and quantity of a price label: `per 2 areas`, `/ml`, or a quantity before a unit word; the first that stands there."""
    t, words = F.lower(label), "|".join(w for w, _ in units)
    table = F.create_map(*(F.lit(x) for pair in units for x in pair))
    amount = r"(\d+(?:[.,]\d+)?)?"
    per = rf"(?:\bper|/)\s*{amount}\s*({words})\b"
    plain = rf"(?<![\d.,])(\d+(?:[.,]\d+)?)\s*({words})\b"
    has_per, has_plain = t.rlike(per), t.rlike(plain)
    word = F.when(has_per, F.regexp_extract(t, per, 2)).when(has_plain, F.regexp_extract(t, plain, 2))
    number = F.when(has_per, F.regexp_extract(t, per, 1)).when(has_plain, F.regexp_extract(t, plain, 1))
    return {"unit": F.element_at(table, word), "quantity": locale_number(F.nullif(number, F.lit("")))}


def currency_near(text: Column, symbols: list[tuple[str, str]], window: int = 28) -> Column:
    """The currency within so many characters of the first number, else of the whole text."""
    at = F.regexp_instr(text, F.lit(r"\d"))
    start = F.greatest(at - window, F.lit(1))
    near = F.substring(text, start, at + window - start)
    return F.coalesce(F.when(at > 0, currency_of(near, symbols)), currency_of(text, symbols))


#: Path words of pages that hold no prices, of lists of prices, of booking pages, of copy about prices, and of offers.
NO_PAGE = ("author", "feed", "login", "tag", "wp-admin", "wp-login")
PRICE_PAGES, BOOKING_PAGES = ("fees", "price-list", "pricelist", "prices", "tariff"), ("appointment", "book", "booking", "book-now", "book-online")
COPY_PAGES, OFFER_PAGES = ("article", "blog", "faq", "guide", "guides", "news"), ("deals", "offers", "promotions", "special-offers")


def url_score(url: Column, procedure: Sequence[str], price: Sequence[str], service: Sequence[str], treatment: Sequence[str], city: Sequence[str] = (), other_cities: Sequence[str] = (), other_treatments: Sequence[str] = ()) -> Column:
    """How likely a url's page holds a price, by the words of its path; a null url scores 0.

    First what scores 0: mail and phone links, pictures, pages of the site's own machinery, another city's page (unless it names the own
    one, too) and another treatment's (likewise). Then 3 for a price word, 2 for a service word, 1 for a treatment word (the best
    counts), a document at least 3, and 1 more for each word of the procedure. A price list scores at least 5, a booking page at least 4,
    a page of copy or offers at most 1: the first of these that fits. The city adds 4."""
    u = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments, tokens = F.split(F.regexp_replace(path, r"\.[a-z]+$", ""), "/"), F.split(path, "[^a-z0-9]+")
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words))) if words else F.lit(False)
    segment = lambda words: F.arrays_overlap(segments, F.array(*map(F.lit, words)))
    none = (u == "") | u.rlike(r"^(?:mailto|tel):") | path.rlike(r"\.(?:gif|ico|jpe?g|png|svg|webp)$") | segment(NO_PAGE) | (has(other_cities) & ~has(city)) | (has(other_treatments) & ~has(procedure))
    base = F.when(has(price), 3).when(has(service), 2).when(has(treatment), 1).otherwise(0)
    base = F.greatest(base, F.when(path.rlike(r"\.pdf$"), 3).otherwise(0)) + F.size(F.array_intersect(tokens, F.array(*map(F.lit, procedure))))
    copy = segment(COPY_PAGES) | segment(OFFER_PAGES)
    base = F.when(segment(PRICE_PAGES) & ~segment(OFFER_PAGES) & ~segment(BOOKING_PAGES), F.greatest(base, F.lit(5))).when(segment(BOOKING_PAGES), F.greatest(base, F.lit(4))).when(copy, F.least(base, F.lit(1))).otherwise(base)
    return F.when(none, 0).otherwise(base + F.when(has(city), 4).otherwise(0))
