"""Column builders for text, numbers, currencies, urls and ids. All native but fold_marks: they stay inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters with marks and their plain forms, for folding by table.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it: inside of lambdas Spark shares no common parts."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without Latin marks; Turkish capital I with dot first, sharp s as ss."""
    lowered = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.replace(F.translate(lowered, MARKED, PLAIN), F.lit("ß"), F.lit("ss"))


def fold_spaced(text: Column) -> Column:
    """fold with hyphens and underscores as blanks, and blanks of all kinds run together."""
    return F.trim(F.regexp_replace(F.translate(fold(text), "-_\u00a0", "   "), r"\s+", " "))


def fold_place(text: Column) -> Column:
    """fold for place names: dotless i as i and the like, apostrophes go, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(fold(text), "ığşłøđ", "igslod"), "['’`]", ""), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def fold_marks(texts: pd.Series) -> pd.Series:
    """Lower case without any combining mark, of all scripts: compatibility decomposition, which no built-in function does."""
    return texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


def name_key(text: Column) -> Column:
    """Folded, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def packed_name(text: Column, generic: list[str]) -> Column:
    """name_key without generic words at either end, then without spaces; the whole key if only generic words are in it."""
    words = F.split(name_key(text), " ")
    outside = lambda w: ~w.isin(*generic)
    kept = F.filter(words, outside)
    first = F.array_position(F.transform(words, lambda w: ~w.isin(*generic)), F.lit(True))
    last = F.size(words) - F.array_position(F.reverse(F.transform(words, lambda w: ~w.isin(*generic))), F.lit(True)) + 1
    inner = F.slice(words, first.cast("int"), (last - first + 1).cast("int"))
    return F.when(F.size(kept) == 0, F.concat_ws("", words)).otherwise(F.concat_ws("", inner))


def locale_number(text: Column) -> Column:
    """A number with either separator convention. With both marks the last one is the decimal mark. A mark that stands alone
    groups if three digits, or a multiple, follow its last place; else it is the decimal mark. Two decimal marks are no number."""
    return number_of_bare(bare_number(text))


def bare_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[\s\u00a0'’]", "")


def number_of_bare(bare: Column) -> Column:
    """locale_number of what bare_number left."""
    comma, dot = F.length(bare) - F.instr(F.reverse(bare), ","), F.length(bare) - F.instr(F.reverse(bare), ".")
    has_comma, has_dot = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    grouped = bare.rlike(r"[.,](?:\d{3})+$")
    point = lambda drop, mark: F.translate(F.translate(bare, drop, ""), mark, ".")
    number = (
        F.when(has_comma & has_dot & (comma > dot), point(".", ",")).when(has_comma & has_dot, F.translate(bare, ",", ""))
        .when(grouped, F.translate(bare, ",.", "")).otherwise(F.translate(bare, ",", "."))
    )
    return F.when(bare.rlike(r"^\d[\d.,]*$"), number.try_cast("double"))


def numbers_in(text: Column) -> Column:
    """All numbers of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), 1), locale_number), lambda x: x.isNotNull())


def currency_of(text: Column, symbols: list[tuple[str, str]]) -> Column:
    """Code of the first (symbol, code) whose symbol the text holds; else a known code standing as a word."""
    by_symbol = F.coalesce(*(F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in symbols))
    codes = "|".join(dict.fromkeys(c for _, c in symbols))
    by_code = F.nullif(F.regexp_extract(F.upper(text), rf"(?:^|[^A-Z])({codes})(?:[^A-Z]|$)", 1), F.lit(""))
    return F.coalesce(by_symbol, by_code)


def positive(x: Column) -> Column:
    """The number, null unless it is finite and above zero."""
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def host(url: Column) -> Column:
    """Host in lower case without www; null without one."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def path_depth(url: Column) -> Column:
    """Non-empty segments of the path."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("long")


def host_suffixes(h: Column) -> Column:
    """The host and each of its parent domains with two labels or more."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))


def hash_id(length: int, *parts: Column) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def strict_date(text: Column) -> Column:
    """ISO dates only; days that don't exist are null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def add_period(day: Column, value: Column, unit: Column) -> Column:
    """Days and weeks plainly; months end on the month's last day; years move 29 February to 1 March where there is none."""
    months = F.add_months(day, value)
    years = F.add_months(day, value * 12)
    leap_lost = (F.month(day) == 2) & (F.dayofmonth(day) == 29) & (F.dayofmonth(years) == 28)
    return F.when(unit == "days", F.date_add(day, value)).when(unit == "weeks", F.date_add(day, value * 7)).when(unit == "months", months).when(unit == "years", F.when(leap_lost, F.date_add(years, 1)).otherwise(years))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, blanks run together."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def version_number(text: Column) -> Column:
    """major.minor.patch as one comparable number; parts that are missing count as 0."""
    parts = F.split(text, r"\.")
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("long"), F.lit(0))
    return at(0) * 1_000_000 + at(1) * 1_000 + at(2)
