"""The numbers of a text, each with what stands around it: one native scan, so that rules about a number can look at every place
where it is written, however it is written there.

`occurrences` gives an array in the order of the text: ord, raw (as written), amount (as parsed, by either separator convention),
currency (the symbol or code right before or behind it), before and behind (the words around it, other numbers among them, BEFORE and
BEHIND of them at most). Line ends and cell borders are row marks, a word `|` of their own. A null text has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import bare_number, let, number_of_bare

BEFORE, BEHIND = 24, 8
SYMBOLS = "$€£₺¥₩"
CODES = ("aed", "aud", "cad", "chf", "eur", "gbp", "huf", "jpy", "krw", "pln", "ron", "sar", "try", "usd", "vnd")
MONEY = rf"(?:[{SYMBOLS}]|(?<![\p{{L}}])(?:{'|'.join(CODES)})(?![\p{{L}}]))"
#: Digits with groups by blank, comma or dot, and with decimals.
NUMBER = r"\d{1,3}(?:[  ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)*"
#: Amounts that differ by no more are the same.
SAME = 0.011


def rows_in(text: Column) -> Column:
    """Text in lower case with row marks as words and all other blanks plain."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\n|]", " | "), "\t\r ", "   ")


def occurrences(text: Column, number: str = NUMBER) -> Column:
    """Numbers and gaps of a text are found once, and each gap is cut once to the words at its ends that a number can reach, so that the work
    grows with the text and not with its square."""
    words = lambda x: F.filter(F.split(x, " +"), lambda w: w != "")
    cut = lambda w, n, ends: F.when(F.size(w) > n + 2, ends(w, n + 2))  # noqa: E731  a first or last one may be empty, where a number joins a word

    def ends(gap: Column) -> Column:
        """The gap as it stands behind other numbers (its last words) and before them (its first words)."""
        tail = lambda w: cut(w, BEFORE, lambda w, n: F.concat(F.lit(" "), F.array_join(F.slice(w, -n, n), " ")))
        head = lambda w: cut(w, BEHIND, lambda w, n: F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" ")))
        return let(F.split(gap, " +"), lambda w: F.struct(F.coalesce(tail(w), gap).alias("tail"), F.coalesce(head(w), gap).alias("head")))

    def one(numbers: Column, gaps: Column, last: Column, i: Column) -> Column:
        first, final = F.greatest(i - BEFORE, F.lit(0)), F.least(i + BEHIND, last)
        before = F.concat_ws("", F.transform(F.sequence(first, i), lambda k: F.when(k < i, F.concat(F.get(gaps, k)["tail"], F.get(numbers, k))).otherwise(F.get(gaps, i)["tail"])))
        behind = F.concat_ws("", F.transform(F.sequence(i, final), lambda k: F.concat(F.when(k == i, F.lit("")).otherwise(F.get(numbers, k)), F.get(gaps, k + 1)["head"])))

        def found(x: Column) -> Column:
            left = let(words(x["before"]), lambda w: F.concat_ws(" ", F.when(F.size(w) > BEFORE, F.slice(w, -BEFORE, BEFORE)).otherwise(w)))
            money = F.coalesce(F.nullif(F.regexp_extract(x["before"], rf"({MONEY})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(x["behind"], rf"^\s*({MONEY})", 1), F.lit("")))
            amount = let(bare_number(F.get(numbers, i)), number_of_bare)
            return F.struct(i.alias("ord"), F.get(numbers, i).alias("raw"), amount.alias("amount"), money.alias("currency"), left.alias("before"), F.concat_ws(" ", F.slice(words(x["behind"]), 1, BEHIND)).alias("behind"))

        return let(F.struct(before.alias("before"), behind.alias("behind")), found)

    def every(p: Column) -> Column:
        last = F.size(p["numbers"]) - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: one(p["numbers"], p["gaps"], last, i))).otherwise(F.array().cast(TYPE))

    parts = lambda t: F.struct(F.regexp_extract_all(t, F.lit(f"({number})"), 1).alias("numbers"), F.transform(F.split(t, number, -1), lambda g: ends(g)).alias("gaps"))
    return let(rows_in(text), lambda t: let(parts(t), every))


TYPE = "array<struct<ord:int,raw:string,amount:double,currency:string,before:string,behind:string>>"


def of_amount(found: Column, amount: Column) -> Column:
    """The occurrences of one amount."""
    return F.filter(found, lambda o: F.coalesce(F.abs(o["amount"] - amount) <= SAME, F.lit(False)))


def last_words(o: Column, n: int) -> Column:
    """The n words right before a number, in its row and behind the last other price: its own currency left out."""
    own = F.regexp_replace(o["before"], rf"{MONEY}\s*$", "")
    words = F.filter(F.split(F.regexp_extract(own, rf"[^|{SYMBOLS}]*$", 0), " +"), lambda w: w != "")
    return let(words, lambda w: F.concat_ws(" ", F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w)))


def next_words(o: Column, n: int) -> Column:
    """The n words right behind a number, in its row: its own currency left out."""
    own = F.regexp_replace(o["behind"], rf"^\s*{MONEY}", "")
    return F.concat_ws(" ", F.slice(F.filter(F.split(F.regexp_extract(own, r"^[^|]*", 0), " +"), lambda w: w != ""), 1, n))


def anywhere(found: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the test holds at one of the places at least."""
    return F.coalesce(F.exists(found, lambda o: F.coalesce(test(o), F.lit(False))), F.lit(False))
