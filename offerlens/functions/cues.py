"""Cue vocabularies: what a row says in words when its number is no owned price.

Each cue is a list of phrases, written from what its rule means; a caller may give lists of its own. A phrase is words; a star at a
word's end stands for any ending, `#` for a number of two or more. `pattern` makes one expression of a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

CUES: dict[str, list[str]] = {
    "pricing": ["charge*", "cost*", "fee", "fees", "from", "only", "pay", "precio*", "preis*", "price*", "prix", "rates", "starting", "tariff*"],
    "phone": ["call", "dial", "fax", "hotline", "mobile", "phone", "ring", "telephone", "text us", "whatsapp"],
    "address": ["avenida", "avenue", "boulevard", "building", "calle", "floor", "lane", "platz", "road", "rue", "square", "strasse", "straße", "street", "suite"],
    "duration": ["day", "days", "hour", "hours", "min", "mins", "minute*", "month", "months", "week", "weeks", "year", "years"],
    "monthly": ["/ month", "/month", "a month", "each month", "every month", "month by month", "monthly", "per month"],
    "piece": ["/ area", "/ml", "a session", "each", "per area", "per graft", "per ml", "per piece", "per session", "per unit"],
    "review": ["out of five", "rated", "rating*", "review*", "star", "stars", "testimonial*", "votes"],
    "approximate": ["about", "almost", "around", "estimated", "nearly", "or so", "roughly"],
    "cap": ["as much as", "borrow", "limit", "limit of", "no more than", "up to"],
    "finance": ["borrow*", "credit", "finance", "financing", "installment*", "instalment*", "lender*", "loan*"],
    "average": ["average*", "mean", "median", "most people pay", "typical*", "usual", "usually"],
    "comparison": ["by city", "by country", "cheaper than", "compare*", "comparison*", "in other countries", "versus", "vs"],
    "abroad": ["abroad", "america", "asia", "countries", "country", "europe", "overseas", "world*"],
    "travel": ["airline*", "airport*", "flight*", "hotel*", "plane ticket*", "shuttle*", "taxi*", "visa"],
    "product": ["add to bag", "add to basket", "add to cart", "bottle*", "buy now", "checkout", "for home use", "in stock", "jar", "jars", "order online", "shipping", "tube", "tubes"],
    "question": ["combien", "cuánto", "how much", "what does it cost", "what is the price", "wie viel"],
    "anecdote": ["charged me", "cost me", "i paid", "my bill", "my friend paid", "we paid"],
    "competitor": ["another clinic", "competitor*", "elsewhere", "other clinics", "other providers"],
    "placeholder": ["demo content", "dummy text", "lorem ipsum", "placeholder", "sample product", "theme preview"],
    "voucher": ["gift card*", "gift certificate*", "gift voucher*", "you may also like"],
    "package": ["bundle of #", "course of #", "pack of #", "package of #", "series of #", "set of #", "# treatments for"],
    "companion": ["bring a friend", "couples", "refer a friend", "two for one", "with a friend"],
    "disclaimer": ["for orientation only", "not our prices", "prices are estimates", "prices are examples", "prices are illustrative"],
    "own": ["at our", "in our clinic", "our clinic", "our fee*", "our package*", "our price*", "price list", "we charge"],
    "not_provider": ["are not a clinic", "is not a clinic", "no medical provider", "not a medical provider"],
    "article": ["in this article", "read more", "written by"],
    "package_page": ["our package", "our packages", "package includes", "what the package holds"],
    "start_price": ["our starting price", "prices start at", "starting at", "starting from"],
    "medical_question": ["answered by a doctor", "ask a doctor", "doctor answers", "patients ask", "question from a patient", "your questions answered"],
    "topical": ["balm*", "cleanser*", "cream*", "lotion*", "ointment*", "serum*", "sunscreen*"],
    "needleless": ["needle free", "needle-free", "needleless", "no needle*", "pressure pen", "without needles"],
    "beauty": ["barber*", "eyelash*", "hairdresser*", "manicure*", "nail", "nails", "tanning"],
    "clinical": ["clinical*", "doctor*", "injectable*", "injection*", "nurse*", "physician*", "syringe*"],
    "saving": ["saved", "saving*", "you save"],
}

#: Words of a url's path that tell what kind of page it leads to.
PATHS: dict[str, list[str]] = {
    "blog": ["article", "articles", "blog", "journal", "magazine", "news", "stories"],
    "prices": ["fee", "fees", "price", "pricelist", "prices", "pricing", "tariff", "tariffs"],
    "category": ["browse", "categories", "category", "explore", "listings", "search"],
    "finance": ["finance", "financing", "instalments", "loan", "loans"],
    "questions": ["answers", "ask", "forum", "qa", "questions"],
}


def pattern(phrases: Iterable[str]) -> str:
    """One expression for a list of phrases, over text in lower case."""

    def word(w: str) -> str:
        if w == "#":
            return r"(?:[2-9]|\d{2,})"
        return re.escape(w[:-1]) + r"[\p{L}]*" if w.endswith("*") else re.escape(w)

    return r"(?<![\p{L}\d])(?:" + "|".join(r"\s+".join(map(word, p.split())) for p in phrases) + r")(?![\p{L}\d])"
