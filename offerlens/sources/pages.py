"""Price evidence from raw HTML pages: a table function from (url, html) to rows, and what follows natively."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from offerlens.functions.cues import CUES, pattern
from offerlens.functions.text import hash_id, numbers_in

EVIDENCE = "page_id long, url string, ord int, method string, label string, price_text string, raw string, amount double, currency string"
RAW = "page_id long, url string, ord int, method string, label string, price_text string, raw string"
#: Elements that belong to a page's frame.
CHROME = {"nav", "header", "footer", "script", "style", "noscript", "aside"}
PRICE = re.compile(r"(?:[$€£₺¥]\s?\d[\d.,\s]*\d|[$€£₺¥]\s?\d|\d[\d.,]*\s?(?:[$€£₺¥]|USD|EUR|GBP|TRY|CAD|AUD)\b)")


CODES = {"$": "USD", "€": "EUR", "£": "GBP", "₺": "TRY", "¥": "JPY", "usd": "USD", "eur": "EUR", "euro": "EUR", "gbp": "GBP", "try": "TRY", "tl": "TRY"}
#: Longest span of text that an evidence keeps.
SPAN = 240
#: Elements that go as a whole for what they hold, and the longest text of one that goes for a companion offer.
WHOLE, SMALL_PART = {"table", "section", "article", "div", "ul", "dl"}, 400


def python_cue(name: str) -> re.Pattern:
    return re.compile(pattern(CUES[name]).replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{L}\d]", r"[^\W_]"))


COMPARISON, COMPETITOR, COMPANION = map(python_cue, ("comparison", "competitor", "companion"))
#: Elements without an end tag.
VOID = {"br", "img", "input", "meta", "link", "hr", "source", "wbr"}


class Blocks(HTMLParser):
    """Rows of tables, items of lists, headings and paragraphs, without the page's frame; JSON-LD and product texts; product cards.

    What an element holds is known at its end: a table that compares countries or clinics, and a small part that offers a companion
    something, lose all their rows then, whatever element they began in.

    A card is an element whose class has the word `product`; inside, the first heading names it and what stands in an element whose
    class has the word `price` is its price, but for struck-out text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.cells, self.blocks, self.linked, self.text = 0, [], [], [], []
        self.kind, self.ld, self.struck, self.headers = "", False, 0, []
        self.products, self.cards, self.open, self.card = [], [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = set((a.get("class") or "").lower().replace("_", "-").replace("-", " ").split())
        if tag not in VOID:
            role = "card" if "product" in names and self.card is None else "price" if "price" in names and self.card is not None else "name" if tag in ("h1", "h2", "h3", "h4") and self.card is not None else ""
            self.open.append((tag, role, len(self.blocks)))
            if role == "card":
                self.card = {"name": "", "price": ""}
        kind = a.get("type") or ""
        if tag == "script" and ("ld+json" in kind or kind == "application/json"):
            self.ld = True
            (self.linked if "ld+json" in kind else self.products).append("")
            self.into = self.linked if "ld+json" in kind else self.products
        elif tag in CHROME:
            self.skip += 1
        elif tag in ("del", "s", "strike"):
            self.struck += 1
        elif tag in ("td", "th", "li", "p", "h1", "h2", "h3", "h4", "tr"):
            self.flush()
            self.kind = tag
            if tag == "tr":
                self.cells = []

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while True:  # elements left open end with the one around them
                t, role, start = self.open.pop()
                if t in WHOLE:
                    self.drop(t, start)
                if role == "card":
                    self.cards.append(self.card)
                    self.card = None
                if t == tag:
                    break
        if tag == "script" and self.ld:
            self.ld = False
        elif tag in CHROME:
            self.skip = max(0, self.skip - 1)
        elif tag in ("del", "s", "strike"):
            self.struck = max(0, self.struck - 1)
        elif tag in ("td", "th"):
            self.cells.append(self.take())
            self.kind = "tr"
        elif tag == "tr":
            self.blocks.append(("table", self.cells))
            self.cells, self.kind = [], ""
        elif tag in ("li", "p", "h1", "h2", "h3", "h4"):
            self.flush()

    def handle_data(self, data):
        if self.ld:
            self.into[-1] += data
        elif not self.skip and not self.struck:
            self.text.append(data)
            if self.card is not None:
                role = next((r for _, r, _ in reversed(self.open) if r), "")
                if role in ("name", "price"):
                    self.card[role] = f"{self.card[role]} {data.strip()}".strip()

    def drop(self, tag: str, start: int) -> None:
        """Forgets the rows since `start`, where an element begins that just ended, if they are no own prices."""
        text = " ".join(" ".join(cells) for _, cells in self.blocks[start:]).lower()
        compares = tag == "table" and (COMPARISON.search(text) or COMPETITOR.search(text))
        if compares or (len(text) <= SMALL_PART and COMPANION.search(text)):
            del self.blocks[start:]

    def take(self) -> str:
        out, self.text = " ".join(" ".join(self.text).split()), []
        return out

    def flush(self) -> None:
        text = self.take()
        if text and self.kind not in ("td", "th", "tr"):
            self.blocks.append((self.kind or "p", [text]))
        self.kind = ""


def linked_offers(node, name: str = "") -> Iterator[tuple[str, str, str]]:
    """(label, price, currency) of all offers in a JSON-LD tree."""
    if isinstance(node, list):
        for x in node:
            yield from linked_offers(x, name)
    elif isinstance(node, dict):
        name = str(node.get("name") or name)
        price = node.get("price", node.get("lowPrice"))
        if isinstance(price, (str, int, float)) and name:
            yield name, str(price), str(node.get("priceCurrency") or "")
        for key, x in node.items():
            if isinstance(x, (dict, list)):
                yield from linked_offers(x, name)


def json_values(text: str) -> Iterator[object]:
    """All JSON values in a text, which may follow each other; what is no JSON is skipped."""
    at, decoder = 0, json.JSONDecoder()
    while (start := min((k for k in (text.find("{", at), text.find("[", at)) if k >= 0), default=-1)) >= 0:
        try:
            value, at = decoder.raw_decode(text, start)
        except ValueError:
            at = start + 1
            continue
        yield value


def product_offers(node, title: str = "") -> Iterator[tuple[str, str]]:
    """(label, price) of the variants in a shop's product JSON; whole numbers are hundredths."""
    if isinstance(node, list):
        for x in node:
            yield from product_offers(x, title)
    elif isinstance(node, dict):
        title = str(node.get("title") or title)
        variants = node.get("variants")
        if isinstance(variants, list):
            for v in variants:
                price = v.get("price") if isinstance(v, dict) else None
                if isinstance(price, (int, float, str)) and not isinstance(price, bool) and title:
                    own = str(v.get("title") or "")
                    yield (title if own in ("", "Default Title") else f"{title} - {own}"), f"{price / 100:.2f}" if isinstance(price, int) else str(price)
        for key, x in node.items():
            if key != "variants" and isinstance(x, (dict, list)):
                yield from product_offers(x, title)


def currency_columns(cells: list[str]) -> dict[int, str]:
    """Header cells that name a currency, and nothing more than that and a word for price."""
    out = {}
    for k, c in enumerate(cells):
        words = [w for w in re.split(r"[\s()/:]+", c.lower()) if w and w not in ("price", "prices", "fee", "in")]
        if len(words) == 1 and words[0] in CODES:
            out[k] = CODES[words[0]]
    return out


def page_rows(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(method, label, price text, text around) in the order JSON-LD, currency tables, tables, products, lists and paragraphs."""
    parser = Blocks()
    parser.feed(html)
    parser.flush()
    for text in parser.linked:
        for value in json_values(text):
            for label, price, currency in linked_offers(value):
                label, shown = entities.unescape(label), f"{price} {currency}".strip()
                yield "json_ld", label, shown, f"{label} {shown}"
    former: set[int] = set()
    currencies: dict[int, str] = {}
    plain = []
    for kind, cells in parser.blocks:
        if kind == "table":
            whole = " | ".join(cells)
            if not any(re.search(r"\d", c) for c in cells):
                former = {k for k, c in enumerate(cells) if re.search(r"(?i)\b(before|was|old|former)\b", c)}
                currencies = currency_columns(cells)
                continue
            # a table with a column for each of several currencies: the first one counts, nothing is converted
            first = next((k for k in sorted(currencies) if k not in former and k < len(cells)), None) if len(currencies) > 1 else None
            if first is not None and re.search(r"\d", cells[first]) and cells[0]:
                yield "currency_table", cells[0], f"{cells[first]} {currencies[first]}", whole
                continue
            prices = [(k, c) for k, c in enumerate(cells) if k and k not in former and PRICE.search(c)]
            if prices and cells[0]:
                plain.append(("table", cells[0], PRICE.search(prices[0][1])[0], whole))
        else:
            former, currencies = set(), {}
    yield from plain
    for text in parser.products:
        for value in json_values(text):
            for label, price in product_offers(value):
                yield "product", label, price, f"{label} {price}"
    for card in parser.cards:
        m = PRICE.search(card["price"])
        if m and card["name"]:
            yield "product", card["name"], m[0], f"{card['name']} {card['price']}"
    heading = ""
    for kind, cells in parser.blocks:
        if kind.startswith("h"):
            heading = cells[0]
        if kind in ("li", "p", "h2", "h3", "h4"):
            m = PRICE.search(cells[0])
            if m:
                label = cells[0][: m.start()].strip(" :–-.") or heading
                if label:
                    yield "list" if kind == "li" else "text", label, m[0], f"{heading} {cells[0]}".strip()


#: Pages that are held as Python texts with their rows at a time.
PAGES = 64


def extract(pages: DataFrame, keep: bool = False) -> DataFrame:
    """EVIDENCE of all pages; null pages have none. keep: each page has a row of its own before them, too: ord -1, method `page`, and the
    price text `read` unless the page is blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, PAGES) for whole in batches for k in range(0, whole.num_rows, PAGES)):
            rows = []
            for key, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if keep:
                    rows.append((key, url, -1, "page", "", "read" if html.strip() else "", ""))
                rows += [(key, url, n, *x) for n, x in enumerate(page_rows(html))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4), strict=True)], [c.split()[0] for c in RAW.split(", ")])

    raw = pages.filter(F.col("html").isNotNull()).select("page_id", "url", "html").mapInArrow(run, RAW)
    symbols = F.create_map(*[F.lit(x) for pair in {"$": "USD", "€": "EUR", "£": "GBP", "₺": "TRY", "¥": "JPY"}.items() for x in pair])
    code = F.coalesce(F.element_at(symbols, F.regexp_extract("price_text", "([$€£₺¥])", 1)), F.nullif(F.regexp_extract("price_text", r"\b([A-Z]{3})\b", 1), F.lit("")))
    return raw.withColumn("amount", F.get(numbers_in(F.col("price_text")), F.lit(0))).withColumn("currency", code)


def shrunk(raw, label, price, most: int = SPAN):
    """The span of `most` characters at most that holds the label and the price: from the earlier to the later, or around the price."""
    low_raw, low_label = F.lower(raw), F.lower(label)
    at, price_at = F.instr(low_raw, low_label), F.instr(raw, price)
    start = F.when((at > 0) & (at < price_at) & (price_at + F.length(price) - at <= most), at).otherwise(F.greatest(price_at - F.lit(most // 2), F.lit(1)))
    return F.trim(F.substring(raw, start, F.lit(most)))


def assembled(pages: DataFrame, title: str | None = None, keep: bool = False) -> DataFrame:
    """Evidence rows of pages with raw_evidence (the shrunk span), context, reject_reason (of scope, then ownership, then sanity; null for
    a good row) and a hash; a (page, label, amount, method) once, the first staying."""
    from offerlens.functions import sanity

    once = F.row_number().over(Window.partitionBy("page_id", F.lower("label"), "amount", "method").orderBy("ord"))
    rows = extract(pages, keep).filter((F.col("amount") > 0) | (F.col("method") == "page")).withColumn("_n", once).filter("_n = 1").drop("_n")
    rows = rows.withColumn("raw_evidence", shrunk(F.col("raw"), F.col("label"), F.col("price_text"))).withColumn("context", sanity.page_context(F.col("url"), F.col("raw"), F.lit(title or "")))
    rows = rows.withColumn("_found", sanity.places(F.col("price_text"), F.col("raw_evidence")))
    none = F.lit(None).cast("double")
    offer = sanity.Offer(F.col("amount"), F.col("price_text"), F.col("raw_evidence"), F.col("label"), F.col("currency"), F.col("url"), F.col("method"), none, F.lit(title or ""), F.lit(""), F.col("raw"), found=F.col("_found"))
    return rows.withColumn("reject_reason", sanity.reject_reason(offer, F.lit(False))).withColumn("evidence_hash", hash_id(24, F.col("url"), F.col("label"), F.col("price_text"))).drop("raw", "_found")


def evidence(pages: DataFrame) -> DataFrame:
    """extract, one row a (page, label, amount, method), the first staying; with a hash."""
    once = F.row_number().over(Window.partitionBy("page_id", F.lower("label"), "amount", "method").orderBy("ord"))
    return extract(pages).filter(F.col("amount") > 0).withColumn("_n", once).filter("_n = 1").drop("_n", "raw").withColumn("evidence_hash", hash_id(24, F.col("url"), F.col("label"), F.col("price_text")))


def markdown_to_html(text: str) -> str:
    """Headings, tables, lists and paragraphs of a markdown text as HTML; a table's row of dashes goes."""
    out, rows = [], []

    def close() -> None:
        if rows:
            head = [f"<tr>{''.join(f'<th>{c}</th>' for c in rows[0])}</tr>"]
            out.append("<table>" + "".join(head + [f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows[1:]]) + "</table>")
            rows.clear()

    for line in text.split("\n"):
        bare = re.sub(r"!?\[([^\]]*)\]\([^)]*\)|[*_`]{1,3}([^*_`]+)[*_`]{1,3}", lambda m: m[1] if m[1] is not None else m[2], line.strip())
        if bare.startswith("|"):
            cells = [entities.escape(c.strip()) for c in bare.strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
            continue
        close()
        mark = re.match(r"(#{1,6})\s+(.*)|(?:[-*+]|\d+\.)\s+(.*)", bare)
        if mark and mark[1]:
            out.append(f"<h{len(mark[1])}>{entities.escape(mark[2])}</h{len(mark[1])}>")
        elif mark:
            out.append(f"<li>{entities.escape(mark[3])}</li>")
        elif bare:
            out.append(f"<p>{entities.escape(bare)}</p>")
    close()
    return "".join(out)


@F.pandas_udf(StringType())
def html_of_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else markdown_to_html(t))


def script_literals(html: str, name: str) -> dict[str, str]:
    """Arguments of a script's state function by parameter (`name=(function(a,b){...})(1,"x")`), as JSON texts. The script is read, not run:
    arguments that are no literals end the reading."""
    m = re.search(rf"{re.escape(name)}\s*=\s*\(?\s*function\s*\(([^)]*)\)\s*\{{", html)
    if not m:
        return {}
    depth, at, quote = 1, m.end(), ""
    while at < len(html) and depth:  # to the end of the function's body
        c = html[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += (c == "{") - (c == "}")
        at += 1
    call = re.match(r"\s*\)?\s*\(", html[at:])
    if not call:
        return {}
    at, out, decoder = at + call.end(), {}, json.JSONDecoder()
    for parameter in (p.strip() for p in m[1].split(",") if p.strip()):
        at += len(html[at:]) - len(html[at:].lstrip(" \n\t,"))
        if html.startswith("void 0", at):
            value, at = None, at + 6
        else:
            try:
                value, at = decoder.raw_decode(html, at)
            except ValueError:
                break
        out[parameter] = json.dumps(value, ensure_ascii=False)
    return out


def literals_of(name: str):
    """Column function from HTML to script_literals."""

    @F.pandas_udf(MapType(StringType(), StringType()))
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else script_literals(h, name))

    return read


DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}"


def menu_date(text, label):
    """The ISO date of the menu row that holds the label: its own date, else the nearest one before it; null if there is none, or a date
    that doesn't exist."""
    from offerlens.functions.text import strict_date

    rows = F.split(text, r"\n")
    with_label = F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: F.contains(F.lower(x["r"]), F.lower(label)))
    place = F.get(with_label, F.lit(0))["i"]
    dates = F.filter(F.transform(F.slice(rows, F.lit(1), place + 1), lambda r: F.regexp_extract(r, rf"({DATE})", 1)), lambda d: d != "")
    last = F.element_at(F.when(F.size(dates) > 0, dates), -1)
    turned = F.regexp_replace(F.regexp_replace(last, r"\b(\d)(?=[./])", "0$1"), r"^(\d{2})[./](\d{2})[./](\d{4})$", "$3-$2-$1")
    return strict_date(turned)


def menu_fingerprint(text):
    """A digest of a menu without its dates and blanks: the same as long as only the date of the menu changes."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.lower(text), DATE, ""), r"\s+", " "), 256)


SERVICE = "struct<id: string, name: string, price: string, priceValue: double, currency: string, duration: string>"
LISTED = f"struct<categories: array<struct<name: string, services: array<{SERVICE}>>>, services: array<struct<id: string, name: string, price: string, priceValue: double, currency: string, duration: string, items: array<{SERVICE}>>>>"


def flatten_services(listings: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """One row a service of a listing's JSON in any of three shapes: categories with services, services with items, and flat services.
    The amount is priceValue, else the first number of the price text; what is no JSON has no rows."""
    d = listings.select(id_column, F.from_json(json_column, LISTED).alias("j"))
    one = lambda s, group: (group.alias("group"), s["id"].alias("service_id"), s["name"].alias("name"), s["price"].alias("price"), s["priceValue"].alias("value"), s["currency"].alias("currency"), s["duration"].alias("duration"))
    category = d.select(id_column, F.explode("j.categories").alias("c")).select(id_column, "c.name", F.explode("c.services").alias("s")).select(id_column, *one(F.col("s"), F.col("name")))
    service = d.select(id_column, F.explode("j.services").alias("s"))
    items = service.select(id_column, F.col("s.name").alias("name"), F.explode("s.items").alias("i")).select(id_column, *one(F.col("i"), F.col("name")))
    flat = service.filter(F.coalesce(F.size("s.items"), F.lit(0)) <= 0).select(id_column, *one(F.col("s"), F.lit(None).cast("string")))
    amount = F.coalesce(F.when(F.col("value") > 0, F.col("value")), F.get(numbers_in(F.col("price")), F.lit(0)))
    return category.unionByName(items).unionByName(flat).withColumn("amount", amount).drop("value")


def looks_like_shell(html):
    """A page that scripts fill: little text, some script."""
    from offerlens.functions.text import strip_tags

    return (F.length(strip_tags(html)) < 200) & F.lower(html).contains("<script")


def expand_variants(services: DataFrame) -> DataFrame:
    """Service rows and their variants as one row a priced item; variants inherit the service's name, never a price."""
    base = F.array(F.struct(F.col("name").alias("label"), F.col("price").alias("amount")))
    variants = F.transform(F.coalesce("variants", F.array()), lambda v: F.struct(F.concat_ws(" - ", "name", v["name"]).alias("label"), v["price"].alias("amount")))
    return services.select("service_id", F.posexplode(F.concat(base, variants)).alias("ord", "item")).select("service_id", F.col("ord").cast("long").alias("ord"), "item.*").filter(F.col("amount") > 0)
