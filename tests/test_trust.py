"""Sanity, matching, identity and extraction functions on nulls, empties and edges."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import evidence, identity, matching, occurrences, sanity
from offerlens.operators import resolve
from offerlens.sources import pages


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(x, kind="string"):
    return F.lit(x).cast(kind)


def offer(**given):
    names = ("price", "text", "label", "currency", "url", "method", "requested", "provider", "page_text")
    return sanity.Offer(amount=text(given.get("amount"), "double"), amount_max=text(given.get("amount_max"), "double"), **{n: text(given.get(n)) for n in names})


def test_a_row_of_nulls_has_a_reason(spark):
    assert value(spark, sanity.reject_reason(offer(), F.lit(None).cast("boolean"))) == "missing_price_semantics"
    assert value(spark, sanity.reject_reason(offer(amount=90.0, currency="EUR"), F.lit(True))) is None
    assert value(spark, sanity.needs_reselect(offer(), F.lit(False))) is False


def test_the_first_reason_wins_in_the_stated_order(spark):
    """A row with everything wrong gets the reasons one by one, in the order of the list, as each is left out."""
    o = offer(amount=2024.0, price="call +44 20 7946 0958", text="lorem ipsum how much 2024? gift card elsewhere i paid", label="add to cart", url="https://a.example/search/x", method="text", requested="peel")
    rules = sanity.reasons(o, F.lit(True))
    holds = [name for name, p in rules if value(spark, F.coalesce(p, F.lit(False)))]
    assert holds[:2] == ["product_not_procedure", "marketplace_category"] and {"non_treatment_label", "theme_placeholder", "phone_number", "patient_anecdote", "competitor_quote"} <= set(holds)
    assert value(spark, sanity.reject_reason(o, F.lit(True))) == holds[0]


@pytest.mark.parametrize(("source", "amount", "found"), [("€1,250", 1250.0, True), ("1.250 EUR", 1250.0, True), ("€ 11250", 1250.0, False), ("1250 minutes", 1250.0, False), ("eur 1250.00", 1250.0, True), ("", 5.0, False), ("€99.99", 99.5, False), ("€99.50", 99.5, True), ("129,50 €", 129.5, True), ("€1,299.50", 1299.5, True)])
def test_amount_beside_a_currency(spark, source, amount, found):
    assert value(spark, sanity.has_currency(occurrences.of_amount(occurrences.occurrences(text(source)), text(amount, "double")))) is found


@pytest.mark.parametrize(("price", "amount", "hint"), [("£5,000 - £8,000", 5000.0, 8000.0), ("90", 90.0, 90.0), ("100-50", 100.0, 100.0), (None, 7.0, 7.0)])
def test_max_hint(spark, price, amount, hint):
    assert value(spark, sanity.max_hint(text(price), text(amount, "double"))) == hint


def test_label_match_of_nothing(spark):
    got = matching.label_match(text(None), text(None), [("a", "b", 0.9, "x")])
    assert [value(spark, got[k]) for k in ("family", "canonical", "confidence", "reject")] == ["other", "", 0.0, "empty_label"]


@pytest.mark.parametrize(("row", "wanted", "fits"), [("hair", "hair", True), ("generic", "hair", False), ("skin", "hair", False), ("skin", "mixed", True), ("mixed", "skin", True), ("generic", "mixed", False)])
def test_subtype_fits(spark, row, wanted, fits):
    assert value(spark, matching.subtype_fits(text(row), text(wanted))) is fits


@pytest.mark.parametrize(("a", "b", "same"), [("The Rose Clinic", "Rose Ltd", True), ("Rose", "Rosewood", False), ("Rosewood", "Rosewood Garden", True), ("", "", False), (None, "Rose", False)])
def test_same_name(spark, a, b, same):
    assert value(spark, identity.same_name(text(a), text(b))) is same


@pytest.mark.parametrize(("a", "b", "near"), [("Main Street 5", "5 main street, Rome", True), ("Main", "Main Road", True), ("Main Street", "Main Road", False), ("1", "1", False), (None, "x", False)])
def test_address_overlap(spark, a, b, near):
    assert value(spark, identity.address_overlap(text(a), text(b))) is near


def test_convert_and_bands(spark):
    assert value(spark, identity.convert(F.lit(90.0), text("eur"), text("TRY"), {"EUR": 0.9, "TRY": 30.0})) == pytest.approx(3000.0)
    assert value(spark, identity.convert(F.lit(90.0), text("???"), text(None), {"EUR": 0.9})) == 90.0


@pytest.mark.parametrize(("label", "unit", "quantity"), [("per 2 areas", "area", 2.0), ("90 / syringe", "syringe", None), ("1.5ml", "ml", 1.5), ("units", None, None), ("", None, None), (None, None, None)])
def test_unit_of(spark, label, unit, quantity):
    got = evidence.unit_of(text(label))
    assert (value(spark, got["unit"]), value(spark, got["quantity"])) == (unit, quantity)


def test_patch_map(spark):
    old = F.create_map(F.lit("a"), F.lit("1"))
    assert value(spark, resolve.patch_map(old, F.lit("a"), F.lit("2"))) == {"a": "2"} and value(spark, resolve.patch_map(F.lit(None).cast("map<string,string>"), F.lit("b"), F.lit("2"))) == {"b": "2"}


@pytest.mark.parametrize(("script", "want"), [("S=(function(a,b){return a}(1,\"x\"))", {"a": "1", "b": '"x"'}), ("S = function(a){ var s='}'; return {x:[a]} }([1, 2])", {"a": "[1, 2]"}), ("S=(function(a,b){}(1,f()))", {"a": "1"}), ("S=1", {}), ("S=(function(a){", {}), ("", {})])
def test_script_literals(script, want):
    assert pages.script_literals(script, "S") == want


def test_markdown():
    assert pages.markdown_to_html("# A & B\n| x | y |\n|---|:-:|\n| 1 | **2** |\n\ntext `code`\n- *i*\n2. [l](u)") == "<h1>A &amp; B</h1><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><p>text code</p><li>i</li><li>l</li>"
    assert pages.markdown_to_html("") == ""


def test_cards_left_open_and_broken_json():
    html = '<div class="product"><h2>Mask<div class="price">€5</div></div><script type="application/json">{"title": </script><script type="application/json">[{"title":"T","variants":[{"price":null},{"price":true},{"price":250}]}]</script>'
    rows = [(m, label, p) for m, label, p, _ in pages.page_rows(html)]
    assert ("product", "T", "2.50") in rows and all(label for _, label, _ in rows)
    assert list(pages.page_rows("")) == [] and list(pages.page_rows("<table><tr><td></td></tr></table>")) == []


def test_menu_date_of_nothing(spark):
    assert value(spark, pages.menu_date(text(None), text("x"))) is None and value(spark, pages.menu_date(text("no date"), text("no"))) is None


ROBOTS = "# x\nUser-Agent: A\nuser-agent: b\nDisallow: /p\nCrawl-delay: 5\nAllow: /p/q\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow:\n"


@pytest.mark.parametrize(("file", "agent", "path", "allowed"), [(ROBOTS, "a", "/p/x", False), (ROBOTS, "b", "/p/q/1", True), (ROBOTS, "c", "/p/x", True), (ROBOTS, "c", "/d/x.pdf", False), (ROBOTS, "c", "/x.pdf.html", True), (ROBOTS, "a", "/x.pdf", True), (None, "a", "/", True), ("", "a", "/", True), ("Disallow: /", "a", "/", True), ("user-agent: a\ndisallow: /x\nallow: /x", "a", "/x", True), (ROBOTS, "a", None, True)])
def test_robots(spark, file, agent, path, allowed):
    assert value(spark, identity.robots_allow(identity.robots_rules(text(file), agent), text(path))) is allowed
