"""Curated price files: nested JSON with a header, providers and their priced services, flattened to one row an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.rules import first_reason
from offerlens.functions.text import hash_id, host, name_key, path_depth, positive

TEXTS = ["name", "category", "currency", "unit", "price_type", "source_url", "source_type", "checked_at", "note"]
NUMBERS = ["price", "price_min", "price_max", "regular_price", "member_price", "package_sessions"]
SERVICE = ", ".join([*(f"{c}: string" for c in TEXTS), *(f"{c}: double" for c in NUMBERS)])
PLACE = "address: string, city: string, country: string, country_code: string, zip: string"
CLINIC = f"name: string, website: string, phone: string, location: struct<{PLACE}>, rating: struct<value: double, review_count: bigint>, source_urls: array<string>, procedures: array<struct<{SERVICE}>>"
SCHEMA = f"checked_at string, market string, currency_default string, clinics array<struct<{CLINIC}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a service, provider and header beside it; providers without services keep one row."""
    return exploded(spark.read.option("multiLine", True).schema(SCHEMA).json(path))


def exploded(files: DataFrame) -> DataFrame:
    """read for files that are rows (of SCHEMA) already."""
    head = files.select("checked_at", "market", "currency_default", F.posexplode_outer("clinics").alias("clinic_ord", "clinic"))
    return head.select("*", F.posexplode_outer("clinic.procedures").alias("ord", "service"))


def resolve_price(price: Column, low: Column, high: Column, regular: Column, member: Column) -> dict[str, Column]:
    """Shown price: the first positive of price, regular, low and member; a maximum only above it."""
    shown = F.coalesce(positive(price), positive(regular), positive(low), positive(member))
    top = F.when(positive(high) > shown, high)
    return {"amount": shown, "amount_max": top}


#: Unit tokens that make a price one for each, and stated types that make it a promotion (both parameters of price_type).
UNIT_TOKENS = ("unit", "units", "ml", "cc", "syringe", "syringes", "vial", "vials", "session", "sessions", "graft", "grafts", "thread", "threads")
AREA_TOKENS = ("area", "areas", "zone", "zones", "region", "regions")
PROMOTIONS = ("introductory", "special", "sale")


def price_type(stated: Column, unit: Column, has_range: Column, regular: Column, shown: Column, units=UNIT_TOKENS, areas=AREA_TOKENS, promotions=PROMOTIONS) -> Column:
    """approximate, per_unit, per_area, range, from, sale, fixed: the first that applies. A sale is a stated promotion or a regular
    price above the shown one."""
    kind, token = F.lower(F.trim(stated)), unit_parts(unit)["unit_token"]
    return F.coalesce(
        F.when(kind == "approximate", F.lit("approximate")), F.when(token.isin(*units), F.lit("per_unit")), F.when(token.isin(*areas), F.lit("per_area")),
        F.when(has_range, F.lit("range")), F.when(kind == "from", F.lit("from")),
        F.when(kind.isin(*promotions) | (positive(regular) > shown), F.lit("sale")), F.lit("fixed"),
    )


def unit_parts(unit: Column) -> dict[str, Column]:
    """Quantity and token of a label like `per 2 areas`."""
    bare = F.regexp_replace(F.lower(F.trim(unit)), r"^per\s+", "")
    return {"unit_quantity": F.regexp_extract(bare, r"^(\d+(?:\.\d+)?)", 1).try_cast("double"), "unit_token": F.regexp_extract(bare, r"^(?:\d+(?:\.\d+)?\s*)?(.*)$", 1)}


def offers(rows: DataFrame) -> DataFrame:
    """One row a service with its provider, price and skip_reason (null: a good offer)."""
    s, c = "service.", "clinic."
    got = resolve_price(*(F.col(s + x) for x in ("price", "price_min", "price_max", "regular_price", "member_price")))
    flat = rows.filter(F.col("clinic").isNotNull() & F.col("service").isNotNull()).select(
        "clinic_ord", "ord", F.col(c + "name").alias("provider"), host(F.col(c + "website")).alias("website_host"), F.col(c + "location.city").alias("city"),
        F.upper(F.coalesce(F.col(c + "location.country_code"), F.lit("US"))).alias("country_code"),
        F.concat_ws(", ", F.filter(F.array(c + "location.address", c + "location.city", c + "location.zip"), lambda x: x != "")).alias("address"),
        F.coalesce(F.col(c + "rating.value"), F.lit(0.0)).alias("rating"), F.coalesce(F.col(c + "rating.review_count"), F.lit(0)).alias("rating_count"),
        F.col(s + "name").alias("service_name"), F.col(s + "category").alias("category"), F.coalesce(F.col(s + "currency"), F.col("currency_default")).alias("currency"),
        got["amount"].alias("amount"), got["amount_max"].alias("amount_max"), F.col(s + "unit").alias("unit"),
        price_type(F.col(s + "price_type"), F.col(s + "unit"), got["amount_max"].isNotNull(), F.col(s + "regular_price"), got["amount"]).alias("price_type"),
        F.coalesce(F.lower(F.trim(s + "price_type")).isin(*PROMOTIONS) | (positive(F.col(s + "regular_price")) > got["amount"]), F.lit(False)).alias("is_promotional"), (F.col(s + "package_sessions") > 1).alias("is_package"),
        F.col(s + "source_url").alias("source_url"), F.coalesce(F.col(s + "checked_at"), F.col("checked_at")).alias("checked_at"),
    )
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    reason = first_reason([("missing_name", blank(F.col("service_name"))), ("missing_source_url", blank(F.col("source_url"))), ("no_numeric_price", F.col("amount").isNull())])
    key = hash_id(16, name_key(F.col("city")), name_key(F.col("provider")), name_key(F.col("service_name")), F.coalesce("unit", F.lit("")), F.col("price_type"))
    return flat.withColumns(unit_parts(F.col("unit"))).withColumn("skip_reason", reason).withColumn("offer_id", key).withColumn("depth", path_depth(F.col("source_url")))


def winners(good: DataFrame) -> DataFrame:
    """One row an offer_id: the deeper source path, then the narrower range, then the first; with its number of conflicting rows."""
    order = F.struct(-F.col("depth"), F.coalesce(F.col("amount_max") - F.col("amount"), F.lit(0.0)), "clinic_ord", "ord")
    win = F.min_by(F.struct(*[c for c in good.columns if c != "offer_id"]), order)
    return good.groupBy("offer_id").agg(win.alias("_w"), F.count("*").alias("n_rows"), F.count_distinct("amount").alias("n_prices")).select("offer_id", "_w.*", "n_rows", "n_prices")
