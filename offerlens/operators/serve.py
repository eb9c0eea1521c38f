"""What a caller asks for: the price index, provider search, enqueueing, discovery plans, verification batches, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.text import name_key
from offerlens.operators.resolve import url_match


def price_index(offers: DataFrame, quarantine: DataFrame, market: list[str], source: str, order: list[Column], limit: int = 30, display: int = 4) -> DataFrame:
    """A row a market: n_candidates (all that are not quarantined, up to limit), and the first `display` of them as an array.

    The quarantine is left out by an anti-join on the source; the rank's limit is applied in each partition first."""
    live = offers.join(quarantine.select(source).distinct(), source, "left_anti")
    ranked = live.withColumn("_rn", F.row_number().over(Window.partitionBy(*market).orderBy(*order))).filter(F.col("_rn") <= limit)
    shown = F.when(F.col("_rn") <= display, F.struct("_rn", F.struct(*[c for c in offers.columns if c not in market]).alias("row")))
    rows = F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["row"])
    return ranked.groupBy(*market).agg(F.count("*").alias("n_candidates"), rows.alias("display"))


def provider_search(providers: DataFrame, fields: list[str], needle: str, order: list[Column], limit: int) -> DataFrame:
    """Providers with the folded needle in the folded fields; a top-k report."""
    return providers.filter(F.contains(name_key(F.concat_ws(" ", *fields)), name_key(F.lit(needle)))).orderBy(*order).limit(limit)


def enqueue_candidates(candidates: DataFrame, known: DataFrame, keys: dict[str, Column], blocked: Column, id_column: str) -> DataFrame:
    """candidates with decision: blocked, known (any of its keys is known) or queued. known has one column, key."""
    tagged = F.array_compact(F.array(*(F.concat(F.lit(kind + ":"), value) for kind, value in keys.items())))
    hit = candidates.select(id_column, F.explode(tagged).alias("key")).join(known.select("key").distinct(), "key", "left_semi").select(id_column).distinct().withColumn("_known", F.lit(True))
    decision = F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.col("_known"), "known").otherwise("queued")
    return candidates.join(hit, id_column, "left").withColumn("decision", decision).drop("_known")


def verify_batch(candidates: DataFrame, market: list[str], attempts: str, key: str, size: Column) -> DataFrame:
    """The least tried candidates of each market, as many as size says (bounded by its rule)."""
    return candidates.withColumn("slot", F.row_number().over(Window.partitionBy(*market).orderBy(attempts, key)).cast("long")).filter(F.col("slot") <= size)


def batch_size(pending: Column, least: int = 5, most: int = 10) -> Column:
    """A tenth of what is pending, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(pending / 10)))


def invalidate_untrusted(offers: DataFrame, reason: Column, prices: list[str], dry_run: bool = False) -> DataFrame:
    """Rows with a reason keep their identity but lose their prices, which move to legacy_ columns; dry_run only adds the reason."""
    judged = offers.withColumn("invalid_reason", reason)
    if dry_run:
        return judged
    bad = F.col("invalid_reason").isNotNull()
    kept = {f"legacy_{p}": F.when(bad, F.col(p)) for p in prices}
    return judged.withColumns(kept).withColumns({p: F.when(~bad, F.col(p)) for p in prices})


def stabilise_slots(shown: DataFrame, fresh: DataFrame, session: str, key: str, k: int) -> DataFrame:
    """Slots of each session: what is shown stays in its slot, with the fresh record where there is one; free slots are filled by
    fresh rows in order of their rank. shown: session, slot (from 1), key, value; fresh: session, key, rank, value."""
    f = fresh.select(session, key, "rank", F.col("value").alias("_fresh"))
    kept = shown.join(f, [session, key], "left").select(session, key, "slot", F.coalesce("_fresh", "value").alias("value"))
    new = fresh.join(shown.select(session, key), [session, key], "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy("rank", key))).filter(F.col("_n") <= k)
    taken = shown.groupBy(session).agg(F.array_sort(F.collect_set(F.col("slot").cast("int"))).alias("_taken"))  # up to k slots
    free = F.array_except(F.sequence(F.lit(1), F.lit(k)), F.coalesce("_taken", F.expr("cast(array() as array<int>)")))
    placed = new.join(taken, session, "left").withColumn("slot", F.get(free, F.col("_n") - 1).cast("long")).filter("slot is not null")
    return kept.unionByName(placed.select(session, key, "slot", "value"))


def one_per_category(ranked: DataFrame, category: str, key: str, score: str, n: int) -> DataFrame:
    """One key a category, none twice: categories in order take their best key that is still free.

    With n categories a category's best n keys are enough, so that at most n * n rows are folded in order."""
    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), key))).filter(F.col("_r") <= n)
    rows = best.groupBy(category).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("keys"))
    order = rows.agg(F.array_sort(F.collect_list(F.struct(category, "keys"))).alias("all"))
    none = F.filter(F.transform("all", lambda x: F.struct(x[category].alias(category), F.get(x["keys"], F.lit(0)).alias(key))), lambda x: F.lit(False))

    def take(done: Column, x: Column) -> Column:
        free = F.get(F.filter(x["keys"], lambda k: ~F.exists(done, lambda d: d[key] == k)), F.lit(0))
        return F.when(free.isNull(), done).otherwise(F.concat(done, F.array(F.struct(x[category].alias(category), free.alias(key)))))

    return order.select(F.explode(F.aggregate("all", none, take)).alias("x")).select(f"x.{category}", f"x.{key}")


def refresh_known(known: DataFrame, read: DataFrame, keys: list[str], price: str, due: Column) -> DataFrame:
    """known with the price that a page read again gives, where the row is due; state: fresh (not due), missing (the page has none),
    unchanged or refreshed. read has a row a key."""
    new = read.select(*keys, F.col(price).alias("_new"))
    both = known.withColumn("_due", F.coalesce(due, F.lit(True))).join(new, keys, "left")
    state = F.when(~F.col("_due"), "fresh").when(F.col("_new").isNull(), "missing").when(F.col("_new") == F.col(price), "unchanged").otherwise("refreshed")
    return both.withColumn("state", state).withColumn(price, F.when(F.col("state") == "refreshed", F.col("_new")).otherwise(F.col(price))).drop("_due", "_new")


def import_marketplace(venues: DataFrame, candidates: DataFrame, venue: str, candidate: str, price: str) -> DataFrame:
    """venues (with url) with their candidate by normalised url, and what becomes of them: no_price, staged (no candidate) or imported."""
    matched = url_match(venues, candidates, venue, candidate).withColumnRenamed("matched", candidate)
    decision = F.when(~F.coalesce(F.col(price) > 0, F.lit(False)), "no_price").when(F.col(candidate).isNull(), "staged").otherwise("imported")
    return matched.withColumn("decision", decision)
