"""Ordering, top-k and selection: every ranking ends in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representative(df: DataFrame, keys: list[str], score: Column, ties: list[Column]) -> DataFrame:
    """One row a key: the highest score, then the least ties. An aggregate with a partial step, so that a hot key costs no sort."""
    order = F.struct((-score).alias("s"), *(t.alias(f"t{k}") for k, t in enumerate(ties)))
    row = F.min_by(F.struct(*df.columns), order)
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each key, numbered; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def top_with_rest(counts: DataFrame, label: str, value: str, k: int, rest: str = "Other") -> DataFrame:
    """The k largest labels and the sum of the others; counts has a row a label."""
    top = counts.orderBy(F.desc(value), label).limit(k).select(F.col(label).alias("_top"))  # k rows; each partition puts out its k at most
    named = counts.join(F.broadcast(top), counts[label].eqNullSafe(top["_top"]), "left")
    return named.groupBy(F.when(F.col("_top").isNotNull(), F.col(label)).otherwise(F.lit(rest)).alias(label)).agg(F.sum(value).alias(value))


def quota_mix(saved: DataFrame, live: DataFrame, key: str, order: list[str], first: int, total: int) -> DataFrame:
    """The first `first` saved rows, then live ones, then what is left of the saved; a key once; `total` rows in all."""
    number = lambda d: d.withColumn("_n", F.row_number().over(Window.orderBy(*order, key)))
    top = lambda d: d.orderBy(*order, key).limit(total + first)  # noqa: E731  more can't be chosen
    s = number(top(saved)).withColumn("_tier", F.when(F.col("_n") <= first, 0).otherwise(2))
    both = s.unionByName(number(top(live)).withColumn("_tier", F.lit(1)))
    once = both.withColumn("_once", F.row_number().over(Window.partitionBy(key).orderBy("_tier", "_n"))).filter("_once = 1")
    slot = F.row_number().over(Window.orderBy("_tier", "_n")).cast("long")
    return once.withColumn("slot", slot).filter(F.col("slot") <= total).drop("_n", "_tier", "_once")


def fair_rotation(df: DataFrame, exposure: str, key: str, seed: int, k: int) -> DataFrame:
    """k rows that were shown least; equals in an order drawn from the seed."""
    return df.orderBy(exposure, F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def rotated(df: DataFrame, market: list[str], key: str, seed: int, k: int) -> DataFrame:
    """df (exposure, sibling) with shown, k rows a market, and the exposure behind it: the state that the next run takes in.

    The least shown come first, then those that a sibling tab doesn't show, equals by a digest of seed and key that any engine gives alike. Only k
    rows a market are ranked whole: the others are cut in the tasks before a market's rows meet, and come back by a join."""
    draw = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")).cast("binary"))
    order = Window.partitionBy(*market).orderBy("exposure", "sibling", draw, key)
    chosen = df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).select(*market, key, F.lit(True).alias("_shown"))
    shown = F.coalesce("_shown", F.lit(False))
    return df.join(chosen, [*market, key], "left").withColumn("shown", shown).withColumn("exposure", F.col("exposure") + F.col("shown").cast("long")).drop("_shown")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], value: str, better) -> DataFrame:
    """Per key, the running best over rows in order, where better(best, row) may depend on the best so far. Groups are bounded
    lists (a provider's or a page's evidence), folded natively."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    best = F.aggregate(F.slice(F.col("_rows"), 2, F.size("_rows")), F.get("_rows", F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, best.alias("best"))
