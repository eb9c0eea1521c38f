"""Ordered rules: the first predicate that holds names the reason, the first pattern that fits names the class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that is true; null if none is. A rule that is null counts as false."""
    return F.coalesce(*(F.when(F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in rules))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first (needle, label) that the text contains."""
    found = [F.when(F.contains(text, F.lit(needle)), F.lit(label)) for needle, label in rules]
    return F.coalesce(*found, F.lit(default).cast("string"))


def first_match_join(df: DataFrame, text: str, rules: DataFrame, key: str) -> DataFrame:
    """df with the label of the first rule (priority, needle, label) that its text contains, for rule tables too long for a
    literal chain; df rows are told apart by key.

    Rules are filed under their rarest run of GRAM characters (shorter needles under themselves), so that a text meets by an
    equi-join on its own runs only rules that may be in it; only these are looked for. An empty needle is in no text."""
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, F.lit(n)))
    sizes = range(1, GRAM + 1)
    of_size = lambda c, n: F.when(F.length(c) >= n, runs(c, n))
    needle = F.col("needle")
    own = F.coalesce(*(F.when(F.length(needle) >= n, of_size(needle, n)) for n in reversed(sizes)))
    filed = rules.filter(F.length(needle) > 0).select("priority", "needle", "label", F.explode(F.array_distinct(own)).alias("_run"))
    uses = filed.groupBy("_run").agg(F.count("*").alias("_uses"))
    index = filed.join(uses, "_run").groupBy("priority", "needle", "label").agg(F.min(F.struct("_uses", "_run")).alias("_best")).select("priority", "needle", "label", F.col("_best._run").alias("_run"))
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(of_size(F.col(text), n), F.array().cast("array<string>")) for n in sizes))))
    met = df.select(key, text, F.explode(every).alias("_run")).join(index, "_run").filter(F.contains(F.col(text), needle))
    hits = met.groupBy(key).agg(F.min_by("label", "priority").alias("label"))
    return df.join(hits, key, "left")


#: Characters of the runs that needles are filed under; rows of bands that are broadcast at most.
GRAM, BROADCAST_RULES = 3, 5_000


def band_join(df: DataFrame, bands: DataFrame, key: str, amount: str) -> DataFrame:
    """df with plausible: whether the amount lies in its key's (lo, hi); without a band for the key it is plausible."""
    banded = df.join(F.broadcast(bands) if bands.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else bands, key, "left")
    return banded.withColumn("plausible", F.coalesce(F.col(amount).between(F.col("lo"), F.col("hi")), F.lit(True)))
