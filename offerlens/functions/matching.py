"""Labels to families: first-match vocabularies with confidence and rejection, subtypes, pools, and the score of evidence.

Vocabularies are parameters: rows of (family, canonical, confidence, pattern) in order, competing cues of (requested family, reason,
pattern) in order, and pairs of families that go together. Labels are matched folded. All native.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.rules import first_reason
from offerlens.functions.text import fold_spaced
from offerlens.operators.rank import ordered_fold

#: What a way of extraction adds to an evidence's score.
METHOD_BOOSTS = {"table": 0.12, "list": 0.12, "product": 0.12, "json_ld": -0.05, "text": -0.1}


def label_match(label: Column, requested: Column, vocabulary: Sequence[tuple[str, str, float, str]], competing: Sequence[tuple[str, str, str]] = (), together: Sequence[tuple[str, str]] = ()) -> dict[str, Column]:
    """family, canonical, confidence and reject of a label.

    An empty label is rejected, then one that a competing cue of the requested family fits (`*`: of any family), then the first
    vocabulary row decides; a family that doesn't go with the requested one is named but rejected. Without a match: `other`."""
    t = F.coalesce(fold_spaced(label), F.lit(""))
    rival = first_reason([(reason, (F.lit(True) if of == "*" else requested == of) & t.rlike(pattern)) for of, reason, pattern in competing]) if competing else F.lit(None).cast("string")
    early = F.when(t == "", F.lit("empty_label")).otherwise(rival)
    found = F.coalesce(*(F.when(t.rlike(p), F.struct(F.lit(f).alias("family"), F.lit(c).alias("canonical"), F.lit(float(x)).alias("confidence"))) for f, c, x, p in vocabulary))
    family = F.when(early.isNull(), F.coalesce(found["family"], F.lit("other"))).otherwise(F.lit("other"))
    fits = (requested == family) | requested.isNull() | requested.isin("", "other") | (family == "other")
    for want, got in together:
        fits = fits | ((requested == want) & (family == got))
    reject = F.coalesce(early, F.when(~F.coalesce(fits, F.lit(True)), F.concat(F.lit("wrong_family_"), family)))
    return {"family": family, "canonical": F.when(early.isNull(), F.coalesce(found["canonical"], F.lit(""))).otherwise(F.lit("")), "confidence": F.when(reject.isNull(), F.coalesce(found["confidence"], F.lit(0.0))).otherwise(F.lit(0.0)), "reject": reject}


def subtype(text: Column, kinds: Sequence[tuple[str, str]], generic: str) -> Column:
    """The one kind whose cue the text has; `mixed` with several, `generic` with none or if the text says no more than `generic`."""
    t = F.coalesce(fold_spaced(text), F.lit(""))
    has = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in kinds)))
    return F.when(t.rlike(generic) | (F.size(has) == 0), F.lit("generic")).when(F.size(has) > 1, F.lit("mixed")).otherwise(F.get(has, F.lit(0)))


def subtype_fits(row: Column, wanted: Column) -> Column:
    """A generic row fits nothing; a mixed or generic request takes every other row."""
    return (row != "generic") & (wanted.isin("mixed", "generic") | (row == wanted) | (row == "mixed"))


def pool_decision(label: Column, match: dict[str, Column], kind: Column, pools: dict[str, str], eligible: Column, least: float = 0.75) -> dict[str, Column]:
    """The pool that a service goes to, and why it goes to none: empty, the match's own reason, unknown, a generic subtype, no pool, or
    a relation that isn't eligible."""
    by = F.create_map(*(F.lit(x) for pair in pools.items() for x in pair))
    pool = F.coalesce(F.element_at(by, F.concat_ws(":", match["family"], kind)), F.element_at(by, match["canonical"]), F.element_at(by, match["family"]))
    unknown = (match["family"] == "other") | (match["confidence"] < least)
    named = F.coalesce(F.when(F.trim(F.coalesce(label, F.lit(""))) == "", F.lit("empty")), match["reject"])
    reason = F.coalesce(named, first_reason([("unknown_procedure", unknown), ("generic_subtype", kind == "generic"), ("no_pool_key", pool.isNull()), ("relation", ~eligible)]))
    return {"pool": F.when(reason.isNull(), pool), "reason": reason}


def evidence_score(confidence: Column, method: Column, bonuses: Sequence[tuple[float, Column]] = (), boosts: dict[str, float] = METHOD_BOOSTS) -> Column:
    """confidence, what the way of extraction adds, and the weights of the predicates that hold."""
    boost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair)), method), F.lit(0.0))
    return confidence + boost + sum((F.when(F.coalesce(p, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0)) for w, p in bonuses), F.lit(0.0))


def best_evidence(rows: DataFrame, keys: list[str], order: list[str], score: str, amount: str, keeps: str, value: list[str]) -> DataFrame:
    """The best row a key: rows in order, a higher score wins, and of equal scores the lower amount, unless the row at hand has
    `keeps` (it is no full treatment: a part, a unit) and the best so far has not."""
    packed = rows.withColumn("_v", F.struct(score, amount, keeps, *value))

    def better(a: Column, r: Column) -> Column:
        a, r = a["_v"], r["_v"]
        return (r[score] > a[score]) | ((r[score] == a[score]) & (r[amount] < a[amount]) & ~(r[keeps] & ~a[keeps]))

    return ordered_fold(packed, keys, order, "_v", better).select(*keys, *(F.col(f"best._v.{c}").alias(c) for c in [score, amount, *value]))
