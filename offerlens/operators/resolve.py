"""Identity, merging and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_dedupe(df: DataFrame, group: list[str], order: list[str], keys: str) -> DataFrame:
    """Rows of each group in order, dropping one if any of its keys was seen; a dropped row's other keys stay unseen.

    This is not transitive: components would give another answer, so that rows of a group are taken in order. Of rows with equal
    keys only the first can stay, which a partial aggregate finds; the rest streams over sorted partitions, holding the keys of
    one group. Rows without keys (or with null for them) all stay."""
    columns = [*group, *order, keys]
    known = F.array_sort(F.array_compact(F.array_distinct(keys)))
    rows = df.select(*columns).withColumn("_known", known)
    plain = F.coalesce(F.size("_known"), F.lit(0)) <= 0
    first = rows.filter(~plain).groupBy(*group, "_known").agg(F.min(F.struct(*order, keys)).alias("_r")).select(*group, "_r.*", "_known")
    sorted_rows = first.unionByName(rows.filter(plain)).repartition(*group).sortWithinPartitions(*group, *order, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for batch in batches:
            stay = []
            for *of, own in zip(*(batch.column(g).to_pylist() for g in group), batch.column("_known").to_pylist(), strict=True):
                if of != now:
                    now, seen = of, set()
                stay.append(not own or seen.isdisjoint(own))
                if stay[-1]:
                    seen.update(own or ())
            yield batch.filter(pa.array(stay, pa.bool_())).select(columns)

    return sorted_rows.mapInArrow(run, df.select(*columns).schema)


def conflict_winner(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The winning row a key with n_rows and n_conflicts (rows that differ from the winner in price); a partial aggregate."""
    win = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order))))
    return df.groupBy(*keys).agg(win.alias("_win"), F.count("*").alias("n_rows")).select(*keys, "_win.*", "n_rows")


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], precedence: list[str], ties: list[str] = ()) -> DataFrame:
    """Union of both sides, the row with the highest precedence a key; new before old on equal terms, then the highest ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keyed_winner(both, keys, [*precedence, "_side", *ties]).drop("_side")


def keyed_winner(rows: DataFrame, keys: list[str], precedence: list[str]) -> DataFrame:
    """The row with the highest precedence a key; a partial aggregate in one pass, for sides that lie in one table as well."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*precedence))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def coalesce_upsert(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join: a patched value wins where it is given, others stay."""
    rest = [c for c in old.columns if c not in keys]
    p = patch.withColumnsRenamed({c: f"_{c}" for c in rest})
    return old.join(p, keys, "full_outer").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def overwrite_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def patch_map(old: Column, key: Column, value: Column) -> Column:
    """The map with one entry set; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(key, value))


def ordered_union_distinct(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in the frames' order; of equal keys the first frame's row stays. source is its frame's number."""
    both = None
    for k, f in enumerate(frames):
        tagged = f.withColumn("source", F.lit(k).cast("long"))
        both = tagged if both is None else both.unionByName(tagged)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "source").alias("_r")).select(key, "_r.*")


def overlay(base: DataFrame, extra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join that fills null columns of base."""
    e = extra.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    kept = [c for c in base.columns if c not in columns]
    return base.join(e, keys, "left").select(*kept, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def overlay_first(base: DataFrame, extra: DataFrame, id_column: str, keys: str, order: str, useful: Column, columns: list[str]) -> DataFrame:
    """base with the columns of the first useful extra row (by `order`) that shares any of its keys; what is null there stays as it is.

    Both sides' keys are exploded. Of the extra rows of a key only the first can be wanted, which a partial aggregate finds before the join, so
    that a hot key makes no pairs; a base row without such a row stays."""
    asked = base.select(F.col(id_column).alias("_id"), F.explode(keys).alias("_key"))
    value = F.struct(*(F.col(c).alias(f"_{c}") for c in columns))
    filed = extra.filter(F.coalesce(useful, F.lit(False))).select(F.explode(keys).alias("_key"), F.col(order).alias("_order"), value.alias("_r"))
    filed = filed.groupBy("_key").agg(F.min_by("_r", "_order").alias("_r"), F.min("_order").alias("_order"))
    first = asked.join(filed, "_key").groupBy("_id").agg(F.min_by("_r", "_order").alias("_r"))
    kept = [c for c in base.columns if c not in columns]
    return base.join(first, base[id_column] == first["_id"], "left").select(*kept, *(F.coalesce(f"_r._{c}", c).alias(c) for c in columns))


def canonical_place(df: DataFrame, place: str, aliases: DataFrame, metros: DataFrame) -> DataFrame:
    """df with canonical: the city that the folded place is an alias of (aliases: alias, city), then the metropolis that this city is a
    part of (metros: part, city); the place as it is without an alias. Equi-joins on folded names; aliases have a row an alias."""
    from offerlens.functions.text import fold_place

    a = aliases.select(fold_place(F.col("alias")).alias("_a"), F.col("city").alias("_city")).groupBy("_a").agg(F.min("_city").alias("_city"))
    m = metros.select(fold_place(F.col("part")).alias("_m"), F.col("city").alias("_metro")).groupBy("_m").agg(F.min("_metro").alias("_metro"))
    named = df.withColumn("_a", fold_place(F.col(place))).join(a, "_a", "left").withColumn("_city", F.coalesce("_city", F.trim(place))).withColumn("_m", fold_place(F.col("_city")))
    return named.join(m, "_m", "left").withColumn("canonical", F.coalesce("_metro", "_city")).drop("_a", "_m", "_city", "_metro")


def near_places(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs within km: an equi-join on grid cells (right rows are filed under their neighbours' cells too), then the distance.

    Bands of latitude are km high. In each band the cells are as wide in degrees as km needs at its latitude farthest from the
    equator, and go around the globe, so that neither the poles nor the 180th meridian loses a pair."""
    from offerlens.functions.text import haversine_km

    height = km / 111.0
    band = lambda lat: F.floor((lat + 90) / height)

    def cells(y: Column) -> Column:
        """Cells around the globe in band y: none narrower than km at the band's latitude farthest from the equator, or next to it."""
        edge = F.greatest(F.abs((y - 1) * height - 90), F.abs((y + 2) * height - 90))
        return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height), F.lit(1)).cast("long")

    column = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1)
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    r = right.withColumn("_y", F.explode(F.transform(steps, lambda d: band(F.col("lat_r")) + d))).withColumn("_n", cells(F.col("_y")))
    r = r.withColumn("_x", F.explode(F.array_distinct(F.transform(steps, lambda d: F.pmod(column(F.col("lon_r"), F.col("_n")) + d, F.col("_n")))))).drop("_n")
    own = left.withColumn("_y", band(F.col("lat_l"))).withColumn("_x", column(F.col("lon_l"), cells(F.col("_y"))))
    distance = haversine_km(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    return own.join(r, ["_x", "_y"]).withColumn("km", distance).filter(F.col("km") <= km).drop("_x", "_y")


def tolerance_binding(labels: DataFrame, records: DataFrame, keys: list[str], low: str, high: str, value: str, tolerance: float = 0.011) -> DataFrame:
    """labels with the value of the records that have the same keys and both bounds within the tolerance: `bound` if all have one
    value, and `ambiguous` if they have several. Bounds are filed under cells of twice the tolerance, so that the join is an
    equi-join; records are filed under the neighbouring cells, too. labels' rows are told apart by _row, which is added."""
    cell = lambda c: F.floor(F.col(c) / (2 * tolerance))
    near = lambda c: F.array(cell(c) - 1, cell(c), cell(c) + 1)
    named = labels.withColumn("_row", F.struct(*keys, low, high))
    asked = named.select("_row").distinct().select("_row", *(F.col(f"_row.{k}").alias(k) for k in keys), F.col(f"_row.{low}").alias("_a"), F.col(f"_row.{high}").alias("_b")).withColumn("_x", cell("_a")).withColumn("_y", cell("_b"))
    filed = records.select(*keys, F.col(low).alias("_c"), F.col(high).alias("_d"), F.col(value).alias("_v")).withColumn("_x", F.explode(near("_c"))).withColumn("_y", F.explode(near("_d")))
    met = asked.join(filed, [*keys, "_x", "_y"]).filter((F.abs(F.col("_a") - F.col("_c")) <= tolerance) & (F.abs(F.col("_b") - F.col("_d")) <= tolerance))
    found = met.groupBy("_row").agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    out = named.join(found, "_row", "left").withColumn("bound", F.when(F.col("_least") == F.col("_most"), F.col("_least")))
    return out.withColumn("ambiguous", F.coalesce(F.col("_least") != F.col("_most"), F.lit(False))).drop("_row", "_least", "_most")


def first_by_chain(wanted: DataFrame, stored: DataFrame, key: str, chain: list[Column], id_column: str) -> DataFrame:
    """wanted with the stored row of the first key of its chain that is stored: an equi-join on all keys, then the first."""
    asked = wanted.select(id_column, F.posexplode(F.array(*chain)).alias("_at", key)).filter(F.col(key).isNotNull())
    rest = [c for c in stored.columns if c != key]
    hit = asked.join(stored, key).groupBy(id_column).agg(F.min_by(F.struct(F.col(key).alias("found_key"), *rest), "_at").alias("_r"))
    return wanted.join(hit.select(id_column, "_r.*"), id_column, "left")


def url_match(left: DataFrame, right: DataFrame, key: str, order: str, suffix: int = 24) -> DataFrame:
    """left (with `url` and key) and the first right row (by `order`) of the same normalised url; rows without one get the first
    right row whose url ends with the same `suffix` characters. Both steps are equi-joins."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(?:www\.)?", ""), r"[?#].*$|/+$", "")
    l, r = left.withColumn("_u", bare("url")), right.withColumn("_u", bare("url"))  # noqa: E741
    first = lambda d, on: d.groupBy(on).agg(F.min(order).alias("matched"))
    exact = l.join(first(r, "_u"), "_u", "left")
    tail = F.when(F.length("_u") >= suffix, F.right("_u", F.lit(suffix)))
    loose = exact.filter("matched is null").drop("matched").withColumn("_t", tail).join(first(r.withColumn("_t", tail).filter("_t is not null"), "_t"), "_t", "left")
    both = exact.filter("matched is not null").withColumn("how", F.lit("url"))
    return both.unionByName(loose.drop("_t").withColumn("how", F.when(F.col("matched").isNotNull(), "suffix"))).drop("_u")
