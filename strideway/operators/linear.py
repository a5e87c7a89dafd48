"""Points of interest along routes: gaps between them, walking segments, and where a new one would help."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(small: DataFrame) -> DataFrame:
    return small.hint("merge")


def on_stated_scale(placed: DataFrame, routes: DataFrame, route: str = "route_id", side: Callable[[DataFrame], DataFrame] = merged) -> DataFrame:
    """placed with position_m: progress along the geometry, brought to the route's stated length (0 for a route of none). side: how routes are joined."""
    return placed.join(side(routes.select(route, "length_m", "stated_m")), route).withColumn("position_m", stated_position("length_m"))


def stated_position(length: str) -> Column:
    """progress_m of a geometry of this length on the route's stated length (stated_m)."""
    return F.when(F.col(length) > 0, F.col("progress_m") / F.nullif(length, F.lit(0.0)) * F.col("stated_m")).otherwise(0.0)


def gaps(positions: DataFrame, routes: DataFrame, point: str = "facility_id", route: str = "route_id", inside: bool = False) -> DataFrame:
    """Stretches between neighbours along each route, from its start to its end: ordinal, start_m, end_m, gap_m.

    positions: route, point, position_m; a route without any is one gap. With `inside`, positions at or beyond an end don't
    count. Every kind of point of interest can be done in one job: put the kind next to the route in both tables.
    """
    keys = [route] if isinstance(route, str) else list(route)
    rows = positions.select(*keys, F.col("position_m").alias("end_m"), F.col(point).cast("long").alias("ends_at"), F.lit(0).alias("_last"))
    if inside:
        rows = rows.join(routes.select(*keys, "stated_m").hint("merge"), keys).where("end_m > 0 and end_m < stated_m").drop("stated_m")
    ends = routes.select(*keys, F.col("stated_m").cast("double").alias("end_m"), F.lit(None).cast("long").alias("ends_at"), F.lit(1).alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_last", "end_m", "ends_at")
    out = rows.unionByName(ends).withColumn("start_m", F.lag("end_m", 1, 0.0).over(by)).withColumn("ordinal", F.row_number().over(by))
    return out.select(*keys, "ordinal", "start_m", "end_m", (F.col("end_m") - F.col("start_m")).alias("gap_m"), "ends_at")


def counted_gaps(positions: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """What gaps() gives, a row for all points at one place of a route: the gap before the first of them, and none between the others.

    positions: keys, position_m and n, how many points are there; maybe more than one row of a position. Columns: keys, n, ordinal (of the
    first of them), start_m, end_m, gap_m, next_m (the gap after, null at the end of the route) and ends (whether points end it).
    """
    rows = positions.select(*keys, F.col("position_m").alias("end_m"), F.col("n").cast("long").alias("n"), F.lit(0).alias("_last"))
    ends = routes.select(*keys, F.col("stated_m").cast("double").alias("end_m"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_last", "end_m")
    out = rows.unionByName(ends).withColumn("start_m", F.lag("end_m", 1, 0.0).over(by)).withColumn("gap_m", F.col("end_m") - F.col("start_m"))
    ordinal = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    out = out.withColumn("ordinal", ordinal).withColumn("next_m", F.lead("end_m").over(by) - F.col("end_m"))
    return out.select(*keys, "n", "ordinal", "start_m", "end_m", "gap_m", "next_m", (F.col("_last") == 0).alias("ends"))


def each_gap(counted: DataFrame) -> DataFrame:
    """counted_gaps() as a row for each point: start_m, end_m, gap_m and ordinal as gaps() has them."""
    out = counted.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    own = {"ordinal": (F.col("ordinal") + F.col("_i")).cast("int"), "start_m": F.when(F.col("_i") == 0, F.col("start_m")).otherwise(F.col("end_m")), "gap_m": F.when(F.col("_i") == 0, F.col("gap_m")).otherwise(0.0)}
    return out.withColumns(own).drop("_i", "n", "next_m", "ends")


def splits(least_m: float = 0.0) -> Column:
    """Whether a row of counted_gaps() is a rest with walks of more than least_m on both sides; where two stand at one place, neither is."""
    return F.coalesce(F.col("ends") & (F.col("n") == 1) & (F.col("gap_m") > least_m) & (F.col("next_m") > least_m), F.lit(False))


def walk_minutes(metres: str) -> Column:
    """A walk's share of its route's minutes, as walks_of() has it."""
    return F.when(F.col("stated_m") > 0, F.col(metres) / F.nullif("stated_m", F.lit(0.0)) * F.col("minutes")).otherwise(0.0)


def counted_continuity(top: DataFrame, routes: DataFrame, route: str = "route_id") -> DataFrame:
    """What continuity() gives of walks_of(), from each route's max_walk_m and n_walks."""
    out = top.join(routes.select(route, "stated_m", "minutes", "limit_minutes").hint("merge"), route).withColumn("max_minutes", walk_minutes("max_walk_m"))
    over = F.greatest(F.lit(0.0), F.col("max_minutes") - F.col("limit_minutes"))
    return out.withColumn("over_minutes", over).withColumn("feasible", F.col("max_minutes") <= F.col("limit_minutes")).drop("stated_m", "minutes")


def two_largest(gap_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each route the largest gap (the first of equal ones), and the second-largest length (0 without one)."""
    by = Window.partitionBy(*keys).orderBy(F.desc("gap_m"), "start_m", "end_m")
    top = gap_rows.withColumn("_n", F.row_number().over(by)).where("_n <= 2")
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 1, F.col("start_m"))).alias("gap_start_m"),
        F.max(F.when(F.col("_n") == 1, F.col("end_m"))).alias("gap_end_m"),
        F.max(F.when(F.col("_n") == 1, F.col("gap_m"))).alias("longest_m"),
        F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("gap_m"))), F.lit(0.0)).alias("second_m"),
    )


def tops_before_ends(positions: DataFrame, kinds: dict[str, Column], sums: dict[str, Column], split: str, alone: Column, least_m: float, route: str = "route_id") -> DataFrame:
    """Of each route that has rows, what its last stretches are still to be added to (gap_tops() does): for each kind the largest gap so far, the
    first of equal ones, the second-largest length and the last position, how many rests of the kind `split` split the route, and the sums.

    positions: route, position_m and what the columns read. kinds: whether a row is of it; alone: whether one point only stands there. A row is
    looked at once, in the order of its route, and sends nothing on but maxima: a gap that beats all before it is the first of its
    length, and the second-largest is the largest of what a gap and those before it both reach.
    """
    before = Window.partitionBy(route).orderBy("position_m").rowsBetween(Window.unboundedPreceding, -1)
    p, col = F.col("position_m"), lambda name, k: F.col(f"_{name}_{k}")
    rows = positions.select(route, "position_m", alone.alias("_alone"), *[F.coalesce(c, F.lit(False)).alias(f"_is_{k}") for k, c in kinds.items()], *[c.alias(n) for n, c in sums.items()])
    start = lambda k: F.coalesce(F.last(F.when(col("is", k), p), ignorenulls=True).over(before), F.lit(0.0))
    rows = rows.withColumns({f"_start_{k}": start(k) for k in kinds})
    rows = rows.withColumns({f"_gap_{k}": F.when(col("is", k), p - col("start", k)) for k in kinds})
    rows = rows.withColumn("_fit", F.when(col("is", split), F.col("_alone") & (col("gap", split) > least_m)))
    rows = rows.withColumns({f"_most_{k}": F.max(col("gap", k)).over(before) for k in kinds} | {"_fit_before": F.last("_fit", ignorenulls=True).over(before)})
    found = [F.count_if(F.col("_fit_before") & (col("gap", split) > least_m)).alias("n_splits"), F.max(F.when(F.col("_fit"), p)).alias("_last_fit"), F.max(F.when(~F.col("_fit"), p)).alias("_last_unfit")]
    for k in kinds:
        record = col("gap", k) > F.coalesce(col("most", k), F.lit(-1.0))
        found += [F.max(F.when(record, col("start", k))).alias(f"{k}_start_m"), F.max(F.when(record, p)).alias(f"{k}_end_m"), F.max(col("gap", k)).alias(f"{k}_gap_m")]
        found += [F.max(F.when(col("most", k).isNotNull() & col("gap", k).isNotNull(), F.least(col("gap", k), col("most", k)))).alias(f"{k}_second_m"), F.max(F.when(col("is", k), p)).alias(f"{k}_last_m")]
    return rows.groupBy(route).agg(*found, *[F.sum(n).alias(n) for n in sums])


def gap_tops(before: DataFrame, routes: DataFrame, kinds: list[str], split: str, least_m: float, route: str = "route_id") -> DataFrame:
    """What two_largest() gives of counted_gaps() for each kind, as <kind>_start_m, _end_m, _gap_m and _second_m, and n_splits, a row for each of
    routes (route, stated_m), with those that have no points. before: tops_before_ends(); its sums stay, 0 where a route has none."""
    sums = [c for c in before.columns if c not in (route, "n_splits", "_last_fit", "_last_unfit") and not any(c.startswith(f"{k}_") and c.endswith("_m") for k in kinds)]
    stated = F.col("stated_m").cast("double")
    met = routes.select(route, "stated_m").join(before.hint("merge"), route, "left").fillna(0, ["n_splits", *sums])
    out = []
    for k in kinds:
        gap, second, last = F.col(f"{k}_gap_m"), F.col(f"{k}_second_m"), F.coalesce(f"{k}_last_m", F.lit(0.0))
        rest = stated - last
        beats = gap.isNull() | (rest > gap)
        out += [F.when(beats, last).otherwise(F.col(f"{k}_start_m")).alias(f"{k}_start_m"), F.when(beats, stated).otherwise(F.col(f"{k}_end_m")).alias(f"{k}_end_m")]
        out += [F.greatest(gap, rest).alias(f"{k}_gap_m"), F.when(gap.isNull(), 0.0).otherwise(F.greatest(second, F.least(gap, rest))).alias(f"{k}_second_m")]
    last = F.col(f"{split}_last_m")
    # a second point at the last place is unfit, as no walk leads to it
    fit = F.coalesce((F.col("_last_fit") == last) & (stated - last > least_m), F.lit(False)) & ~F.coalesce(F.col("_last_unfit") == last, F.lit(False))
    return met.select(route, *sums, (F.col("n_splits") + fit.cast("long")).alias("n_splits"), *out)


#: Metres of a route that one task looks at for gaps.
STRETCH_M = 5000.0


def largest_gaps(positions: DataFrame, routes: DataFrame, route: str = "route_id", stretch: float = STRETCH_M) -> DataFrame:
    """What two_largest() gives of gaps(), without a route's positions in one task.

    Stretches of a route give their first and last position and the two largest gaps between; these are put in order and merged, a value for
    each stretch: a gap across stretches lies between the last position of one and the first of the next. positions: route and
    position_m, from 0 to the route's stated_m; routes: route and stated_m.
    """
    gap = lambda start, end: F.struct((start - end).alias("less"), start.alias("start"), end.alias("end"))
    own = positions.select(route, "position_m", F.floor(F.col("position_m") / stretch).alias("_k"))
    by = Window.partitionBy(route, "_k").orderBy("position_m")
    own = own.withColumn("_gap", gap(F.lag("position_m").over(by), F.col("position_m")))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy(route, "_k").orderBy(F.col("_gap.less").asc_nulls_last(), "_gap.start", "_gap.end")))
    inner = F.collect_list(F.when((F.col("_n") <= 2) & F.col("_gap.less").isNotNull(), F.col("_gap")))
    parts = own.groupBy(route, "_k").agg(F.min("position_m").alias("first"), F.max("position_m").alias("last"), inner.alias("gaps"))
    parts = parts.groupBy(route).agg(F.array_sort(F.collect_list(F.struct("_k", "first", "last", "gaps"))).alias("p"))
    met = routes.select(route, F.col("stated_m").cast("double").alias("stated_m")).join(parts.hint("merge"), route, "left").withColumn("p", F.coalesce("p", F.expr("array()").cast(parts.schema["p"].dataType)))
    lasts = F.concat(F.array(F.lit(0.0)), F.transform("p", lambda x: x["last"]))
    firsts = F.concat(F.transform("p", lambda x: x["first"]), F.array("stated_m"))
    across = F.zip_with(lasts, firsts, gap)
    top = F.array_sort(F.concat(across, F.flatten(F.transform("p", lambda x: x["gaps"]))))
    met = met.withColumn("_a", F.get(top, F.lit(0))).withColumn("_b", F.get(top, F.lit(1)))
    return met.select(route, F.col("_a.start").alias("gap_start_m"), F.col("_a.end").alias("gap_end_m"), (-F.col("_a.less")).alias("longest_m"), F.coalesce(-F.col("_b.less"), F.lit(0.0)).alias("second_m"))


def insertion_suggestion(largest: DataFrame) -> DataFrame:
    """The middle of the largest gap, and the longest gap after a stop there."""
    improved = F.greatest(F.col("longest_m") / 2, F.col("second_m"))
    ratio = F.when(F.col("longest_m") > 0, (F.col("longest_m") - improved) / F.nullif("longest_m", F.lit(0.0))).otherwise(0.0)
    return largest.withColumn("insert_m", (F.col("gap_start_m") + F.col("gap_end_m")) / 2).withColumn("improved_m", improved).withColumn("improved_ratio", ratio)


def walking_segments(positions: DataFrame, routes: DataFrame, point: str = "facility_id", route: str = "route_id") -> DataFrame:
    """Routes cut at their rests: each walk's metres, its share of the minutes, and the rest where it ends, but for the last."""
    return walks_of(gaps(positions, routes, point, route), routes, route)


def walks_of(gap_rows: DataFrame, routes: DataFrame, route: str = "route_id") -> DataFrame:
    """The gaps between rests as walks (see walking_segments)."""
    rows = gap_rows.join(routes.select(route, "stated_m", "minutes").hint("merge"), route)
    share = F.when(F.col("stated_m") > 0, F.col("gap_m") / F.nullif("stated_m", F.lit(0.0)) * F.col("minutes")).otherwise(0.0)
    return rows.select(
        route,
        F.concat_ws("-", F.col(route).cast("string"), F.lit("walk"), F.col("ordinal").cast("string")).alias("walk_id"),
        "ordinal",
        F.col("gap_m").alias("walk_m"),
        share.alias("walk_minutes"),
        F.col("ends_at").isNotNull().alias("ends_at_rest"),
        F.col("ends_at").alias("rest_id"),
    )


def continuity(walks: DataFrame, routes: DataFrame, route: str = "route_id") -> DataFrame:
    """The longest walk of each route, how far it is over the limit, and whether it is feasible; the limit is."""
    top = walks.groupBy(route).agg(F.max("walk_minutes").alias("max_minutes"), F.max("walk_m").alias("max_walk_m"), F.count("*").cast("int").alias("n_walks"))
    over = F.greatest(F.lit(0.0), F.col("max_minutes") - F.col("limit_minutes"))
    return top.join(routes.select(route, "limit_minutes").hint("merge"), route).withColumn("over_minutes", over).withColumn("feasible", F.col("max_minutes") <= F.col("limit_minutes"))


def strict_splits(walks: DataFrame, n_strict: DataFrame, route: str = "route_id", least_m: float = 0.0) -> DataFrame:
    """How many rests split a route in two walks of more than least_m each, no more than it has strict points."""
    by = Window.partitionBy(route).orderBy("ordinal")
    real = walks.withColumn("_next", F.lead("walk_m").over(by)).withColumn("_hit", F.col("ends_at_rest") & (F.col("walk_m") > least_m) & (F.col("_next") > least_m))
    return real.groupBy(route).agg(F.count_if("_hit").alias("k")).join(n_strict.hint("merge"), route, "left").select(route, F.least("k", F.coalesce("n_strict", F.lit(0))).cast("int").alias("n_splits"))


def insertion_gain(candidates: DataFrame, largest: DataFrame, route: str = "route_id", side: Callable[[DataFrame], DataFrame] = merged) -> DataFrame:
    """What a stop at a candidate's position would take off its route's longest gap.

    Only the largest gap can matter: inside it, the longest is then the greatest of its two parts and the second-largest
    gap; anywhere else (or at an end) nothing changes. Equally long gaps leave the longest as it is.
    """
    p, s, e = F.col("position_m"), F.col("gap_start_m"), F.col("gap_end_m")
    met = candidates.join(side(largest.select(route, "gap_start_m", "gap_end_m", "longest_m", "second_m", F.col("stated_m").alias("_end"))), route)
    inside = (p > 0) & (p < F.col("_end")) & (p > s) & (p < e)
    improved = F.when(inside, F.greatest(F.col("second_m"), p - s, e - p)).otherwise(F.col("longest_m"))
    return met.withColumn("improved_m", improved).withColumn("gross_m", F.greatest(F.lit(0.0), F.col("longest_m") - F.col("improved_m"))).drop("_end")


def coverage(longest: Column, stated: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - longest / F.nullif(stated, F.lit(0.0)))
