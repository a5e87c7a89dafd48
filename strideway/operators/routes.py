"""Routes judged against what a walker asks for: score, rank, deltas to a baseline and reasons."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.geo import rounded_away

#: Points for a minute over the limit, a missing toilet, a steep slope, a missing indoor rest.
OVER_MINUTE, MISSING_TOILET, STEEP_SLOPE, MISSING_INDOOR = 12.0, 120.0, 35.0, 45.0
REST_M, TOILET_M = 350.0, 250.0
REASONS_SHOWN = 4
#: How a route's walks stand to the limit; the first two are within it.
CONTINUITY = ("WHOLE_ROUTE_WITHIN_LIMIT_WITHOUT_STRICT_REST", "STRICT_REST_POINTS_MAKE_ROUTE_FEASIBLE", "NO_STRICT_REST_AND_OVER_LIMIT", "STRICT_REST_POINTS_PRESENT_BUT_STILL_OVER_LIMIT")
#: What speaks against a route, in order; the last is told but not counted among the wishes.
VIOLATIONS = ("MAX_CONTINUOUS_WALK_EXCEEDED", "PUBLIC_TOILET_REQUIRED_MISSING", "STEEP_SLOPE_REQUIREMENT_NOT_MET", "INDOOR_REST_REQUIREMENT_NOT_MET", "STRICT_REST_NETWORK_NOT_FEASIBLE")
#: Profiles that avoid steps or suit wheelchairs.
STEP_AVOIDING, WHEELCHAIR = "step_avoiding", "wheelchair_profile"


def network_level(confirmed_ok: Column, n_confirmed: Column, strict_ok: Column, n_supported: Column) -> Column:
    """confirmed where confirmed points alone keep the route within the limit, supported where all strict ones do."""
    return F.when((n_confirmed > 0) & confirmed_ok, "confirmed").when((n_supported > 0) & strict_ok, "supported").otherwise("none")


def present(*codes: Column) -> Column:
    return F.filter(F.array(*codes), lambda x: x.isNotNull())


def evaluate(routes: DataFrame) -> DataFrame:
    """Violations, score and its parts, for routes with their metrics and their request's wishes on the same row.

    Needs minutes, max_minutes, limit_minutes, require_toilet, n_toilets, avoid_steep, steep_count, prefer_indoor, n_indoor.
    """
    over = F.greatest(F.lit(0.0), F.col("max_minutes") - F.col("limit_minutes"))
    toilet = F.col("require_toilet") & (F.col("n_toilets") == 0)
    slope = F.col("avoid_steep") & (F.col("steep_count") > 0)
    indoor = F.col("prefer_indoor") & (F.col("n_indoor") == 0)
    parts = {
        "over_points": OVER_MINUTE * over,
        "toilet_points": F.when(toilet, MISSING_TOILET).otherwise(0.0),
        "slope_points": F.when(F.col("avoid_steep"), STEEP_SLOPE * F.col("steep_count")).otherwise(0.0),
        "indoor_points": F.when(indoor, MISSING_INDOOR).otherwise(0.0),
    }
    codes = present(*[F.when(c, n) for n, c in zip(VIOLATIONS[:4], (over > 0, toilet, slope, indoor), strict=True)])
    out = routes.withColumns(parts).withColumn("violations", codes)
    score = F.col("minutes") + sum((F.col(p) for p in parts), F.lit(0.0))
    return out.withColumn("score", score).withColumn("n_violations", F.size("violations")).withColumn("meets", F.size("violations") == 0)


def rank_routes(evaluated: DataFrame, request: str = "request_id") -> DataFrame:
    """rank within each request, by score, wishes met, violations, longest walk, longest gap, seconds, metres, id."""
    order = ["score", F.desc("meets"), "n_violations", "max_minutes", "longest_m", "seconds", "stated_m", "route_id"]
    return evaluated.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order)))


def baseline_deltas(ranked: DataFrame, request: str = "request_id") -> DataFrame:
    """The baseline of each request (its first standard route, else its shortest) and the differences to it."""
    standard = F.struct((F.col("profile") != "standard").alias("other"), F.when(F.col("profile") != "standard", F.col("stated_m")).otherwise(0.0).alias("m"), "route_id", "stated_m", "seconds", F.col("longest_m").alias("gap"), F.col("max_minutes").alias("walk"))
    base = F.min(standard).over(Window.partitionBy(request))
    out = ranked.withColumn("_b", base)
    return out.select(
        *ranked.columns,
        F.col("_b.route_id").alias("baseline_id"),
        rounded_away(F.col("stated_m") - F.col("_b.stated_m")).alias("delta_m"),
        rounded_away((F.col("seconds") - F.col("_b.seconds")) / 60, 1).alias("delta_minutes"),
        rounded_away(F.col("longest_m") - F.col("_b.gap")).alias("delta_gap_m"),
        F.col("_b.walk").alias("baseline_minutes"),
    )


def least_flags(ranked: DataFrame, metrics: tuple[str, ...] = ("n_violations", "score", "max_minutes", "longest_m", "toilet_gap_m", "stated_m", "seconds"), request: str = "request_id") -> DataFrame:
    """For each metric, whether a route has the least of its request, and whether it shares it."""
    by = Window.partitionBy(request)
    out = ranked
    for m in metrics:
        out = out.withColumn(f"least_{m}", F.col(m) == F.min(m).over(by))
    for m in metrics:
        out = out.withColumn(f"tied_{m}", F.col(f"least_{m}") & (F.sum(F.col(f"least_{m}").cast("int")).over(by) > 1))
    return out


def reasons(flagged: DataFrame) -> DataFrame:
    """The first few reasons for a route and what speaks against it, in a fixed order, as code arrays.

    flagged: the columns of least_flags and baseline_deltas, avoid_steps, n_toilets and continuity (see continuity_class).
    The codes are fixed values.
    """
    least = lambda m, code: F.when(F.col(f"least_{m}"), code)
    codes = present(
        F.when(F.col("meets"), "MEETS_ALL_REQUIRED_PREFERENCES"),
        least("n_violations", "FEWER_CONSTRAINT_VIOLATIONS"),
        least("score", "LOWEST_CONDITION_BURDEN_SCORE"),
        F.when(F.col("avoid_steps") & (F.col("profile") == STEP_AVOIDING), "STEP_AVOIDING_PROFILE"),
        least("max_minutes", "LOWEST_MAX_CONTINUOUS_WALK"),
        F.when((F.col("route_id") != F.col("baseline_id")) & (F.col("max_minutes") < F.col("baseline_minutes")), "BETTER_CONTINUITY_THAN_STANDARD"),
        least("longest_m", "LOWEST_REST_GAP"),
        least("toilet_gap_m", "LOWEST_PUBLIC_TOILET_GAP"),
        least("stated_m", "SHORTEST_DISTANCE"),
        least("seconds", "FASTEST_DURATION"),
        F.when(F.col("require_toilet") & (F.col("n_toilets") > 0), "PUBLIC_TOILET_CANDIDATES_NEAR_ROUTE"),
        F.when(F.col("continuity") == CONTINUITY[1], "STRICT_REST_NETWORK_FEASIBLE"),
        F.when(F.col("continuity") == CONTINUITY[0], "WHOLE_ROUTE_WITHIN_LIMIT"),
    )
    against = F.concat(F.col("violations"), present(F.when(~F.col("continuity").isin(*CONTINUITY[:2]), VIOLATIONS[4])))
    return flagged.withColumn("reasons", F.slice(codes, 1, REASONS_SHOWN)).withColumn("against", against)


def explanations(flagged: DataFrame) -> DataFrame:
    """What is good about a route, what it costs against the baseline, and what to check on the spot, as code arrays.

    flagged: as in reasons. The codes are fixed values.
    """
    good = present(
        F.when(F.col("least_stated_m"), "SHORTEST_DISTANCE"),
        F.when(F.col("least_seconds"), "FASTEST_DURATION"),
        F.when(F.col("profile") == STEP_AVOIDING, "STEP_AVOIDING_PROFILE"),
        F.when(F.col("profile") == WHEELCHAIR, "WHEELCHAIR_PROFILE"),
        F.when(F.col("meets"), "MEETS_ALL_REQUIRED_PREFERENCES"),
        F.when(F.col("require_toilet") & (F.col("n_toilets") > 0), "PUBLIC_TOILET_CANDIDATES_NEAR_ROUTE"),
        F.when(F.col("continuity") == CONTINUITY[1], "STRICT_REST_NETWORK_FEASIBLE"),
        F.when(F.col("continuity") == CONTINUITY[0], "WHOLE_ROUTE_WITHIN_LIMIT"),
    )
    costs = present(F.when(F.col("delta_m") > 0, "LONGER_DISTANCE"), F.when(F.col("delta_minutes") > 0, "LONGER_DURATION"), F.when(F.col("delta_gap_m") > 0, "LONGER_REST_GAP"))
    warnings = present(F.when(F.col("profile").isin(STEP_AVOIDING, WHEELCHAIR), "SOURCE_WARNING"))
    return flagged.withColumn("advantages", good).withColumn("tradeoffs", costs).withColumn("warnings", warnings)


#: The kinds and confidences that are counted.
TALLIED_KINDS, TALLIED_LEVELS = ("toilet", "rest", "water", "indoor"), ("confirmed", "supported", "possible", "estimated")


def tallies(near: DataFrame, route: str = "route_id") -> DataFrame:
    """What lies near each route: points by kind and by confidence, and how far the nearest of each kind is.

    near: route, kind, confidence, distance_m. A kind that a route lacks has 0 points and no distance.
    """
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TALLIED_KINDS] + [F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in TALLIED_LEVELS]
    return near.groupBy(route).agg(*counts, *[F.min(F.when(F.col("kind") == k, F.col("distance_m"))).alias(f"nearest_{k}_m") for k in TALLIED_KINDS])


def tally_counts(points: DataFrame, by: str) -> DataFrame:
    """Points of each kind and confidence at one place (by), for counted_tallies()."""
    return points.groupBy(by).agg(*[F.count_if(F.col(c) == v).alias(f"n_{v}") for c, values in (("kind", TALLIED_KINDS), ("confidence", TALLIED_LEVELS)) for v in values])


def counted_tallies(near: DataFrame, route: str = "route_id") -> DataFrame:
    """What tallies() gives, from places that stand for several points each. near: route, distance_m and the columns of tally_counts()."""
    counts = [F.sum(f"n_{v}").alias(f"n_{v}") for v in (*TALLIED_KINDS, *TALLIED_LEVELS)]
    return near.groupBy(route).agg(*counts, *[F.min(F.when(F.col(f"n_{k}") > 0, F.col("distance_m"))).alias(f"nearest_{k}_m") for k in TALLIED_KINDS])


#: What stands for several licences, and for none.
MANY_LICENCES, NO_LICENCE = "複数ライセンス（sourcesを参照）", "ライセンス情報なし"


def source_summary(near: DataFrame, manifest: DataFrame, route: str = "route_id") -> DataFrame:
    """The datasets behind the points near each route, in order, with their licences: one licence is named itself.

    near: route and dataset; manifest: dataset and licence, maybe null. A dataset that the manifest lacks has no licence.
    """
    own = near.select(route, "dataset").where("dataset is not null").distinct().join(manifest.select("dataset", "licence").hint("merge"), "dataset", "left")
    out = own.groupBy(route).agg(F.array_sort(F.collect_set("dataset")).alias("datasets"), F.array_sort(F.collect_set("licence")).alias("licences"))
    n = F.size("licences")
    return out.withColumn("licence", F.when(n == 1, F.element_at("licences", 1)).when(n > 1, MANY_LICENCES).otherwise(NO_LICENCE))


#: How the source of a routing service's line is described.
ROUTE_SOURCE = {
    "source_type": "openstreetmap_route",
    "dataset": "openstreetmap-openrouteservice-route",
    "provider": "openrouteservice / OpenStreetMap contributors",
    "dataset_name": "OpenRouteService経路候補（OpenStreetMap由来）",
    "licence": "ODbL 1.0（OpenStreetMapデータ。openrouteserviceの利用条件も適用）",
    "attribution": "© OpenStreetMap contributors / openrouteservice",
    "page": "https://www.openstreetmap.org/copyright",
    "resource": None,
}
#: What every analysis says of its figures.
ANALYSIS_WARNINGS = (
    "距離は推定直線距離またはデモルート総距離へ正規化したルート沿い推定距離です。",
    "実際の徒歩経路、施設の利用可否、入館条件、安全性を保証しません。",
    "理論上の休憩地点追加候補は、実在する設置可能場所を保証しません。",
)
SOURCE_COLUMNS = tuple(ROUTE_SOURCE)


def point_sources(points: DataFrame, manifest: DataFrame, route: str = "route_id") -> DataFrame:
    """The descriptor of each point's own dataset: route and SOURCE_COLUMNS, maybe more than once.

    points: route, dataset, provider, dataset_name, licence and verified (whether someone checked it there); manifest: dataset, licence, page and
    resource. A point without a dataset has none; what it doesn't say of its licence the manifest does.
    """
    of = manifest.select("dataset", F.col("licence").alias("_licence"), "page", "resource")
    own = points.where("dataset is not null").join(of.hint("merge"), "dataset", "left").withColumn("licence", F.coalesce("licence", "_licence", F.lit(NO_LICENCE)))
    kind = F.when(F.col("verified"), "field_verification").otherwise("official_open_data")
    credit = F.concat("provider", F.lit("「"), "dataset_name", F.lit("」 ("), "licence", F.lit(")"))
    return own.withColumn("source_type", kind).withColumn("attribution", credit).select(route, *SOURCE_COLUMNS)


def listed_sources(ids: DataFrame, manifest: DataFrame, route: str = "route_id") -> DataFrame:
    """Descriptors of the datasets that official ids name: an id's dataset is what stands before its first `:`.

    ids: route and source_id; manifest: dataset, provider, dataset_name, licence, attribution, page and resource. Datasets that the manifest
    lacks have none.
    """
    own = ids.select(route, F.substring_index("source_id", ":", 1).alias("dataset")).distinct().join(manifest.hint("merge"), "dataset")
    return own.withColumn("source_type", F.lit("official_open_data")).select(route, *SOURCE_COLUMNS)


def route_sources(routes: DataFrame, *origins: DataFrame, route: str = "route_id") -> DataFrame:
    """What each route's analysis rests on: sources (structs of SOURCE_COLUMNS, each once), dataset_ids, attributions and warnings, all in order.

    origins: route and SOURCE_COLUMNS, of whatever origin; the routing service is added to each route. Sources are one if kind, dataset,
    provider and name agree; of those the first in the order of the other columns stays. routes: route and warnings (an array, maybe null).
    """
    line = routes.select(route, *[F.lit(v).cast("string").alias(c) for c, v in ROUTE_SOURCE.items()])
    key = ["source_type", "dataset", "provider", "dataset_name"]
    rest = F.struct(*[c for c in SOURCE_COLUMNS if c not in key])
    every = functools.reduce(DataFrame.unionByName, [*origins, line]).groupBy(route, *key).agg(F.min(rest).alias("_rest"))
    one = F.struct(*[F.col(c) if c in key else F.col(f"_rest.{c}").alias(c) for c in (*key, *[c for c in SOURCE_COLUMNS if c not in key])])
    lists = every.groupBy(route).agg(F.array_sort(F.collect_list(one)).alias("sources"))
    distinct = lambda c: F.array_sort(F.array_distinct(F.transform("sources", lambda s: s[c])))
    said = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*map(F.lit, ANALYSIS_WARNINGS))), lambda w: w != "")))
    out = routes.select(route, said.alias("warnings")).join(lists.hint("merge"), route)
    return out.withColumn("dataset_ids", distinct("dataset")).withColumn("attributions", distinct("attribution"))


def preference_summary(ranked: DataFrame, request: str = "request_id") -> DataFrame:
    """Whether any route, and whether the top one, meets the wishes of a request."""
    return ranked.groupBy(request).agg(F.bool_or("meets").alias("any_meets"), F.min_by("meets", "rank").alias("top_meets"), (~F.bool_or("meets")).alias("none_meets"))


def continuity_class(n_splits: Column, max_minutes: Column, total_minutes: Column, limit: Column) -> Column:
    split = n_splits > 0
    within = F.when(split, max_minutes).otherwise(total_minutes) <= limit
    return F.when(~split & within, CONTINUITY[0]).when(split & within, CONTINUITY[1]).when(~split, CONTINUITY[2]).otherwise(CONTINUITY[3])


def request_problem(requests: DataFrame, south: float = 35.0, north: float = 36.0, west: float = 139.0, east: float = 140.0, most_m: float = 8000.0) -> DataFrame:
    """requests with code and problem: the first rule that a request breaks (400 malformed, 422 out of range), or null."""
    from strideway.functions.geo import haversine, in_box

    c = [F.col(x) for x in ("from_lat", "from_lon", "to_lat", "to_lon")]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    direct = haversine(*c)
    rules = [
        (~(finite(c[0]) & finite(c[1]) & finite(c[2]) & finite(c[3])), 400, "not_finite"),
        (~(c[0].between(-90, 90) & c[2].between(-90, 90) & c[1].between(-180, 180) & c[3].between(-180, 180)), 400, "out_of_range"),
        (~(in_box(c[0], c[1], south, north, west, east) & in_box(c[2], c[3], south, north, west, east)), 422, "outside_area"),
        (direct < 1, 400, "same_place"),
        (direct > most_m, 422, "too_far"),
        (~F.coalesce(F.col("limit_minutes").isin(5, 10, 15), F.lit(False)), 400, "limit_minutes"),
        (F.col("require_toilet").isNull() | F.col("avoid_steep").isNull() | F.col("prefer_indoor").isNull(), 400, "preferences"),
    ]
    problem = F.when(F.lit(False), F.struct(F.lit(0).alias("code"), F.lit("").alias("problem")))
    for broken, code, name in rules:
        problem = problem.when(broken, F.struct(F.lit(code).alias("code"), F.lit(name).alias("problem")))
    return requests.withColumn("_p", problem).select(*requests.columns, "_p.code", "_p.problem")


def request_key(version: str = "v1") -> Column:
    """One hash for requests that a router answers alike: those of equal coordinates to 5 places. What the walker wishes of the
    routes is judged afterwards and isn't in it."""
    micro = [F.floor(F.col(c) * 1e5 + 0.5).cast("long").cast("string") for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    return F.sha2(F.concat_ws("|", F.lit(version), *micro), 256)
