"""Candidate places: who may go in, what a stop there is worth, and how stable the order is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.geo import rounded
from strideway.operators.ranks import positions
from strideway.sources.staging import drop_staged, staged

#: Access categories with their prior, penalty, need for caution and eligibility.
POLICIES = (
    ("public_outdoor_space", 100, 0, False, True),
    ("public_service_facility", 85, 5, False, True),
    ("official_public_access", 65, 15, True, True),
    ("commercial_facility", 45, 35, True, True),
    ("private_hospitality", 10, 220, True, True),
    ("restricted_or_sensitive", 0, 250, True, False),
    ("uncertain_facility", 20, 80, True, True),
)
#: Words in a name or address that decide its category.
RESTRICTED_WORDS = "学校|幼稚園|保育|こども園|児童|養護|福祉|障害"
OUTDOOR_WORDS = "公園|公開広場"
SERVICE_WORDS = "区役所|出張所|観光|図書館|区民|地域センター|環境学習|公民館|文化センター"
HOSPITALITY_WORDS = "ホテル|旅館|宿泊"
SHORTLIST_EXCLUDED_WORDS = "学校|幼稚園|保育|こども園|児童|福祉"
#: Weights of the ranking and the limits of what counts as an improvement.
WEIGHTS = {"improvement_m": 0.6, "improvement_ratio": 200.0, "proximity": 0.2, "access_prior": 1.0, "category_penalty": 1.0, "covered_routes": 40.0, "source_quality": 12.0}
MEANINGFUL_M, MEANINGFUL_RATIO = 30.0, 0.025
MARGINAL_M, MARGINAL_RATIO = 50.0, 0.05
#: Datasets that make a source good, and why a candidate isn't ranked, the first of these that holds.
OFFICIAL_DATASETS = ("shinjuku-public-facilities", "daredemo-public_facilities", "daredemo-transport")
BEST_DATASETS, GOOD_PREFIX = ("shinjuku-public-facilities", "daredemo-parks"), "daredemo-"
EXCLUSIONS = ("EXISTING_STRICT_REST_DUPLICATE", "COORDINATE_SOURCE_ANOMALY", "RESTRICTED_OR_SENSITIVE_FACILITY", "NO_DYNAMIC_ROUTE_WITHIN_DISTANCE", "NO_GROSS_GAP_IMPROVEMENT", "DETOUR_ADJUSTED_IMPROVEMENT_BELOW_THRESHOLD")
VARIATION, TOP = 0.2, 5
PUBLIC = ("public_outdoor_space", "public_service_facility")
OFFICIAL = ("commercial_facility", "official_public_access")


def policies(spark) -> DataFrame:
    return spark.createDataFrame(POLICIES, "category string, access_prior int, category_penalty int, needs_caution boolean, eligible boolean")


def access_category(text: Column, datasets: Column, rules: dict[str, str] | None = None, barrier_free: Column | None = None) -> Column:
    """The first category whose words the text has or whose datasets the group has; barrier_free: any record is listed as such."""
    words = {"restricted": RESTRICTED_WORDS, "outdoor": OUTDOOR_WORDS, "service": SERVICE_WORDS, "hospitality": HOSPITALITY_WORDS} | (rules or {})
    has = lambda *names: F.arrays_overlap(datasets, F.array(*map(F.lit, names)))
    return (
        F.when(text.rlike(words["restricted"]), "restricted_or_sensitive")
        .when(has("daredemo-parks") | text.rlike(words["outdoor"]), "public_outdoor_space")
        .when(text.rlike(words["service"]), "public_service_facility")
        .when(has(*OFFICIAL_DATASETS), "official_public_access")
        .when(has("daredemo-accommodation") | text.rlike(words["hospitality"]), "private_hospitality")
        .when(has("daredemo-shopping", "daredemo-dining", "daredemo-leisure"), "commercial_facility")
        .when(F.lit(False) if barrier_free is None else barrier_free, "official_public_access")
        .otherwise("uncertain_facility")
    )


def source_quality(datasets: Column) -> Column:
    """3 for official lists of facilities and parks, 2 for other barrier-free lists, else 1."""
    best = F.arrays_overlap(datasets, F.array(*map(F.lit, BEST_DATASETS)))
    return F.when(best, 3).when(F.exists(datasets, lambda d: d.startswith(GOOD_PREFIX)), 2).otherwise(1)


def classify(groups: DataFrame, text: Column, datasets: Column, rules: dict[str, str] | None = None, barrier_free: Column | None = None) -> DataFrame:
    """groups with category and its policy; the policy table has a row for each category."""
    own = groups.withColumn("category", access_category(text, datasets, rules, barrier_free))
    return own.join(F.broadcast(policies(groups.sparkSession)), "category")


def route_metrics(gains: DataFrame) -> DataFrame:
    """Published metrics of each candidate on each route: rounded, less the detour, and whether they count."""
    distance = rounded(F.col("distance_m"))
    net = F.greatest(F.lit(0.0), F.col("gross_m") - distance)
    out = gains.withColumn("distance_r", distance).withColumn("gap_r", rounded(F.col("longest_m"))).withColumn("gross_r", rounded(F.col("gross_m")))
    out = out.withColumn("adjusted_r", rounded(net)).withColumn("ratio_r", F.coalesce(rounded(net / F.nullif("longest_m", F.lit(0.0)), 4), F.lit(0.0)))
    return out.withColumn("counts", (F.col("gross_m") > 0) & (F.col("adjusted_r") >= MEANINGFUL_M) & (F.col("ratio_r") >= MEANINGFUL_RATIO))


def best_route(metrics: DataFrame, key: str = "facility_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate's primary route, the first of those that count (of all, where none does), how many routes count, and
    whether any has a gain at all. keep: the columns that come along, all if none are named; each is sent with every candidate of a task."""
    # one aggregate, so that a task sends a row for each candidate and not one for each of its routes
    order = F.struct(~F.col("counts"), -F.col("adjusted_r"), -F.col("ratio_r"), -F.col("gross_r"), "distance_r", "route_id")
    rest = F.struct(*(keep or [c for c in metrics.columns if c != key]))
    found = metrics.groupBy(key).agg(F.min(F.struct(order.alias("o"), rest.alias("r"))).alias("_b"), F.count_if("counts").cast("int").alias("covered_routes"), F.bool_or(F.col("gross_m") > 0).alias("any_gain"))
    return found.select(key, "_b.r.*", "covered_routes", "any_gain")


def score_parts(weights: dict[str, Column | float] = WEIGHTS) -> dict[str, Column]:
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in weights.items()}
    two = lambda x: rounded(x, 2)
    return {
        "improvement_points": two(F.col("adjusted_r") * w["improvement_m"]),
        "ratio_points": two(F.col("ratio_r") * w["improvement_ratio"]),
        "proximity_points": two(F.greatest(F.lit(0.0), 350.0 - F.col("distance_r")) * w["proximity"]),
        "prior_points": two(F.col("access_prior") * w["access_prior"]),
        "coverage_points": two(F.greatest(F.lit(0), F.col("covered_routes") - 1) * w["covered_routes"]),
        "quality_points": two(F.col("source_quality") * w["source_quality"]),
        "category_minus": two(F.col("category_penalty") * w["category_penalty"]),
        "duplicate_minus": F.least(F.lit(10.0), 2.0 * (F.col("group_size") - 1)),
    }


def with_score(candidates: DataFrame, weights: dict[str, Column | float] = WEIGHTS) -> DataFrame:
    """candidates with the parts of the score, each to two places, and their total."""
    parts = score_parts(weights)
    plus = [n for n in parts if n.endswith("_points")]
    total = sum((F.col(n) for n in plus), F.lit(0.0)) - F.col("category_minus") - F.col("duplicate_minus")
    return candidates.withColumns(parts).withColumn("score", rounded(total, 2))


def rank_order(key: str) -> list[Column]:
    return [F.desc("score"), F.desc("adjusted_r"), F.desc("ratio_r"), F.desc("covered_routes"), F.asc("distance_r"), F.asc(key)]


def rank_candidates(scored: DataFrame, key: str = "facility_id", region: str | None = None, most: int | None = None) -> DataFrame:
    """priority from 1 within each region, or over the whole table without one task that holds it; `most` keeps the first so many."""
    if region:
        out = scored.withColumn("priority", F.row_number().over(Window.partitionBy(region).orderBy(*rank_order(key))))
    else:
        out = positions(scored, rank_order(key), "priority")
    return out.where(F.col("priority") <= most) if most else out


def exclusion(duplicate: Column, anomaly: Column, eligible: Column, near: Column, gain: Column, counts: Column) -> Column:
    """Why a candidate isn't ranked, the first reason in a fixed order; null for those that are."""
    holds = (duplicate, anomaly, ~eligible, ~near, ~gain, ~counts)
    return F.coalesce(*[F.when(h, code) for h, code in zip(holds, EXCLUSIONS, strict=True)])


def detour_scenarios(candidates: DataFrame) -> DataFrame:
    """Gains with no detour, the straight line once, and there and back; and how sensitive the gain is to that.

    It reads the rounded gain, distance and gap, as they are published.
    """
    gain = [F.greatest(F.lit(0.0), F.col("gross_r") - k * F.col("distance_r")) for k in (0, 1, 2)]
    ratio = [F.coalesce(g / F.nullif("gap_r", F.lit(0.0)), F.lit(0.0)) for g in gain]
    real = lambda k: (gain[k] >= MEANINGFUL_M) & (ratio[k] >= MEANINGFUL_RATIO)
    kind = F.when(real(2), "robust").when(real(1) & ((gain[1] < MARGINAL_M) | (ratio[1] < MARGINAL_RATIO)), "marginal").when(real(1), "sensitive").otherwise("ineffective")
    names = ("optimistic", "adjusted", "conservative")
    out = {f"{n}_m": rounded(g) for n, g in zip(names, gain, strict=True)} | {f"{n}_ratio": rounded(r, 4) for n, r in zip(names, ratio, strict=True)}
    return candidates.withColumns(out).withColumn("detour_class", kind)


def weight_scenarios(spark) -> DataFrame:
    """The weights as they are, and each in turn a fifth less and a fifth more."""
    rows = [("baseline", *WEIGHTS.values())]
    for k in WEIGHTS:
        for name, f in (("minus_20_percent", 1 - VARIATION), ("plus_20_percent", 1 + VARIATION)):
            rows.append((f"{k}_{name}", *[v * f if k == x else v for x, v in WEIGHTS.items()]))
    return spark.createDataFrame(rows, "scenario string, " + ", ".join(f"w_{k} double" for k in WEIGHTS))


def scenario_ranks(candidates: DataFrame, key: str = "facility_id", region: str | None = None) -> DataFrame:
    """Every candidate's score and rank under each weight scenario, from its detour scenarios (15 rows are crossed in)."""
    own = candidates.drop("adjusted_r", "ratio_r").withColumnRenamed("adjusted_m", "adjusted_r").withColumnRenamed("adjusted_ratio", "ratio_r")
    crossed = own.crossJoin(F.broadcast(weight_scenarios(candidates.sparkSession)))
    scored = with_score(crossed, {k: F.col(f"w_{k}") for k in WEIGHTS})
    if not region:
        return positions(scored, rank_order(key), "rank", by=["scenario"]).select(key, "scenario", "score", F.col("rank").cast("int").alias("rank"))
    by = Window.partitionBy("scenario", region).orderBy(*rank_order(key))
    return scored.withColumn("rank", F.row_number().over(by)).select(region, key, "scenario", "score", "rank")


def rank_stability(ranks: DataFrame, key: str = "facility_id", region: str | None = None) -> DataFrame:
    """Baseline, best, worst and mean rank of each candidate, and how often it is among the first few."""
    keys = [*([region] if region else []), key]
    out = ranks.groupBy(*keys).agg(
        F.max(F.when(F.col("scenario") == "baseline", F.col("rank"))).alias("baseline_rank"),
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
        rounded(F.avg("rank"), 2).alias("mean_rank"),
        rounded(F.count_if(F.col("rank") <= TOP) / F.count("*"), 4).alias("top_rate"),
    )
    rate = F.col("top_rate")
    return out.withColumn("stability", F.when(rate == 1, "stable_top5").when(rate >= 0.75, "resilient_top5").when(rate > 0, "variable").otherwise("consistently_outside_top5"))


def purpose_clarity(category: Column) -> Column:
    return F.when(category.isin(*PUBLIC), 3).when(category.isin(*OFFICIAL), 2).when(category == "private_hospitality", 1).otherwise(0)


def two_axis_class(category: Column, detour: Column) -> Column:
    public = category.isin(*PUBLIC)
    return (
        F.when((detour == "robust") & public, "high_improvement_verification_priority")
        .when(detour == "robust", "high_improvement_access_uncertain")
        .when(public & (detour != "ineffective"), "low_improvement_easy_to_verify")
        .otherwise("low_priority")
    )


def undominated(values: np.ndarray) -> np.ndarray:
    """Which rows no other row matches everywhere and beats somewhere; larger is better."""
    keep = np.ones(len(values), bool)
    for i in np.argsort(-values.sum(axis=1), kind="stable"):
        if keep[i]:
            worse = (values <= values[i]).all(axis=1) & (values < values[i]).any(axis=1)
            keep &= ~worse
    return keep


#: Parts whose skylines one task merges, and rows that a part holds before it drops what they dominate.
FAN_IN, HELD_ROWS = 16, 50_000


def skyline(rows: DataFrame, key: str, most: list[str], least: list[str], region: str | None = None) -> DataFrame:
    """rows with on_skyline: no other row of the region is as good everywhere and better somewhere.

    Whatever is dominated among some rows is dominated among all, so partial skylines are merged like sums: each partition keeps its own,
    then FAN_IN partitions' at a time are merged by region, level by level, until one is left. A task holds FAN_IN partial skylines of
    a region, never the region's rows, and no rows are paired by a join.
    """
    axes = [*[F.col(c).cast("double").alias(f"_{c}") for c in most], *[(-F.col(c)).cast("double").alias(f"_{c}") for c in least]]
    names = [f"_{c}" for c in (*most, *least)]
    where = F.col(region).cast("string") if region else F.lit("")
    own = rows.select(F.col(key).alias("_key"), where.alias("_region"), *axes, F.lit(0).alias("_part"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        return part[undominated(part[names].to_numpy())]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            if len(held) > HELD_ROWS:
                held = pd.concat([best(p) for _, p in held.groupby("_region", dropna=False)])
                if len(held) > HELD_ROWS // 2:  # many regions, or few that are dominated
                    yield held.assign(_part=number)
                    held = None
        if held is not None and len(held):
            yield pd.concat([best(p) for _, p in held.groupby("_region", dropna=False)]).assign(_part=number)

    left = staged(own.mapInPandas(local, own.schema), "skyline")
    parts = left.agg(F.max("_part").alias("n")).first()["n"] or 0
    while True:
        parts //= FAN_IN
        merged = staged(left.withColumn("_part", F.floor(F.col("_part") / FAN_IN).cast("int")).groupBy("_region", "_part").applyInPandas(best, own.schema), "skyline")
        drop_staged(left)
        left = merged
        if not parts:
            break
    found = left.select("_key", "_region", F.lit(True).alias("on_skyline"))
    met = rows.withColumn("_where", where).join(found.hint("merge"), (rows[key] == F.col("_key")) & F.col("_where").eqNullSafe(F.col("_region")), "left")
    return met.drop("_key", "_region", "_where").withColumn("on_skyline", F.coalesce("on_skyline", F.lit(False)))


def shortlist(candidates: DataFrame, key: str = "facility_id", region: str | None = None, size: int = 5, robust: int = 3, hospitality: int = 3, name: str | None = None) -> DataFrame:
    """Up to `size` candidates of each region: a public one first, then robust ones, then the rest, few hotels among them.

    The tiers and the running count of hotels are windows: once one is refused for their number, so are all after it.
    """
    by = [region] if region else [F.lit(0)]
    order = [F.desc("top_rate"), F.desc("conservative_m"), F.asc("baseline_rank"), F.asc(key)]
    fit = F.col("on_skyline") & (F.col("detour_class") != "ineffective") & (F.col("category") != "restricted_or_sensitive")
    fit = fit & ~F.col(name).rlike(SHORTLIST_EXCLUDED_WORDS) if name else fit
    rows = candidates.where(fit).withColumn("_public", F.col("category").isin(*PUBLIC)).withColumn("_robust", F.col("detour_class") == "robust")
    nth = lambda flag: F.sum(F.col(flag).cast("int")).over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_p", nth("_public")).withColumn("_r", nth("_robust"))
    tier = F.when(F.col("_public") & (F.col("_p") == 1), 1).when(F.col("_robust") & (F.col("_r") <= robust), 2).otherwise(3)
    rows = rows.withColumn("_tier", tier).withColumn("_hotel", (F.col("category") == "private_hospitality").cast("int"))
    in_order = Window.partitionBy(*by).orderBy("_tier", *order)
    rows = rows.withColumn("_hotels", F.sum("_hotel").over(in_order)).where((F.col("_hotel") == 0) | (F.col("_hotels") <= hospitality))
    role = F.when(F.col("_tier") == 1, "clear_public_verification").when(F.col("_robust"), "robust_improvement").when(F.col("_public"), "clear_public_verification").otherwise("boundary_model_check")
    rows = rows.withColumn("visit_priority", F.row_number().over(in_order)).where(F.col("visit_priority") <= size).withColumn("role", role)
    return rows.drop("_public", "_robust", "_p", "_r", "_tier", "_hotel", "_hotels")


def others(candidates: DataFrame, short: DataFrame, keys: tuple[str, ...] = ("request_id", "facility_id")) -> DataFrame:
    """The candidates that are not on the shortlist."""
    return candidates.join(short.select(*keys).hint("merge"), list(keys), "left_anti")


def visit_plan_problems(plan: DataFrame, key: str = "facility_id", region: str = "request_id", size: int = 5) -> DataFrame:
    """What is wrong with a region's plan: how many places it has, a place twice, or priorities other than 1 to size."""
    n = plan.groupBy(region).agg(F.count("*").alias("n"), F.count_distinct(key).alias("k"), F.count_distinct("visit_priority").alias("p"), F.min("visit_priority").alias("lo"), F.max("visit_priority").alias("hi"))
    priorities = (F.col("p") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    wrong = {"count": F.col("n") != size, "repeated_place": F.col("k") < F.col("n"), "priorities": ~F.coalesce(priorities, F.lit(False))}
    found = F.filter(F.array(*[F.when(c, name) for name, c in wrong.items()]), lambda x: x.isNotNull())
    return n.select(region, F.col("n").alias("n_places"), F.explode(found).alias("problem"))


def with_labels(rows: DataFrame, labels: DataFrame, code: str, label: str = "label") -> DataFrame:
    """rows with the text of their code; a code that the table of labels (one row for each code) lacks is its own text."""
    own = labels.select(F.col("code").alias(code), F.col("text").alias(label))
    return rows.join(own.hint("merge"), code, "left").withColumn(label, F.coalesce(label, code))


#: Why a ranked candidate was chosen, in the order in which the codes are given.
SELECTION_REASONS = (
    "POSITIVE_DETOUR_ADJUSTED_IMPROVEMENT", "MARGINAL_DETOUR_ADJUSTED_IMPROVEMENT", "CLOSE_TO_DYNAMIC_ROUTE_50M", "CLOSE_TO_DYNAMIC_ROUTE_100M", "MULTIPLE_DYNAMIC_ROUTES", "PUBLIC_OUTDOOR_PRIORITY",
    "PUBLIC_SERVICE_PRIORITY", "HIGH_OFFICIAL_SOURCE_QUALITY", "DEDUPLICATED_FACILITY", "NO_EXISTING_STRICT_DUPLICATE", "PRIVATE_ACCESS_CONFIRMATION_NEEDED", "COMMERCIAL_ACCESS_CONFIRMATION_NEEDED",
)
#: What an access category was read from.
CATEGORY_REASONS = {
    "restricted_or_sensitive": "RESTRICTED_OR_SENSITIVE_NAME",
    "public_outdoor_space": "OFFICIAL_PARK_DATASET",
    "public_service_facility": "PUBLIC_SERVICE_NAME",
    "official_public_access": "OFFICIAL_PUBLIC_FACILITY_DATASET",
    "private_hospitality": "PRIVATE_HOSPITALITY_DATASET",
    "commercial_facility": "COMMERCIAL_DATASET",
    "uncertain_facility": "UNKNOWN_ACCESS_PURPOSE",
}
BARRIER_FREE_LISTING = "OFFICIAL_BARRIER_FREE_LISTING"


def selection_reasons() -> Column:
    """The codes that hold for a ranked candidate, in their order; from its primary route's figures, category, source quality and size."""
    c, m = F.col("category"), F.col("distance_r")
    always = F.lit(True)
    holds = (always, F.col("adjusted_r") < MARGINAL_M, m <= 50, (m > 50) & (m <= 100), F.col("covered_routes") > 1, c == PUBLIC[0], c == PUBLIC[1], F.col("source_quality") == 3, F.col("group_size") > 1, always, c == "private_hospitality", c == "commercial_facility")
    return F.filter(F.array(*[F.when(h, code) for h, code in zip(holds, SELECTION_REASONS, strict=True)]), lambda x: x.isNotNull())


def category_reason(category: Column, datasets: Column) -> Column:
    """What the category was read from; an official access without an official list of facilities is a barrier-free listing."""
    listed = F.arrays_overlap(datasets, F.array(*map(F.lit, OFFICIAL_DATASETS)))
    code = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_REASONS.items() for x in pair]), category)
    return F.when((category == "official_public_access") & ~listed, BARRIER_FREE_LISTING).otherwise(code)


#: The columns of a visit plan, those of its analysis and those to fill in.
PLAN_COLUMNS = (
    "confirmationPriority", "verificationId", "candidateId", "name", "address", "latitude", "longitude", "facilityCategory", "targetRouteIds", "distanceToRouteMeters", "optimisticImprovementMeters",
    "lowerBoundImprovementMeters", "conservativeProxyImprovementMeters", "top5AppearanceRate", "stabilityDescription", "selectionReason", "caution",
)
RESULT_COLUMNS = (
    "publiclyAccessible", "seatingAvailable", "seatingUsableForRest", "indoorOrCovered", "drinkingWaterAvailable", "toiletAvailable", "wheelchairAccessible", "openingHoursObserved", "accessRestrictions",
    "verifiedAt", "verifier", "verificationMethod", "evidenceReference", "notes",
)
#: What a plan says of a candidate's stability (%s is the share of settings), of the reason for its visit, and of its use.
DETOUR_TEXTS = {
    "robust": "検討した迂回条件でも改善が残る（往復直線proxy控除後も正）",
    "marginal": "片道直線控除後の改善が閾値付近で、往復直線proxyでは改善が消える",
    "sensitive": "片道直線控除後は改善するが、往復直線proxyでは改善が消える",
    "ineffective": "検討した迂回仮定では改善がほぼ残らない",
}
STABILITY_TEXTS = {
    "stable_top5": "検討した15設定すべてで上位5",
    "resilient_top5": "検討した15設定の%s%で上位5",
    "variable": "検討した15設定の%s%で上位5（設定により順位が変動）",
    "consistently_outside_top5": "検討した15設定では上位5に残らない",
}
ROLE_TEXTS = {
    "clear_public_verification": "一般利用目的が明確な公共施設を、改善仮定の感度と実際の休憩条件を照合する基準地点として確認する。",
    "robust_improvement": "往復直線proxyを控除しても意味のある改善が残り、移動改善効果を現地条件と照合する価値がある。",
    "boundary_model_check": "片道控除後の改善が既存閾値をわずかに上回る境界候補で、迂回仮定の妥当性を現地で検証する価値がある。",
}
PRIVATE_CAUTION = "民間施設の掲載や候補選定は、自由な入館、着席、営業中、休憩可能を意味しない。"
GENERAL_CAUTION = "候補選定は、現地で休憩できることや現在利用できることを保証しない。"


def text_of(texts: dict[str, str], code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), code)


def visit_plan(short: DataFrame, places: DataFrame, routes: DataFrame, key: str = "facility_id", region: str = "request_id") -> DataFrame:
    """The shortlist as a form: region, PLAN_COLUMNS of its analysis, and RESULT_COLUMNS, empty, to fill in.

    short: as shortlist() gives it; places: key, name, address, lat and lon; routes: key and route_ids, those that a stop there would help.
    A place that either lacks is left out.
    """
    cid = F.col(key).cast("string")
    rate = F.regexp_replace(F.format_string("%.2f", F.floor(F.col("top_rate") * 10000 + 0.5) / 100), r"\.?0+$", "")
    stable = F.replace(text_of(STABILITY_TEXTS, F.col("stability")), F.lit("%s"), rate)
    values = (
        F.col("visit_priority"), F.concat(F.lit("fv-"), cid), cid, F.col("name"), F.col("address"), F.col("lat"), F.col("lon"), F.col("category"), F.array_sort("route_ids"), F.col("distance_r"), F.col("optimistic_m"),
        F.col("adjusted_m"), F.col("conservative_m"), F.col("top_rate"), F.concat(text_of(DETOUR_TEXTS, F.col("detour_class")), F.lit("。"), stable, F.lit("。")), text_of(ROLE_TEXTS, F.col("role")),
        F.when(F.col("category").isin("private_hospitality", "commercial_facility"), PRIVATE_CAUTION).otherwise(GENERAL_CAUTION),
    )
    own = short.join(places.select(key, "name", "address", "lat", "lon").hint("merge"), key).join(routes.select(key, "route_ids").hint("merge"), key)
    return own.select(region, *[v.alias(c) for c, v in zip(PLAN_COLUMNS, values, strict=True)], *[F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS])
