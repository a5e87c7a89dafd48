"""Joins by distance, as equality joins on grid cells with an exact test after."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.geo import DEGREE_M, PLANE_M_PER_LAT, PLANE_M_PER_LON, haversine, planar
from strideway.sources.staging import staged

#: A segment that is longer than so many cells is cut, so that its box stays narrow.
CELLS_PER_PIECE = 10
#: Vertices of a route that one task works out.
BLOCK = 8192
#: How many times the distance the cells of meeting() are wide.
MEETING_CELLS = 4


def close_pairs(points: DataFrame, key: str, metres: float, lat: str = "lat", lon: str = "lon", by: Column | None = None) -> DataFrame:
    """Unordered pairs of rows at most so many planar metres apart, once each: all columns as a_* and b_*, and metres.

    One side is repeated for the cells around it; both sides are shuffled by cell. by: pairs have equal values of it too, and
    rows where it is null have none. It is a key of the join, so a crowded cell makes only the pairs that agree.
    """
    row = points.withColumn("cy", F.floor(F.col(lat) * (PLANE_M_PER_LAT / metres))).withColumn("cx", F.floor(F.col(lon) * (PLANE_M_PER_LON / metres)))
    agree = [] if by is None else ["_by"]
    row = row if by is None else row.withColumn("_by", by).where("_by is not null")
    a = row.select("cy", "cx", *agree, *[F.col(c).alias(f"a_{c}") for c in points.columns])
    around = F.explode(F.array(*[F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    b = row.select(around.alias("c"), *agree, *[F.col(c).alias(f"b_{c}") for c in points.columns]).select("c.*", *agree, *[f"b_{c}" for c in points.columns])
    apart = planar(F.col(f"a_{lat}"), F.col(f"a_{lon}"), F.col(f"b_{lat}"), F.col(f"b_{lon}"))
    met = a.join(b.hint("merge"), ["cy", "cx", *agree]).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return met.drop("cy", "cx", *agree).withColumn("metres", apart).where(F.col("metres") <= metres)


def meeting(left: DataFrame, right: DataFrame, metres: float, how: str = "inner") -> DataFrame:
    """Rows of two tables (lat, lon, by) with equal `by` at most so many metres apart on the sphere: columns as a_* and b_*.

    how: inner, or left_semi for the rows of left (as they are) that meet any. Rows where `by` is null meet none. Cells are MEETING_CELLS times as wide
    as the distance, and the right side is repeated for those that it reaches: two on the average, as rows that meet agree in `by` anyway.
    """
    wide = 1.05 * metres
    per_lat, per_lon = PLANE_M_PER_LAT / (MEETING_CELLS * wide), PLANE_M_PER_LON / (MEETING_CELLS * wide)
    a, b = (t.where("by is not null") for t in (left, right))
    a = a.select(F.floor(F.col("lat") * per_lat).alias("_cy"), F.floor(F.col("lon") * per_lon).alias("_cx"), *[F.col(c).alias(f"a_{c}") for c in left.columns])
    reached = lambda c, per: F.explode(F.sequence(F.floor(F.col(c) * per - 1 / MEETING_CELLS), F.floor(F.col(c) * per + 1 / MEETING_CELLS)))
    b = b.where("abs(lat) < double('infinity') and abs(lon) < double('infinity')").withColumn("_by_y", reached("lat", per_lat)).withColumn("_by_x", reached("lon", per_lon))
    b = b.select("_by_y", "_by_x", *[F.col(c).alias(f"b_{c}") for c in right.columns])
    near = haversine(*map(F.col, ("a_lat", "a_lon", "b_lat", "b_lon"))) <= metres
    met = a.join(b.hint("merge"), (F.col("_cy") == F.col("_by_y")) & (F.col("_cx") == F.col("_by_x")) & (F.col("a_by") == F.col("b_by")) & near, how)
    if how == "left_semi":
        return met.select(*[F.col(f"a_{c}").alias(c) for c in left.columns])
    return met.drop("_cy", "_cx", "_by_y", "_by_x")


def segments(vertices: DataFrame, route: str = "route_id", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """Vertices as segments: a_lat, a_lon, b_lat, b_lon, length_m, and start_m, the length before it.

    seq: whole numbers in the order of a route's vertices. A route is worked out in blocks of so many of them, so one route with most of the
    vertices is many tasks: a block's last vertex leads to the first of the next block, and its lengths begin after those of the
    blocks before; only a row for each block is put in order. A route of one vertex has one segment of no length, so that points still have a
    distance to it.
    """
    keys = [route, "_block"]
    rows = vertices.select(route, seq, "lat", "lon", F.floor(F.col(seq) / block).alias("_block"))
    order, by = Window.partitionBy(route).orderBy("_block"), Window.partitionBy(*keys).orderBy(seq)
    heads = rows.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), seq).alias("_head"), F.count("*").alias("_n"))
    alone = (F.col("_n") == 1) & F.lag("_block").over(order).isNull() & F.lead("_block").over(order).isNull()
    heads = heads.select(*keys, F.coalesce(F.lead("_head").over(order), F.when(alone, F.col("_head"))).alias("_next"))
    ends = [F.coalesce(F.lead(c).over(by), F.when(F.lead(seq).over(by).isNull(), F.col(f"_next.{c}"))).alias(f"b_{c}") for c in ("lat", "lon")]
    cut = rows.join(heads.hint("merge"), keys).select(*keys, seq, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *ends).where("b_lat is not null")
    cut = cut.withColumn("length_m", haversine(*map(F.col, ("a_lat", "a_lon", "b_lat", "b_lon"))))
    before = F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = cut.groupBy(*keys).agg(F.sum("length_m").alias("_m")).select(*keys, before.alias("_start"))
    inside = F.coalesce(F.sum("length_m").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = cut.withColumn("_inside", inside).join(starts.hint("merge"), keys)
    return own.select(route, seq, "a_lat", "a_lon", "b_lat", "b_lon", "length_m", (F.col("_start") + F.col("_inside")).alias("start_m"))


def whole_segments(vertices: DataFrame, route: str = "route_id", seq: str = "seq") -> DataFrame:
    """What segments() gives, for routes that one task can work out: they are shuffled by route once at most, and not at all where they come so."""
    by = Window.partitionBy(route).orderBy(seq)
    ends = [F.coalesce(F.lead(c).over(by), F.when(F.lag(seq).over(by).isNull() & F.lead(seq).over(by).isNull(), F.col(c))).alias(f"b_{c}") for c in ("lat", "lon")]
    cut = vertices.select(route, seq, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *ends).where("b_lat is not null")
    cut = cut.withColumn("length_m", haversine(*map(F.col, ("a_lat", "a_lon", "b_lat", "b_lon"))))
    return cut.withColumn("start_m", F.coalesce(F.sum("length_m").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def route_lengths(segs: DataFrame, route: str = "route_id") -> DataFrame:
    return segs.groupBy(route).agg(F.sum("length_m").alias("length_m"), F.count("*").cast("int").alias("n_segments"))


def projected(rows: DataFrame) -> DataFrame:
    """rows (a point's lat and lon, a segment's ends) with distance_m and t, the place of the nearest point along it (0 to 1).

    On the plane of the three points' mean latitude. Each step is a column of its own, so that none is worked out twice.
    """
    k = F.cos(F.radians((F.col("lat") + F.col("a_lat") + F.col("b_lat")) / 3)) * DEGREE_M
    out = rows.withColumn("_k", k)
    out = out.withColumns({"_px": (F.col("lon") - F.col("a_lon")) * F.col("_k"), "_py": (F.col("lat") - F.col("a_lat")) * DEGREE_M, "_dx": (F.col("b_lon") - F.col("a_lon")) * F.col("_k"), "_dy": (F.col("b_lat") - F.col("a_lat")) * DEGREE_M})
    out = out.withColumn("_s", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_px") * F.col("_dx") + F.col("_py") * F.col("_dy")) / F.nullif("_s", F.lit(0.0))))
    out = out.withColumn("t", F.when(F.col("_s") == 0, 0.0).otherwise(t))
    out = out.withColumns({"_ex": F.col("_px") - F.col("t") * F.col("_dx"), "_ey": F.col("_py") - F.col("t") * F.col("_dy")})
    distance = F.when(F.col("_s") == 0, haversine(*map(F.col, ("lat", "lon", "a_lat", "a_lon")))).otherwise(F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey")))
    return out.withColumn("distance_m", distance).drop("_k", "_px", "_py", "_dx", "_dy", "_s", "_ex", "_ey")


def boxed_segments(points: DataFrame, segs: DataFrame, metres: float | str, max_latitude: float = 60.0, side: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each point with the segments whose boxes, grown by so many metres, hold it: all columns of both, distance_m and t.

    side: how points are joined, where they may be few enough to be sent to all executors (bounded); then boxes aren't shuffled, and rows stay
    where their segment is.

    Every segment within that distance is among them, and some that are farther. metres may name a column of both tables: then rows with
    equal values of it meet, each within its own. Both tables must lie within max_latitude of the equator: cells are made for where a
    degree of longitude is shortest.
    """
    by = [metres] if isinstance(metres, str) else []
    reach = F.col(metres) if by else F.lit(float(metres))
    cell_y, cell_x = reach / (2 * DEGREE_M), reach / (2 * DEGREE_M * math.cos(math.radians(max_latitude)))
    grow_y, grow_x = 2.001 * cell_y, 2.001 * cell_x
    last = F.floor(F.col("length_m") / (CELLS_PER_PIECE * reach / 2))
    part = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_piece") + k) / F.col("_n")
    boxes = segs.withColumn("_n", last + 1).withColumn("_piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    boxes = boxes.select(
        *segs.columns,
        (F.least(part("a_lat", "b_lat", 0), part("a_lat", "b_lat", 1)) - grow_y).alias("_y0"),
        (F.greatest(part("a_lat", "b_lat", 0), part("a_lat", "b_lat", 1)) + grow_y).alias("_y1"),
        (F.least(part("a_lon", "b_lon", 0), part("a_lon", "b_lon", 1)) - grow_x).alias("_x0"),
        (F.greatest(part("a_lon", "b_lon", 0), part("a_lon", "b_lon", 1)) + grow_x).alias("_x1"),
    )
    cells = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    boxes = boxes.withColumn("_cy", cells("_y0", "_y1", cell_y)).withColumn("_cx", cells("_x0", "_x1", cell_x))
    own = points.withColumn("_cy", F.floor(F.col("lat") / cell_y)).withColumn("_cx", F.floor(F.col("lon") / cell_x))
    met = own.join(boxes.hint("merge"), ["_cy", "_cx", *by]) if side is None else boxes.join(side(own), ["_cy", "_cx", *by])
    met = met.where("lat between _y0 and _y1 and lon between _x0 and _x1")
    # a long segment's pieces overlap; one row of them is enough, and more do no harm to a minimum
    return projected(met.drop("_cy", "_cx", "_y0", "_y1", "_x0", "_x1"))


def near_segments(points: DataFrame, segs: DataFrame, metres: float, max_latitude: float = 60.0) -> DataFrame:
    """Each point with the segments at most so many metres away, once each."""
    return boxed_segments(points, segs, metres, max_latitude).where(F.col("distance_m") <= metres).distinct()


def nearness(metres: float) -> Column:
    """_order: by distance_m, as fine as a long has room for (nanometres within 549 m), then by the place in the route, so that equally near
    segments go to the earlier one; all sums stay plain numbers."""
    fine = 10 ** math.floor(math.log10(2**39 / metres))
    return (F.floor(F.least(F.col("distance_m"), F.lit(float(metres))) * float(fine)) * (1 << 24) + F.col("seq")).alias("_order")


def project_points(points: DataFrame, segs: DataFrame, metres: float, point: str = "facility_id", route: str = "route_id", max_latitude: float = 60.0, side: Callable[[DataFrame], DataFrame] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Each point on each route that passes within so many metres: distance_m, progress_m, seq of the nearest segment.

    side: see boxed_segments(); where segments are dealt out by route and points are sent to them, pairs are found and merged where the route is,
    and aren't shuffled. also: columns of segs that are the same for all of a route, and come along.
    """
    near = boxed_segments(points.select(point, "lat", "lon"), segs, metres, max_latitude, side)
    near = near.select(point, route, *also, "seq", "distance_m", (F.col("start_m") + F.col("length_m") * F.col("t")).alias("progress_m"), nearness(metres))
    best = near.groupBy(point, route).agg(F.min("distance_m").alias("distance_m"), F.min_by("progress_m", "_order").alias("progress_m"), F.min_by("seq", "_order").alias("seq"), *[F.first(c).alias(c) for c in also])
    # a point whose nearest segment is too far is dropped here, after the minimum
    return best.where(F.col("distance_m") <= metres)


def nearest_places(near: DataFrame, k: int = 30, route: str = "route_id", point: str = "facility_id") -> DataFrame:
    """The k nearest places of each route, with place from 1: by distance, public toilets first, then wheelchair ones, then id.

    near: route, point, distance_m, public and wheelchair (booleans, null is no).
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    by = Window.partitionBy(route).orderBy("distance_m", yes("public"), yes("wheelchair"), point)
    return near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def nearest_any_distance(routes: DataFrame, points: DataFrame, segs: DataFrame, first_metres: float = 25.0, point: str = "facility_id", route: str = "route_id", seq: str = "seq", side: Callable[[DataFrame], DataFrame] = lambda small: small.hint("merge")) -> DataFrame:
    """Each route's nearest point at whatever distance: distance_m and the point, of equally near ones the smallest.

    A table of the cells that points lie in, from fine to coarse, tells of each route's first vertex the finest size at which a cell beside its
    own has a point; so some point is within a few cells of that size, and one join with that reach for each route finds the nearest. The jobs
    are as many whatever the distance. A route has null only where there are no points or it has no segments.

    side: how points and their cells are joined, where they may be few enough to be sent to all executors (bounded); where segments are dealt out
    by route, all that is found then stays where the route is, and only a row for each route is written.
    """
    finite = "abs(lat) < double('infinity') and abs(lon) < double('infinity')"
    points = points.where(finite)
    ends = segs.select(F.explode(F.array(*[F.struct(F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in "ab"])).alias("p")).select("p.*")
    box = points.select("lat", "lon").unionByName(ends.where(finite)).agg(*[f(c).alias(f.__name__ + c) for c in ("lat", "lon") for f in (F.min, F.max)]).first()
    if box["minlat"] is None:
        return routes.select(route, F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast(points.schema[point].dataType).alias(point))
    extent = DEGREE_M * max(box["maxlat"] - box["minlat"], box["maxlon"] - box["minlon"], 1e-9)
    highest = min(89.9, max(abs(box["minlat"]), abs(box["maxlat"])) + 0.01)
    narrow = math.cos(math.radians(highest))
    # so many sizes that the coarsest cell is as wide as everything there is
    sizes = [first_metres * 2**k for k in range(max(1, math.ceil(math.log2(extent / first_metres)) + 2))]
    sized = F.explode(F.array(*map(F.lit, sizes))).alias("_size")
    cell = lambda: (F.floor(F.col("lat") / (F.col("_size") / DEGREE_M)).alias("_cy"), F.floor(F.col("lon") / (F.col("_size") / (DEGREE_M * narrow))).alias("_cx"))
    occupied = staged(points.select("lat", "lon", sized).select("_size", *cell()).distinct(), "occupied")
    seeds = segs.groupBy(route).agg(F.min_by(F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")), seq).alias("s")).select(route, "s.*", sized).select(route, "_size", *cell())
    beside = F.explode(F.array(*[F.struct((F.col("_cy") + dy).alias("_cy"), (F.col("_cx") + dx).alias("_cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("_c")
    met = seeds.select(route, "_size", beside).select(route, "_size", "_c.*").join(side(occupied), ["_size", "_cy", "_cx"])
    # two cells each way, where a degree of longitude is longest
    reach = staged(met.groupBy(route).agg((F.min("_size") * 2 * math.hypot(1, 1 / narrow)).alias("_reach")), "reach")
    used = reach.select("_reach").distinct()  # one for each size at most
    own = staged(points.select(point, "lat", "lon").crossJoin(F.broadcast(used)), "sized-points")
    near = boxed_segments(own, segs.join(reach.hint("merge"), route), "_reach", highest, side)
    found = near.groupBy(route).agg(F.min(F.struct("distance_m", point)).alias("n")).select(route, "n.distance_m", f"n.{point}")
    return routes.select(route).join(found.hint("merge"), route, "left")


def at_progress(targets: DataFrame, segs: DataFrame, route: str = "route_id", target: str = "target_m", side: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """lat and lon where each target lies along its route (on the geometry's scale); past the end, the last vertex. side: how targets are joined,
    where they may be few enough to be sent to all executors (bounded)."""
    hit = F.col(target) <= F.col("start_m") + F.col("length_m")
    t = F.when(F.col("length_m") > 0, (F.col(target) - F.col("start_m")) / F.nullif("length_m", F.lit(0.0))).otherwise(0.0)
    lat, lon = (F.col(f"a_{x}") + (F.col(f"b_{x}") - F.col(f"a_{x}")) * t for x in ("lat", "lon"))
    place = F.struct("seq", lat.alias("lat"), lon.alias("lon"))
    end = F.struct("seq", F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon"))
    met = targets.join(segs.hint("merge"), route) if side is None else segs.join(side(targets), route)
    found = met.groupBy(*targets.columns).agg(F.coalesce(F.min(F.when(hit, place)), F.max(end)).alias("p"))
    return found.select(*targets.columns, "p.lat", "p.lon")


def slice_route(spans: DataFrame, segs: DataFrame, route: str = "route_id") -> DataFrame:
    """The part of the route from from_m to to_m as an array of points, clipped at both ends, without repeated points."""
    met = spans.join(segs.hint("merge"), route).where("start_m + length_m >= from_m and start_m <= to_m and length_m > 0")
    at = lambda x, m: F.col(f"a_{x}") + (F.col(f"b_{x}") - F.col(f"a_{x}")) * ((m - F.col("start_m")) / F.col("length_m"))
    lo, hi = F.greatest("start_m", "from_m"), F.least(F.col("start_m") + F.col("length_m"), F.col("to_m"))
    ends = F.array(*[F.struct(F.col("seq"), F.lit(k).alias("k"), at("lat", m).alias("lat"), at("lon", m).alias("lon")) for k, m in ((0, lo), (1, hi))])
    gathered = F.flatten(F.array_sort(F.collect_list(ends)))
    points = F.transform(gathered, lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon")))
    fresh = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))
    return met.groupBy(*spans.columns).agg(fresh.alias("points"))


def first_of_union(nearest: DataFrame, group: str = "request_id", route: str = "route_id", key: str = "facility_id", most: int = 30) -> DataFrame:
    """The nearest places of all routes of a group, each once, in the order of routes and places: the first so many.

    nearest: group, route, key and place (as nearest_places numbers them).
    """
    once = nearest.groupBy(group, key).agg(F.min(F.struct(route, "place")).alias("_at"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("_at", key))
    return once.withColumn("position", n).where(F.col("position") <= most).drop("_at")
