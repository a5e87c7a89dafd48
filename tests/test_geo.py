"""Distances, projection and gaps on small geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strideway.functions.geo import haversine, planar, rounded, rounded_away
from strideway.operators import linear, routes, spatial


def line(spark, *points, route=1):
    return spark.createDataFrame([(route, i, float(a), float(b)) for i, (a, b) in enumerate(points)], "route_id long, seq int, lat double, lon double")


def places(spark, *points):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "facility_id long, lat double, lon double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    assert one(spark, haversine(*map(F.lit, (0.0, 0.0, 0.001, 0.0)))) == pytest.approx(111.2, abs=0.1)
    assert one(spark, planar(*map(F.lit, (35.0, 139.0, 35.0001, 139.0)))) == pytest.approx(11.132)


@pytest.mark.parametrize(("x", "n", "up", "away"), [(2.5, 0, 3.0, 3.0), (-2.5, 0, -2.0, -3.0), (1.005, 2, 1.0, 1.0), (-0.2, 0, 0.0, 0.0)])
def test_rounding(spark, x, n, up, away):
    assert one(spark, rounded(F.lit(x), n)) == up
    assert one(spark, rounded_away(F.lit(x), n)) == away and math.copysign(1, one(spark, rounded_away(F.lit(-0.2)))) == 1


def test_gaps_of_the_stated_length(spark):
    segs = spatial.segments(line(spark, (0, 0), (0, 0.01)))
    near = spatial.project_points(places(spark, (0, 0.002), (0, 0.008)), segs, 350.0)
    whole = spatial.route_lengths(segs).withColumn("stated_m", F.lit(1000.0))
    rows = linear.gaps(linear.on_stated_scale(near, whole), whole).orderBy("ordinal").collect()
    assert [round(r["gap_m"]) for r in rows] == [200, 600, 200] and [r["ends_at"] for r in rows] == [0, 1, None]
    top = linear.insertion_suggestion(linear.two_largest(linear.gaps(linear.on_stated_scale(near, whole), whole), ["route_id"])).first()
    assert (round(top["insert_m"]), round(top["improved_m"]), round(top["improved_ratio"], 2)) == (500, 300, 0.5)


def test_route_without_points_is_one_gap(spark):
    whole = spark.createDataFrame([(1, 500.0)], "route_id long, stated_m double")
    rows = linear.gaps(spark.createDataFrame([], "route_id long, facility_id long, position_m double"), whole).collect()
    assert [(r["start_m"], r["end_m"], r["ends_at"]) for r in rows] == [(0.0, 500.0, None)]


@pytest.mark.parametrize("metres", [60.0, 350.0])
def test_grid_join_finds_what_all_pairs_find(spark, metres):
    r = random.Random(4)
    spots = places(spark, *[(35.68 + r.random() * 0.02, 139.69 + r.random() * 0.02) for _ in range(150)])
    walk, at = [], (35.69, 139.70)
    for i in range(40):
        at = at if i == 7 else (at[0] + (r.random() - 0.5) * 0.004, at[1] + (r.random() - 0.5) * (0.004 if i % 9 else 0.06))
        walk.append(at)
    segs = spatial.segments(line(spark, *walk))
    every = spatial.projected(spots.crossJoin(segs)).where(F.col("distance_m") <= metres)
    want = {(x["facility_id"], round(x["m"], 6)) for x in every.groupBy("facility_id").agg(F.min("distance_m").alias("m")).collect()}
    got = {(x["facility_id"], round(x["distance_m"], 6)) for x in spatial.project_points(spots, segs, metres).collect()}
    assert got == want and want
    near = spatial.near_segments(spots, segs, metres)
    assert near.count() == every.count() == near.select("facility_id", "seq").distinct().count()
    shuffled = spatial.project_points(spots.orderBy(F.rand(3)).repartition(5), segs.repartition(3), metres)
    assert {(x["facility_id"], round(x["distance_m"], 6)) for x in shuffled.collect()} == want


def test_the_nearer_of_two_segments_wins_by_less_than_a_micrometre(spark):
    # 111.19492664 m to the way out, a third of a micrometre less to the way back
    segs = spatial.segments(line(spark, (0.001, -0.001), (0.001, 0.001), (-0.001 + 3e-12, 0.001), (-0.001 + 3e-12, -0.001)))
    found = spatial.project_points(places(spark, (0, 0)), segs, 350.0).first()
    assert found["seq"] == 2 and found["progress_m"] > 400
    # equally near ones: the earlier
    there_and_back = spatial.segments(line(spark, (0.001, -0.001), (0.001, 0.001), (0.001, -0.001)))
    assert spatial.project_points(places(spark, (0, 0)), there_and_back, 350.0).first()["seq"] == 0


def test_close_pairs_are_those_of_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, 35.0 + r.randrange(60) * 3e-5, 139.0 + r.randrange(60) * 3e-5) for i in range(200)]
    spots = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {(x["a_id"], x["b_id"]) for x in spatial.close_pairs(spots, "id", 10.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.hypot((a[1] - b[1]) * 111320, (a[2] - b[2]) * 91000) <= 10}
    assert got == want and want


def test_nearest_at_any_distance(spark):
    segs = spatial.segments(line(spark, (35.0, 139.0), (35.0, 139.01)))
    routes_ = segs.select("route_id").distinct()
    found = spatial.nearest_any_distance(routes_, places(spark, (35.05, 139.0), (35.2, 139.0)), segs).first()
    assert found["facility_id"] == 0 and found["distance_m"] == pytest.approx(5560, rel=0.01)
    assert spatial.nearest_any_distance(routes_, places(spark).limit(0), segs).first()["distance_m"] is None


@pytest.mark.parametrize("lat", [37.0, 68.0])
def test_nearest_has_no_last_radius(spark, lat):
    segs = spatial.segments(line(spark, (35.0, 139.0), (35.0, 139.01)))
    found = spatial.nearest_any_distance(segs.select("route_id").distinct(), places(spark, (lat, 139.0)), segs).first()
    assert found["facility_id"] == 0 and found["distance_m"] == pytest.approx((lat - 35) * 111195, rel=0.01)


def test_slice_and_place_along(spark):
    segs = spatial.segments(line(spark, (0, 0), (0, 0.01), (0, 0.02)))
    half = spatial.at_progress(spark.createDataFrame([(1, 1112.0), (1, 1e9)], "route_id long, target_m double"), segs)
    assert sorted(round(x["lon"], 4) for x in half.collect()) == [0.01, 0.02]
    cut = spatial.slice_route(spark.createDataFrame([(1, 556.0, 1668.0)], "route_id long, from_m double, to_m double"), segs).first()["points"]
    assert [round(p["lon"], 3) for p in cut] == [0.005, 0.01, 0.015]


def test_insertion_gain_is_that_of_cutting_again(spark):
    r = random.Random(6)
    cuts = sorted(r.uniform(0, 1000) for _ in range(5))
    whole = spark.createDataFrame([(1, 1000.0)], "route_id long, stated_m double")
    at = spark.createDataFrame([(1, i, c) for i, c in enumerate(cuts)], "route_id long, facility_id long, position_m double")
    largest = linear.two_largest(linear.gaps(at, whole, inside=True), ["route_id"]).withColumn("stated_m", F.lit(1000.0))
    tries = [-5.0, 0.0, 1000.0, *cuts, *[r.uniform(0, 1000) for _ in range(60)]]
    got = linear.insertion_gain(spark.createDataFrame([(1, i, p) for i, p in enumerate(tries)], "route_id long, facility_id long, position_m double"), largest)

    def longest(points):
        p = [0.0, *sorted(x for x in points if 0 < x < 1000), 1000.0]
        return max(b - a for a, b in zip(p, p[1:], strict=False))

    for x in got.collect():
        assert x["gross_m"] == pytest.approx(max(0, longest(cuts) - longest([*cuts, x["position_m"]])), abs=1e-9)


def test_rank_breaks_ties_key_by_key(spark):
    base = {"request_id": 1, "score": 10.0, "meets": True, "n_violations": 0, "max_minutes": 5.0, "longest_m": 100.0, "seconds": 60.0, "stated_m": 70.0, "route_id": 5}
    for key, worse in (("score", 11.0), ("meets", False), ("n_violations", 1), ("max_minutes", 6.0), ("longest_m", 101.0), ("seconds", 61.0), ("stated_m", 71.0), ("route_id", 6)):
        rows = [base, {**base, "route_id": 9, key: worse}] if key != "route_id" else [{**base, key: worse}, base]
        if key != "route_id":
            rows = [{**base, "route_id": 10}, {**base, "route_id": 9, key: worse}]
        ranked = routes.rank_routes(spark.createDataFrame(rows)).orderBy("rank").collect()
        assert ranked[1][key] == worse


def test_request_rules_in_order(spark):
    good = (1, 35.69, 139.70, 35.70, 139.71, 10, True, True, False)
    rows = [good, (2, None, *good[2:]), (3, 95.0, *good[2:]), (4, 36.5, *good[2:]), (5, 35.69, 139.70, 35.69, 139.70, *good[5:]), (6, 35.1, *good[2:]), (7, *good[1:5], 7, *good[6:]), (8, *good[1:8], None)]
    table = spark.createDataFrame(rows, "request_id int, from_lat double, from_lon double, to_lat double, to_lon double, limit_minutes int, require_toilet boolean, avoid_steep boolean, prefer_indoor boolean")
    found = {r["request_id"]: (r["code"], r["problem"]) for r in routes.request_problem(table).collect()}
    assert found == {1: (None, None), 2: (400, "not_finite"), 3: (400, "out_of_range"), 4: (422, "outside_area"), 5: (400, "same_place"), 6: (422, "too_far"), 7: (400, "limit_minutes"), 8: (400, "preferences")}


def test_a_long_route_is_cut_into_blocks(spark):
    """One route has most vertices; blocks change nothing, and a route of one vertex keeps it."""
    rng = random.Random(2)
    rows = [(1, i, 35 + i * 1e-4 + rng.random() * 1e-4, 139 + rng.random() * 1e-3) for i in range(700)] + [(r, 3 * i, 35 + rng.random(), 139.0) for r in range(2, 9) for i in range(r)] + [(9, 64, 35.0, 139.0), (10, 5, 35.0, 139.0), (10, 800, 35.1, 139.0)]
    table = spark.createDataFrame(rows, "route_id long, seq int, lat double, lon double").repartition(5)
    whole = {(r["route_id"], r["seq"]): r for r in spatial.segments(table, block=1 << 20).collect()}
    parts = spatial.segments(table, block=16)
    found = {(r["route_id"], r["seq"]): r for r in parts.collect()}
    assert found.keys() == whole.keys() and len(found) == 699 + sum(r - 1 for r in range(2, 9)) + 2
    for k, r in whole.items():
        assert [found[k][c] for c in ("a_lat", "b_lat", "a_lon", "b_lon", "length_m")] == [r[c] for c in ("a_lat", "b_lat", "a_lon", "b_lon", "length_m")] and abs(found[k]["start_m"] - r["start_m"]) < 1e-6
    assert (found[9, 64]["length_m"], found[9, 64]["b_lat"]) == (0.0, 35.0)
    near = spatial.project_points(spark.createDataFrame([(1, 35.001, 139.0)], "facility_id long, lat double, lon double"), parts.where("route_id = 9"), 350.0).collect()
    assert [(r["route_id"], round(r["distance_m"]), r["progress_m"]) for r in near] == [(9, 111, 0.0)]


@pytest.mark.parametrize("stretch", [7.0, 50.0, 1e6])
def test_largest_gaps_merge_like_one_window(spark, stretch):
    rng = random.Random(3)
    rows = [(1, i, float(rng.randrange(1000))) for i in range(400)] + [(r, i, float(rng.randrange(0, 200, 5))) for r in range(2, 30) for i in range(r % 7)]
    positions = spark.createDataFrame(rows, "route_id long, facility_id long, position_m double")
    lengths = spark.createDataFrame([(r, 1000.0 if r == 1 else 200.0) for r in range(1, 33)] + [(40, 0.0)], "route_id long, stated_m double")
    want = {tuple(r) for r in linear.two_largest(linear.gaps(positions, lengths), ["route_id"]).collect()}
    assert {tuple(r) for r in linear.largest_gaps(positions, lengths, stretch=stretch).collect()} == want and len(want) == 33


def test_nearest_agrees_with_brute_force_near_and_far(spark):
    """Routes among the points, a few kilometres off, and a world away; the same jobs for all."""
    rng = random.Random(5)
    spots = [(i, 35 + rng.random() * 0.2, 139 + rng.random() * 0.2) for i in range(40)] + [(99, -20.0, 10.0)]
    lines = {r: [(35 + rng.random() * 0.2, 139 + rng.random() * 0.2) for _ in range(5)] for r in range(8)} | {8: [(36.4, 139.0), (36.5, 139.2)], 9: [(-45.0, -60.0), (-45.1, -60.1)], 10: [(35.1, 139.1)]}
    table = spark.createDataFrame([(r, i, *p) for r, ps in lines.items() for i, p in enumerate(ps)], "route_id long, seq int, lat double, lon double")
    points = spark.createDataFrame([*spots, (77, None, 1.0), (78, float("nan"), 1.0)], "facility_id long, lat double, lon double")
    segs = spatial.segments(table)
    every = spatial.projected(points.where("facility_id not in (77, 78)").crossJoin(segs)).groupBy("route_id").agg(F.min(F.struct("distance_m", "facility_id")).alias("n"))
    want = {r["route_id"]: (round(r["n"]["distance_m"], 6), r["n"]["facility_id"]) for r in every.collect()}
    found = {r["route_id"]: (round(r["distance_m"], 6), r["facility_id"]) for r in spatial.nearest_any_distance(segs.select("route_id").distinct(), points, segs).collect()}
    assert found == want and len(found) == 11


def metres_between(a, b):
    (y, x), (v, u) = (map(math.radians, p) for p in (a, b))
    return 2 * 6371000.0 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


def test_whole_segments_are_segments(spark):
    rng = random.Random(5)
    rows = [(r, i, rng.uniform(35.6, 35.7), rng.uniform(139.6, 139.7)) for r, n in ((1, 1), (2, 2), (3, 40)) for i in range(n)]
    table = spark.createDataFrame(rows, "route_id long, seq int, lat double, lon double")
    found, want = spatial.whole_segments(table), spatial.segments(table)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_meeting_finds_all_that_is_near(spark):
    rng = random.Random(6)
    rows = [(i, 35.69 + rng.uniform(-0.002, 0.002), 139.7 + rng.uniform(-0.002, 0.002), f"t{i % 3}") for i in range(400)]
    table = spark.createDataFrame([*rows, (400, None, 139.7, "t1"), (401, 35.69, float("nan"), "t1")], "id long, lat double, lon double, by string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] == b[3] and metres_between(a[1:3], b[1:3]) <= 25}
    met = spatial.meeting(table, table, 25.0)
    assert {(r["a_id"], r["b_id"]) for r in met.collect()} == want and len(want) > 400
    assert {r["id"] for r in spatial.meeting(table, table, 25.0, "left_semi").collect()} == {a for a, _ in want}
