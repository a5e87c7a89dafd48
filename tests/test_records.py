"""Ingest, clustering, verification, candidates and sinks on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strideway.functions import labels, text
from strideway.operators import candidates, cluster, ingest, spatial, verify
from strideway.sources import readers, writers


def test_csv_in_three_encodings(spark, tmp_path):
    body = 'ID,名称,緯度,経度,備考\n1,"公園, 中央",35.6,139.7,"a ""b""\nc"\n2,駅,,139.7,\n,,,,\n3,庁舎,abc,139.7\n'
    for encoding, name in (("UTF-8", "utf8"), ("UTF-16LE", "utf16"), ("Shift_JIS", "sjis")):
        p = tmp_path / f"{name}.csv"
        p.write_bytes(body.encode(encoding.lower().replace("-", "_") if encoding != "UTF-16LE" else "utf-16-le"))
        rows = readers.read_csv(spark, readers.Dataset("d", str(p), encoding, ("ID", "名称"))).collect()
        assert [r["名称"] for r in rows] == ["公園, 中央", "駅", "庁舎"] and rows[0]["備考"].startswith('a "b"')
        typed = ingest.typed_records(readers.read_csv(spark, readers.Dataset("d", str(p), encoding)), *map(F.col, ("緯度", "経度", "ID", "名称")))
        assert [r["problem"] for r in typed.collect()] == [None, "coordinate_blank", "coordinate_not_numeric"]
    with pytest.raises(readers.MissingHeaders):
        readers.read_csv(spark, readers.Dataset("d", str(tmp_path / "utf8.csv"), "UTF-8", ("住所",)))


def test_text_functions(spark):
    row = spark.createDataFrame([("ＡＢ（c）・ d-e", " ", "有", "true", "FALSE", "1e3", "NaN", "202403", "20243", "2026-02-28T10:00:00+09:00", "2026-02-30T10:00:00Z", "=1")], ", ".join(f"c{i} string" for i in range(12)))
    c = [F.col(f"c{i}") for i in range(12)]
    got = row.select(text.match_text(c[0]), text.nullable(c[1]), text.mark(c[2]), text.tristate(c[3]), text.tristate_invalid(c[4]), text.number(c[5]), text.number(c[6]), text.year_month(c[7]), text.year_month(c[8]), text.iso_text(text.instant(c[9])), text.instant(c[10]), text.formula_safe(c[11]), text.compact_id(c[0], c[1]), text.opening_hours(c[2], c[1], c[2], c[3])).first()
    assert list(got) == ["abcde", None, True, True, True, 1000.0, None, "2024-03", None, "2026-02-28T01:00:00.000Z", None, "'=1", "ＡＢcd-e-0", "有 / true"]


def test_clusters_are_transitive_and_do_not_depend_on_order(spark):
    rows = [(i, "x" if i < 6 else "y", 35.0 + i * 6e-5, 139.0) for i in range(12)] + [(20, "", 36.0, 139.0), (21, "", 36.0, 139.0), (30, "z", 37.0, 139.0)]
    rows = [(i, n, a, y, x) for (i, n, y, x), a in zip(rows, [*"abcdefghijkl", "", "", "z"])] + [(40, "p", "one address", 38.0, 139.0), (41, "q", "one address", 38.00007, 139.0), (42, "q", "", 38.00014, 139.0), (43, "", "", 38.00021, 139.0)]
    table = spark.createDataFrame(rows, "id long, name string, address string, lat double, lon double")
    want = {i: 0 for i in range(6)} | {i: 6 for i in range(6, 12)} | {20: 20, 21: 20, 30: 30} | {40: 40, 41: 40, 42: 40, 43: 43}
    for t in (table, table.orderBy(F.rand(1)).repartition(5)):
        assert {r["id"]: r["place_id"] for r in cluster.cluster_places(t, "id", "name", "address").collect()} == want


def test_clusters_agree_with_all_pairs_and_crowded_coordinates_make_none(spark):
    rng = random.Random(3)
    spots = [(35.0 + rng.randrange(40) * 2e-5, 139.0 + rng.randrange(3) * 4e-6) for _ in range(40)]
    rows = [(i, rng.choice(["", "x", "y", "z", None]), rng.choice(["", "p", "q", None]), *(spots[0] if i % 3 == 0 else rng.choice(spots))) for i in range(150)]
    rows += [(200, "x", "p", None, 139.0), (201, "x", "p", float("nan"), 139.0), (202, "x", "p", float("nan"), 139.0), (203, "x", "p", float("inf"), 139.0), (204, "x", "p", float("inf"), 139.0)]
    table = spark.createDataFrame(rows, "id long, name string, address string, lat double, lon double")
    finite = table.where("id < 203")
    pairs = spatial.close_pairs(finite, "id", 10.0).collect()
    place = {r[0]: r[0] for r in rows}
    for _ in rows:
        for p in pairs:
            if p["metres"] <= 1 or any(p[f"a_{c}"] and p[f"a_{c}"] == p[f"b_{c}"] for c in ("name", "address")):
                place[p["a_id"]] = place[p["b_id"]] = min(place[p["a_id"]], place[p["b_id"]])
    members = cluster.cluster_places(table, "id", "name", "address")
    assert {r["id"]: r["place_id"] for r in members.collect()} == place
    # a third of all rows at one coordinate, and no text is on so many pairs as they would make
    edges = cluster.edges_at(table, "id").count() + sum(cluster.edges_near(cluster.spots(table, "id", c), 10.0, cluster.known(c)).count() for c in ("name", "address"))
    assert edges < len(pairs) / 3
    far = {(p["a_id"], p["b_id"]) for p in spatial.close_pairs(finite, "id", 25.0).collect() if place[p["a_id"]] != place[p["b_id"]]}
    got = [(r["a_id"], r["b_id"]) for r in cluster.ambiguous_pairs(table, members, "id").collect()]
    assert set(got) == far and len(got) == len(far)
    own = finite.withColumn("dataset", F.col("id") % 2)
    want = {(p["a_id"], p["b_id"]): "same_name" if p["a_name"] and p["a_name"] == p["b_name"] else "same_address" for p in spatial.close_pairs(own, "id", 25.0).collect() if p["a_dataset"] != p["b_dataset"] and any(p[f"a_{c}"] and p[f"a_{c}"] == p[f"b_{c}"] for c in ("name", "address"))}
    got = [((r["a_id"], r["b_id"]), r["reason"]) for r in cluster.duplicates_across(own, "id", "dataset", "name", address="address").collect()]
    assert dict(got) == want and len(got) == len(want)


def test_same_facility_and_anomalies(spark):
    rows = [(1, "a", "Tokyo 1-2-3 East", 35.0, 139.0), (2, "b", "Tokyo 1-2-3 East 4F", 35.0001, 139.0), (3, "a", "", 35.00012, 139.0), (4, "c", "short", 35.0, 139.0), (5, "d", "shorter", 35.0, 139.0)]
    table = spark.createDataFrame(rows, "id long, name string, address string, lat double, lon double")
    assert {(r["a_id"], r["b_id"]) for r in cluster.same_facility_pairs(table, "id", "name", "address").collect()} == {(1, 2), (1, 3)}
    assert {r["id"] for r in cluster.coordinate_anomalies(table, "id", "name", "address").collect()} == {1, 4, 5}


def test_verification_reasons_and_latest(spark):
    cols = ("verification_id", "candidate_id", "name", "lat", "lon", "verified_at", "method", "verifier", "evidence", *verify.FLAGS)
    good = ("v1", "c1", "n", "35", "139", "2026-01-02T03:04:05Z", "on_site_observation", "w", "https://x.example/", "true", "true", "", "", "", "null")
    rows = [good, ("v2", *good[1:5], "null", "combined_on_site_and_official", *good[7:10], "null", *good[11:]), ("v3", "c9", *good[2:]), ("v4", *good[1:3], "NaN", "10", "2026-02-30T03:04:05Z", "hearsay", "w", "http://x.example/", "perhaps", *good[10:]), ("v5", *good[1:]), ("v5", *good[1:])]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    known = spark.createDataFrame([("c1",)], "candidate_id string")
    found = {}
    for r in verify.validate(table, known, "urn:mine:").collect():
        found.setdefault(r["verification_id"], []).append(r["reasons"])
    assert found["v1"] == [[]] and found["v2"] == [[]] and found["v3"] == [["unknown_candidate_id"]] and found["v5"] == [["duplicate_verification_id"]] * 2
    assert found["v4"] == [["invalid_evidence_reference", "invalid_latitude", "invalid_longitude", "invalid_verification_method", "invalid_verified_at", "publiclyAccessible:invalid_tristate_boolean"]]
    valid = verify.typed(verify.validate(table, known, "urn:mine:").where(F.size("reasons") == 0))
    assert [r["verification_id"] for r in verify.latest(valid).collect()] == ["v1"]
    level = valid.select("verification_id", F.col("level").alias("l"))
    assert {r["verification_id"]: r["l"] for r in level.collect()} == {"v1": "confirmed", "v2": "possible"}


def test_overlay_and_replacement(spark):
    base = spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, seating boolean")
    seen = spark.createDataFrame([(1, None), (2, True)], "id long, seating boolean")
    assert {(r["id"], r["seating"], r["verified"]) for r in verify.overlay(base, seen, "id", ("seating",)).collect()} == {(1, True, True), (2, True, True), (3, False, False)}
    new = spark.createDataFrame([(9, True, [1, 3])], "id long, seating boolean, related array<long>")
    assert {r["id"] for r in verify.replace_verified(base, new, "id", "related").collect()} == {2, 9}


def test_saved_ranking(spark):
    """Rows of a published ranking: distance, gap and gain give adjusted metres, ratio and score."""
    rows = [("shinjuku-131041000179", "public_service_facility", 197.0, 1147.0, 300.0, 1, 3, 1, 103.0, 0.0895, 222.36, "sensitive"), ("shopping", "commercial_facility", 96.0, 1171.0, 129.0, 1, 2, 1, 33.0, 0.0278, None, "marginal"), ("accommodation", "private_hospitality", 200.0, 1147.0, 541.0, 1, 2, 1, 341.0, 0.2972, None, "robust")]
    schema = "id string, category string, distance_r double, gap_r double, gross_r double, covered_routes int, source_quality int, group_size int, want_m double, want_ratio double, want_score double, want_class string"
    table = spark.createDataFrame(rows, schema).join(candidates.policies(spark), "category")
    own = candidates.detour_scenarios(table)
    for r in own.collect():
        assert (r["adjusted_m"], r["detour_class"]) == (r["want_m"], r["want_class"])
        # the published ratio is that of the unrounded gap
        assert r["adjusted_ratio"] == pytest.approx(r["want_ratio"], abs=5e-4)
    ranks = candidates.scenario_ranks(own, key="id")
    assert ranks.count() == 45 and ranks.select("scenario").distinct().count() == 15
    assert {r["id"]: r["rank"] for r in ranks.where("scenario = 'baseline'").collect()}["shinjuku-131041000179"] == 1


def test_partial_skylines_merge_level_by_level(spark):
    """More partitions than one task merges, and a region of half a million rows whose skyline is small."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "a", "b"]), rng.randrange(30), rng.randrange(30), rng.randrange(30)) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, region string, a int, b int, c int").repartition(candidates.FAN_IN * 3)
    beats = lambda x, y: x[1] == y[1] and x[2] >= y[2] and x[3] >= y[3] and x[4] <= y[4] and x[2:] != y[2:]
    got = candidates.skyline(table, "id", ["a", "b"], ["c"], region="region")
    assert {r["id"] for r in got.where("on_skyline").collect()} == {y[0] for y in rows if not any(beats(x, y) for x in rows)} and got.count() == len(rows)
    large = spark.range(500_000).selectExpr("id", "id % 1009 AS a", "(id * 7919) % 1013 AS b", "(id * 104729) % 1019 AS c")
    top = candidates.skyline(large, "id", ["a", "b"], ["c"]).where("on_skyline")
    assert top.agg(F.max("a"), F.max("b"), F.min("c")).first()[:] == (1008, 1012, 0) and top.count() < 5000
    assert candidates.skyline(large.where("a < 0"), "id", ["a", "b"], ["c"]).count() == 0


def test_ranks_without_regions(spark):
    rng = random.Random(5)
    cols = ("score", "adjusted_r", "ratio_r", "covered_routes", "distance_r")
    rows = [(i, *(float(rng.randrange(4)) for _ in cols)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], -r[4], r[5], r[0]))]
    assert [r["id"] for r in candidates.rank_candidates(table, "id", most=40).orderBy("priority").collect()] == want[:40]


def test_skyline_is_that_of_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, i % 3, r.randrange(6), r.randrange(6), r.randrange(6)) for i in range(150)]
    got = candidates.skyline(spark.createDataFrame(rows, "id long, region int, a int, b int, c int").repartition(4), "id", ["a", "b"], ["c"], region="region")

    def beats(x, y):
        p, q = (x[2], x[3], -x[4]), (y[2], y[3], -y[4])
        return x[1] == y[1] and all(i >= j for i, j in zip(p, q, strict=True)) and p != q

    assert {x["id"] for x in got.where("on_skyline").collect()} == {y[0] for y in rows if not any(beats(x, y) for x in rows)}


def brute_shortlist(rows):
    rows = sorted((x for x in rows if x["on_skyline"] and x["detour_class"] != "ineffective"), key=lambda x: (-x["top_rate"], -x["conservative_m"], x["baseline_rank"], x["id"]))
    chosen, hotels = [], 0

    def add(x):
        nonlocal hotels
        if x in chosen or len(chosen) == 5 or (x["category"] == "private_hospitality" and hotels == 3):
            return
        hotels += x["category"] == "private_hospitality"
        chosen.append(x)

    for x in [x for x in rows if x["category"] in candidates.PUBLIC][:1]:
        add(x)
    for x in [x for x in rows if x["detour_class"] == "robust"][:3]:
        add(x)
    for x in rows:
        add(x)
    return [x["id"] for x in chosen]


@pytest.mark.parametrize("seed", range(6))
def test_shortlist_is_the_greedy_one(spark, seed):
    r = random.Random(seed)
    rows = [{"id": i, "on_skyline": r.random() < 0.8, "detour_class": r.choice(["robust", "marginal", "sensitive", "ineffective"]), "category": r.choice(["private_hospitality"] * 4 + ["public_service_facility", "commercial_facility"]), "top_rate": r.choice([0.2, 0.8, 1.0]), "conservative_m": float(r.randrange(5)), "baseline_rank": r.randrange(9)} for i in range(14)]
    got = candidates.shortlist(spark.createDataFrame(rows), key="id").orderBy("visit_priority").collect()
    assert [x["id"] for x in got] == brute_shortlist(rows)


def test_a_visit_plan_has_the_fixed_columns(spark):
    row = (7, 1, 2, "private_hospitality", "robust_improvement", "robust", "resilient_top5", 0.8667, 12.0, 40.0, 30.0, 20.0)
    short = spark.createDataFrame([row], "facility_id long, request_id long, visit_priority int, category string, role string, detour_class string, stability string, top_rate double, distance_r double, optimistic_m double, adjusted_m double, conservative_m double")
    places = spark.createDataFrame([(7, "n", None, 35.0, 139.0)], "facility_id long, name string, address string, lat double, lon double")
    plan = candidates.visit_plan(short, places, spark.createDataFrame([(7, [3, 1])], "facility_id long, route_ids array<long>"))
    assert plan.columns == ["request_id", *candidates.PLAN_COLUMNS, *candidates.RESULT_COLUMNS] and len(plan.columns) == 1 + 17 + 14
    x = plan.first()
    assert (x["verificationId"], x["targetRouteIds"], x["caution"]) == ("fv-7", [1, 3], candidates.PRIVATE_CAUTION)
    assert x["stabilityDescription"] == "検討した迂回条件でも改善が残る（往復直線proxy控除後も正）。検討した15設定の86.67%で上位5。" and x["notes"] is None


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(2, ["a", "b"], None, "-x"), (1, [], True, 'q"uote, and\nline')], "id long, tags array<string>, ok boolean, note string")
    writers.write_csv(table.coalesce(1), str(tmp_path / "a"), ["id"], for_spreadsheets=True)
    body = b"".join(sorted((p.read_bytes() for p in (tmp_path / "a").glob("part-*")), reverse=True))
    assert body.startswith("﻿id,tags,ok,note\r\n".encode()) and b"2,a|b,," in body and b"'-x" in body
    writers.write_json(table, str(tmp_path / "j"), ["id"])
    assert [r["id"] for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == [1, 2]
    shapes = spark.createDataFrame([(1, 1, 35.0, 139.0), (1, 0, 35.5, 139.5)], "route_id long, place long, lat double, lon double")
    one = writers.feature_collections(shapes.withColumn("feature", writers.feature("Point", writers.lon_lat(F.col("lat"), F.col("lon")), place=F.col("place"))), "route_id", ["place"]).first()["collection"]
    assert [f["geometry"]["coordinates"] for f in json.loads(one)["features"]] == [[139.5, 35.5], [139.0, 35.0]]


def test_publish_is_whole_or_nothing(spark, tmp_path):
    a, b = spark.range(5).toDF("x"), spark.range(3).toDF("y")
    folder = f"file://{tmp_path}/out"
    assert writers.publish({"a": a, "b": b}, folder, "r1", {}) == ["a", "b"]
    assert writers.publish({"a": a.repartition(3), "b": spark.range(4).toDF("y")}, folder, "r2", {}) == ["b"]
    with pytest.raises(ValueError, match="rows_missing"):
        writers.publish({"a": b}, folder, "r3", {"rows_missing": a})
    current = {r["table_name"]: r["path"] for r in spark.read.parquet(f"{folder}/current").collect()}
    assert current["a"].endswith("r1/a") and current["b"].endswith("r2/b")
    (tmp_path / "out" / "current").rename(tmp_path / "out" / "next")  # as a run leaves it that is cut off between the two pointers
    assert writers.publish({"a": a, "b": spark.range(4).toDF("y")}, folder, "r4", {}) == [] and not (tmp_path / "out" / "next").exists()
    assert writers.difference(a, a.where("x > 0")).collect() == [(0, "first")]


def test_routing_responses_and_snapshots(spark, tmp_path):
    body = {"features": [{"geometry": {"coordinates": [[139.7, 35.6], [139.71, 35.61]]}, "properties": {"summary": {"distance": 900.0, "duration": 20.0}, "segments": [{"steps": [{"distance": 1.0, "duration": 2.0, "instruction": "go"}]}], "extras": {"steepness": {"values": [[0, 1, 4], [1, 2, -5], [2, 3, 3]]}}}}]}
    got = {r["id"]: r for r in readers.routing_responses(spark.createDataFrame([(1, json.dumps(body)), (2, '{"features":[]}')], "id int, body string")).collect()}
    assert got[1]["valid"] and got[1]["steep_count"] == 2 and got[1]["minutes"] == 1 and got[1]["points"][0]["lat"] == 35.6 and len(got[1]["steps"]) == 1
    assert not got[2]["valid"]
    saved = {"generatedAt": "t", "routes": [{"id": "a", "name": "n", "profile": "standard", "coordinates": [[35.6, 139.7], [35.61, 139.71]], "distanceMeters": 900, "durationSeconds": 700, "steepSlopeCount": 0}, {"id": "a", "name": "n", "profile": "quiet", "coordinates": [[35.7, 139.7]], "distanceMeters": 0, "durationSeconds": 700}]}
    (tmp_path / "s.json").write_text(json.dumps(saved, indent=1))
    table = readers.route_snapshot(spark, str(tmp_path / "s.json"))
    assert readers.vertices(table).count() == 3
    request = spark.createDataFrame([(35.6, 139.7, 35.61, 139.71)], "from_lat double, from_lon double, to_lat double, to_lon double")
    problems = {(r["route_id"], r["problem"]) for r in readers.snapshot_problems(table, request, ("standard", "quiet", "stepfree")).collect()}
    assert problems == {("a", p) for p in ("duplicate_id", "too_few_vertices", "start_elsewhere", "end_elsewhere", "distance_not_positive")} | {(None, "profiles")}
    assert readers.snapshots(spark, str(tmp_path / "s.json")).first()["byte_size"] == (tmp_path / "s.json").stat().st_size


def test_manifest_keeps_retrieval_time(spark):
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    snaps = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2")], "dataset string, byte_size long, content_sha256 string")
    old = spark.createDataFrame([("a", "h1", "2026-01-01"), ("b", "other", "2026-01-01")], "dataset string, content_sha256 string, retrieved_at string")
    records = spark.createDataFrame([("a", None), ("a", "coordinate_blank")], "dataset string, problem string")
    got = {r["dataset"]: r for r in ingest.manifest(records, snaps, names, old, F.lit("2026-02-02")).collect()}
    assert (got["a"]["retrieved_at"], got["a"]["n_records"], got["a"]["n_rejected"]) == ("2026-01-01", 1, 1)
    assert got["b"]["retrieved_at"] == got["a"]["generated_at"] == "2026-02-02"
    assert ingest.require_rows(records).count() == 0


def test_hours_with_one_end_missing(spark):
    rows = [("9:00", "17:00", None), ("9:00", " ", "closed on Monday"), ("", "17:00", ""), (None, None, "by appointment")]
    table = spark.createDataFrame(rows, "a string, b string, n string")
    got = [r[0] for r in table.select(text.hours_between(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == ["9:00〜17:00", "9:00〜不明（closed on Monday）", "不明〜17:00", None]


def test_primary_route_is_one_that_counts(spark):
    """The route with the larger gain is too long for the ratio; the other one counts, and is the primary one."""
    rows = [(1, 10, 20.0, 5000.0, 120.0), (1, 11, 20.0, 1000.0, 90.0), (2, 10, 20.0, 5000.0, 0.0)]
    table = spark.createDataFrame(rows, "facility_id long, route_id long, distance_m double, longest_m double, gross_m double")
    found = {r["facility_id"]: r for r in candidates.best_route(candidates.route_metrics(table)).collect()}
    assert (found[1]["route_id"], found[1]["counts"], found[1]["covered_routes"], found[1]["any_gain"]) == (11, True, 1, True)
    assert (found[2]["counts"], found[2]["any_gain"]) == (False, False)


def test_links_and_twins_agree_with_all_pairs(spark):
    rng = random.Random(8)
    spots = [(35.0 + rng.randrange(12) * 1e-4, 139.0 + rng.randrange(4) * 1e-4) for _ in range(25)]
    address = ["", None, "short", "shorter", "1-2-3 east", "1-2-3 east 4f", "1-2-3 east 4f 2", "1-2-3 west", "1-2-3 ea"]
    rows = [(i, rng.choice(["", None, "x", "y", "z"]) if i % 2 else f"n{i}", rng.choice(address), *rng.choice(spots), i % 3 > 0, i % 3 == 0) for i in range(160)]
    rows += [(200, "x", "1-2-3 east", None, 139.0, True, False), (201, "x", "1-2-3 east", float("nan"), 139.0, True, False)]
    table = spark.createDataFrame(rows, "id long, name string, address string, lat double, lon double, possible boolean, strict boolean")
    pairs = cluster.same_facility_pairs(table.where("id < 200"), "id", "name", "address", more=("possible", "strict")).collect()
    place = {r[0]: r[0] for r in rows}
    for _ in rows:
        for p in pairs:
            place[p["a_id"]] = place[p["b_id"]] = min(place[p["a_id"]], place[p["b_id"]])
    links = cluster.same_facility_links(table, "id", "name", "address")
    assert {r["id"]: r["place_id"] for r in cluster.components(table, links, "id").collect()} == place and len(set(place.values())) > 5
    twins = {p[f"{x}_id"] for p in pairs for x, y in ("ab", "ba") if p[f"{x}_possible"] and p[f"{y}_strict"]}
    assert {r["id"] for r in cluster.strict_twins(table, "id", "name", "address").collect()} == twins and 0 < len(twins) < 100


def test_a_crowd_at_one_point_makes_one_link_each(spark):
    crowd = spark.range(100_000).selectExpr("id", "'cafe' AS name", "'1-2-3 east road' AS address", "35.0D AS lat", "139.0D AS lon", "id > 0 AS possible", "id = 0 AS strict")
    assert cluster.same_facility_links(crowd, "id", "name", "address").count() == 2 * 99_999
    assert cluster.strict_twins(crowd, "id", "name", "address").count() == 99_999


def test_latest_of_groups(spark):
    rows = [("v1", "c1", "2026-01-01"), ("v2", "c1", "2026-02-01"), ("v3", "c2", "2026-03-01"), ("v4", "c3", None), ("v5", "c4", "2026-01-01"), ("v6", "c2", None)]
    table = spark.createDataFrame(rows, "verification_id string, candidate_id string, verified_at string")
    groups = spark.createDataFrame([("c1", "g"), ("c2", "g"), ("c3", "h")], "candidate_id string, group_id string")
    found = {(r["group_id"], r["verification_id"]) for r in verify.latest_of_groups(table, groups).collect()}
    assert found == {("g", "v3"), ("h", "v4"), ("c4", "v5")}


def test_a_source_without_its_columns_is_refused(spark):
    shape = ingest.Shape("d", "public_toilet", ("lat", "lat2"), ("lon",), ("id",), ("name",))
    rows = spark.createDataFrame([("", "35", "139", "1", "n"), ("", " ", "139", "2", "n"), ("36", "35", "139", "", "n")], "lat string, lat2 string, lon string, id string, name string")
    found = [(r["record_id"], r["lat"], r["problem"], r["wheelchair"]) for r in ingest.normalised(rows, shape).orderBy("lat2", "record_id").collect()]
    assert found == [("d:2", None, "coordinate_blank", None), (None, 36.0, "id_or_name_blank", None), ("d:1", 35.0, None, None)]
    with pytest.raises(ValueError, match="lat2"):
        ingest.normalised(rows.drop("lat2"), shape)


def saved_set():
    """A saved set that breaks no rule."""
    place = lambda y, x: {"latitude": y, "longitude": x}
    route = {
        "name": "n", "provider": "openrouteservice", "isFallback": False, "distanceMeters": 900.5, "durationSeconds": 700, "durationMinutes": 12, "coordinates": [[35.6, 139.7], [35.605, 139.705], [35.61, 139.71]],
        "sourceAttribution": "by OpenStreetMap contributors", "generatedAt": "2026-01-02T03:04:05.000Z", "restSpotIds": [], "walkingSegments": [{"distanceMeters": 1}], "steepSlopeCount": 0, "indoorRestCount": 2, "warnings": [],
    }
    source = {
        "sourceType": "openstreetmap_route", "provider": "p", "snapshotMethod": "one_time_public_worker_response", "sourceUrl": "https://example.org/", "license": "ODbL", "attribution": "OpenStreetMap", "capturedAt": "2026-01-02T03:04:05.000Z",
        "usage": "u",
    }
    return {
        "schemaVersion": 1, "snapshotId": "s", "routeSetKind": "representative_dynamic_snapshot", "routingSchemaVersion": "1", "coordinateOrder": "latitude_longitude",
        "request": {"origin": place(35.6, 139.7), "destination": place(35.61, 139.71), "profiles": ["wheelchair_profile", "standard", "step_avoiding"]}, "source": source,
        "routes": [route | {"id": p, "profile": p} for p in ("standard", "step_avoiding", "wheelchair_profile")],
    }


def test_saved_sets_rule_by_rule(spark, tmp_path):
    """One rule is broken in each file; the sets' path tells which."""
    changes = {
        "fine": (lambda s: None, set()),
        "version": (lambda s: s.update(schemaVersion=2), {(None, "schemaVersion")}),
        "no_id": (lambda s: s.pop("snapshotId"), {(None, "snapshotId")}),
        "origin": (lambda s: s["request"]["origin"].update(latitude=95), {(None, "request.origin"), *[(p, "start") for p in readers.SAVED_PROFILES]}),
        "asked": (lambda s: s["request"].update(profiles=["standard", "standard", "step_avoiding"]), {(None, "request.profiles")}),
        "two": (lambda s: s["routes"].pop(), {(None, "routes.count"), (None, "routes.profiles")}),
        "none": (lambda s: s.pop("routes"), {(None, "routes"), (None, "routes.count"), (None, "routes.profiles"), (None, "routes.ids")}),
        "twice": (lambda s: s["routes"][1].update(id="standard"), {(None, "routes.ids"), ("standard", "id")}),
        "http": (lambda s: s["source"].update(sourceUrl="http://example.org/"), {(None, "source.sourceUrl")}),
        "licence": (lambda s: s["source"].update(license="MIT"), {(None, "source.license")}),
        "undated": (lambda s: s["source"].update(capturedAt="2026-02-30T03:04:05Z"), {(None, "source.capturedAt"), *[(p, "generatedAt.source") for p in readers.SAVED_PROFILES]}),
        "fallback": (lambda s: s["routes"][0].update(isFallback=True), {("standard", "isFallback")}),
        "zero": (lambda s: s["routes"][0].update(durationSeconds=0), {("standard", "durationSeconds")}),
        "unnamed": (lambda s: s["routes"][2].update(name=""), {("wheelchair_profile", "name")}),
        "one_point": (lambda s: s["routes"][0].update(coordinates=[[35.6, 139.7]]), {("standard", "coordinates.count"), ("standard", "end")}),
        "odd_point": (lambda s: s["routes"][0]["coordinates"].insert(1, [35.6]), {("standard", "coordinates")}),
        "far": (lambda s: s["routes"][1]["coordinates"].append([35.62, 139.71]), {("step_avoiding", "end")}),
        "uncredited": (lambda s: s["routes"][1].update(sourceAttribution="someone"), {("step_avoiding", "sourceAttribution")}),
        "later": (lambda s: s["routes"][1].update(generatedAt="2026-01-02T03:04:06Z"), {("step_avoiding", "generatedAt.source")}),
        "no_walks": (lambda s: s["routes"][1].update(walkingSegments=[]), {("step_avoiding", "walkingSegments")}),
        "half": (lambda s: s["routes"][1].update(steepSlopeCount=1.5), {("step_avoiding", "steepSlopeCount")}),
        "no_rests": (lambda s: s["routes"][1].pop("restSpotIds"), {("step_avoiding", "restSpotIds")}),
        "warning": (lambda s: s["routes"][1].update(warnings=[None]), {("step_avoiding", "warnings")}),
    }
    for name, (change, _) in changes.items():
        saved = json.loads(json.dumps(saved_set()))  # routes of their own
        change(saved)
        (tmp_path / f"{name}.json").write_text(json.dumps(saved, indent=1))
    found = {name: set() for name in changes}
    for r in readers.saved_set_problems(readers.saved_sets(spark, str(tmp_path))).collect():
        found[r["path"].rpartition("/")[2][:-5]].add((r["route_id"], r["problem"]))
    assert found == {name: want for name, (_, want) in changes.items()}


def test_visit_plans_with_wrong_counts_and_priorities(spark):
    rows = [*[(1, i, i) for i in range(1, 6)], *[(2, i, i) for i in range(1, 5)], *[(3, min(i, 4), i) for i in range(1, 6)], *[(4, i, i + 1) for i in range(1, 6)], *[(5, i, 1) for i in range(1, 6)], *[(6, i, None) for i in range(1, 6)]]
    found = candidates.visit_plan_problems(spark.createDataFrame(rows, "request_id long, facility_id long, visit_priority int")).collect()
    assert {(r["request_id"], r["problem"]) for r in found} == {(2, "count"), (3, "repeated_place"), (4, "priorities"), (5, "priorities"), (6, "priorities")}


def test_orders_of_templates_rejects_and_records(spark):
    own = verify.template(spark.createDataFrame([("c", "n", 35.0, 139.0, None, None), ("b", "m", 35.0, 139.0, "a", 2), ("a", "k", 35.0, 139.0, "a", 2)], "candidate_id string, name string, lat double, lon double, address string, priority int"))
    assert own.columns == ["priority", *verify.TEMPLATE_COLUMNS]
    assert [r["verificationId"] for r in own.orderBy(*verify.template_order()).collect()] == ["fv-a", "fv-b", "fv-c"]
    rejects = spark.createDataFrame([(2, "v", "b", ["x"]), (3, "v", "a", ["y", "z"]), (4, "v", "a", ["x"]), (5, None, "z", ["x"])], "row_number long, verification_id string, candidate_id string, reasons array<string>")
    assert [(r["candidate_id"], r["reasons"][0]) for r in rejects.orderBy(*verify.reject_order()).collect()] == [("z", "x"), ("a", "x"), ("a", "y"), ("b", "x")]
    records = spark.createDataFrame([(1, "b", "1", "n", 1.0, 1.0), (2, "a", None, "ｂ", 1.0, 1.0), (3, "a", None, "a", 1.0, 2.0), (4, "a", None, "ａ", 1.0, 1.0), (5, None, "9", "n", 1.0, 1.0)], "id int, dataset string, record_id string, name string, lat double, lon double")
    assert [r["id"] for r in records.orderBy(*ingest.record_order(text.nfkc(F.col("name")))).collect()] == [5, 4, 3, 2, 1]


def test_first_of_union_and_proximity_groups(spark):
    from strideway.operators import spatial

    rows = [(7, 1, 10, 1), (7, 1, 11, 2), (7, 2, 12, 1), (7, 2, 10, 2), (7, 2, 13, 3), (8, 3, 10, 1)]
    found = spatial.first_of_union(spark.createDataFrame(rows, "request_id int, route_id int, facility_id int, place int"), most=3).collect()
    assert {(r["request_id"], r["facility_id"], r["position"]) for r in found} == {(7, 10, 1), (7, 11, 2), (7, 12, 3), (8, 10, 1)}
    points = spark.createDataFrame([(i, 35.0 + i * 2e-4, 139.0) for i in range(5)] + [(9, 36.0, 139.0)], "id int, lat double, lon double")
    assert {(r["id"], r["place_id"]) for r in cluster.proximity_groups(points, "id").collect()} == {(i, 0) for i in range(5)}


def test_every_code_has_a_text(spark):
    assert set(labels.EXCLUSION_REASONS) == set(candidates.EXCLUSIONS) and set(labels.SELECTION_REASONS) == set(candidates.SELECTION_REASONS)
    assert set(labels.CATEGORIES) == set(labels.CATEGORY_CAUTIONS) == {p[0] for p in candidates.POLICIES}
    assert set(labels.CATEGORY_REASONS) == {*candidates.CATEGORY_REASONS.values(), candidates.BARRIER_FREE_LISTING}
    codes = spark.createDataFrame([("PUBLIC_SERVICE_NAME",), ("unknown",)], "c string")
    assert [r[0] for r in codes.select(labels.labelled(F.col("c"), labels.CATEGORY_REASONS)).collect()] == ["名称から区役所・出張所・観光案内等の一般利用目的を確認できる", "unknown"]
    assert labels.table(spark, labels.EXCLUSION_REASONS).count() == 6


def test_groups_are_found_among_coordinates_and_not_among_records(spark, monkeypatch):
    rows = [(i, "a", "b", 35.0 + i % 2 * 5e-5, 139.0) for i in range(200)] + [(500, "a", "b", 36.0, 139.0), (501, "a", "b", None, None)]
    table = spark.createDataFrame(rows, "id long, name string, address string, lat double, lon double")
    seen, own = [], cluster.components
    monkeypatch.setattr(cluster, "components", lambda nodes, edges, key: seen.append((nodes.count(), edges.distinct().count())) or own(nodes, edges, key))
    assert {(r["id"], r["place_id"]) for r in cluster.proximity_groups(table, "id").collect()} == {(i, 0) for i in range(200)}
    assert {(r["id"], r["place_id"]) for r in cluster.cluster_places(table, "id", "name", "address").collect()} == {(i, 0) for i in range(200)} | {(500, 500), (501, 501)}
    assert seen == [(3, 1), (3, 1)]


def test_components_of_a_wide_net_leave_little_to_the_next_round(spark, monkeypatch):
    n, rows, own = 40, {}, cluster.staged
    key = lambda y, x: (y * n + x) * 7919 % 1601
    links = [(key(y, x), key(y + dy, x + dx)) for y in range(n) for x in range(n) for dy, dx in ((0, 1), (1, 0)) if max(y + dy, x + dx) < n and not (x == 20 and dx)]

    def counted(df, name):
        out = own(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(cluster, "staged", counted)
    nodes = spark.createDataFrame([(key(y, x),) for y in range(n) for x in range(n)], "id long")
    found = dict(map(tuple, cluster.components(nodes, spark.createDataFrame(links, "a long, b long"), "id").collect()))
    halves = [[key(y, x) for y in range(n) for x in range(n) if (x <= 20) == left] for left in (True, False)]
    assert all({found[k] for k in half} == {min(half)} for half in halves)
    # each two rounds leave half of the keys at most, and so no round is as large as the first
    assert rows["edges"][-1] == 0 and all(b < a / 2 for a, b in zip(rows["edges"], rows["edges"][1:]))


def test_beginnings_that_no_text_equals_are_not_repeated(spark):
    """every beginning of each address was repeated for nine cells and shuffled."""
    rows = [(1, 35.6, 139.7, "", "park street 12", True, False), (2, 35.6, 139.7001, "", "park street", False, True), (3, 35.6, 139.7, "", "park street 1", False, True), (4, 35.6, 139.7, "", "park strasse", True, False)]
    own = spark.createDataFrame(rows, "id long, lat double, lon double, name string, address string, possible boolean, strict boolean")
    parts = own.select("id", F.explode(cluster.beginnings("address", 8)).alias("by"))
    kept = cluster.of_texts(parts, own.select("address"))
    assert parts.count() == 22 and kept.columns == ["id", "by"]
    assert sorted(map(tuple, kept.collect())) == [(1, "park street"), (1, "park street 1"), (1, "park street 12"), (2, "park street"), (3, "park street"), (3, "park street 1"), (4, "park strasse")]
    assert [r["id"] for r in cluster.strict_twins(own, "id", "name", "address").collect()] == [1]
    assert {(r["a"], r["b"]) for r in cluster.same_facility_links(own, "id", "name", "address").collect()} >= {(2, 1), (3, 1)}


def test_many_texts_keep_all_beginnings(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FEW_ROWS", 1)
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, by string")
    assert cluster.of_texts(parts, spark.createDataFrame([("a",), ("c",)], "text string")).count() == 2
