"""Files to records: places in files, malformed files, the catalogue, and field checks; expected values are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strideway.operators import normalise, ranks, verify
from strideway.sources import catalogue, numbered, readers
from strideway.sources.catalogue import SOURCES, WIDE_DOOR


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3), ("c", 1200)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = spark.read.text(str(tmp_path)).withColumn("file", F.regexp_extract("_metadata.file_path", "([a-z]).txt$", 1))
        kept = rows.where("value not like '%7'")
        assert kept.rdd.getNumPartitions() > 8
        found = numbered.numbered(rows.where("value not like '%7'"), "at", 2)
        place = {f: [] for f in "abc"}
        for r in found.collect():
            place[r["file"]].append((r["at"], r["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a", 5000), ("b", 3), ("c", 1200)):
        want = [f"{name}{i}" for i in range(n) if i % 10 != 7]
        assert sorted(place[name]) == list(enumerate(want, 2))


def test_positions_in_a_whole_table(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("y"))
    found = ranks.positions(rows.repartition(7), [F.col("y").desc_nulls_last(), F.col("x")], "at").collect()
    want = sorted(((r["y"], r["x"]) for r in rows.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["y"], r["x"]) for r in sorted(found, key=lambda r: r["at"])] == want and sorted(r["at"] for r in found) == list(range(1, 5001))
    assert ranks.positions(rows.where("x < 0"), [F.col("x")]).count() == 0


GOOD = {"crlf": "\ufeffa,b\r\n1,2\r\n\r\n\"x\r\ny\",\"say \"\"so\"\"\"\r\n3\r\n4,5,6\r\n", "plain": "a,b\n1,2\n"}


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16LE", "Shift_JIS"])
def test_malformed_files_raise_with_their_names(spark, tmp_path, encoding):
    code = encoding.lower().replace("shift_jis", "cp932")
    texts = {"open": 'a,b\n1,"2\n3,4\n', "blank": ",,\r\n\n", "none": "", **{k: v.replace("\ufeff", "" if encoding == "Shift_JIS" else "\ufeff") for k, v in GOOD.items()}}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(code))
    found = {r["file"].rsplit("/", 1)[1]: r["problem"] for r in readers.csv_problems(spark, str(tmp_path), encoding).collect()}
    assert found == {"open.csv": "unclosed_quote", "blank.csv": "empty", "none.csv": "empty"}
    for name in ("open", "blank", "none"):
        with pytest.raises(readers.MalformedFile, match=f"{name}.csv"):
            readers.read_csv(spark, readers.Dataset("d", str(tmp_path / f"{name}.csv"), encoding))
    rows = readers.read_csv(spark, readers.Dataset("d", str(tmp_path / "crlf.csv"), encoding), numbered=True)
    assert sorted((r["row_number"], r["a"], r["b"].replace("\r", "")) for r in rows.withColumn("a", F.regexp_replace("a", "\r", "")).collect()) == [(2, "1", "2"), (3, "x\ny", 'say "so"'), (4, "3", ""), (5, "4", "5")]


def test_every_source_has_a_normaliser_and_its_own_key():
    assert len({s.key for s in SOURCES}) == len(SOURCES) == 12
    assert {s.normaliser for s in SOURCES} == set(normalise.NORMALISERS) and [s.encoding for s in SOURCES].count("UTF-16LE") == 2
    assert catalogue.SOURCES[-1].resource.endswith("130001_Daredemo_Tokyo_public_facilities.csv") and SOURCES[-1].credit.endswith("（公共施設）」（CC BY）")


FILES = {
    "shinjuku-public": """ID,名称,所在地_連結表記,緯度,経度,車椅子使用者用トイレ有無,利用開始時間,利用終了時間,利用可能時間特記事項
001,"公園, 東側",新宿区西新宿1,35.6908,139.6994,有,0700,2200,夜間は閉鎖
002,座標なし,新宿区西新宿2,,139.69,,,,
003,不正座標,新宿区西新宿3,abc,139.69,無,,,
004,情報不明,,35.6895,139.6917,,,,無視される
,番号なし,,35.6,139.6,,,,
005,海の上,,51.0,139.6,,,,
""",
    "tokyo-public-accessible": f"""管理者種別番号,部局番号,施設種別番号,施設通し番号,施設内トイレ通し番号,施設名,トイレ名,設置フロア,都道府県,市区町村・番地,ビル建物名,経度,緯度,{WIDE_DOOR},月曜日,火曜日,その他,データの変更年月,データの作成年月
1,2,,3,4,庁舎,東,1F,東京都,新宿区1,本館,139.7,35.7,○,9-17,9-17,休日は10-16,,202403
1,2,3,4,5,,東,1F,,,,139.7,35.7,×,,,,202401,
""",
    "tokyo-station-accessible": f"""管理者種別番号,鉄道駅通し番号,鉄道駅内トイレ通し番号,鉄道会社名,鉄道駅名,市区町村・番地,経度,緯度,{WIDE_DOOR},データの変更年月
7,8,9,都営,,新宿区2,139.71,35.71,×,20241
""",
    "tokyo-drinking-stations": """緯度,経度,施設名称,所在地,水飲み栓設置場所,入場料等,タイプ
35.69,139.69,給水所,新宿区西新宿,1階,,飲み口型
12,99.5,,,1階,,飲み口型
""",
    "shinjuku-public-facilities": "ID,名称,所在地_連結表記,緯度,経度\n1,公共施設,新宿区西新宿,35.69,139.69\n2,,,35.69,139.69\n",
    "daredemo-parks": "施設名,都道府県名,市区町村名,町丁目名,全国地方公共団体コード,緯度,緯度_加工,経度,経度_加工,車いすの貸出の可否,対応可能日時（曜日や時間帯等）\n広場,東京都,新宿区,西新宿,131041,,35.69,,139.69,有,毎日\n,,,,,35,,139,,○,\n",
}
GIVEN = tuple(s for s in SOURCES if s.key in FILES)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    own = tmp_path_factory.mktemp("sources")
    for s in GIVEN:
        (own / f"{s.key}.csv").write_bytes(FILES[s.key].encode({"UTF-16LE": "utf-16-le", "Shift_JIS": "cp932"}.get(s.encoding, "utf-8")))
    return own


def test_the_catalogue_makes_records_rejects_and_a_manifest(spark, folder, tmp_path):
    got = normalise.run(spark, str(folder), "2026-07-01T00:00:00Z", sources=GIVEN)
    records = {r["record_id"]: r for r in got.records.collect()}
    assert set(records) == {"shinjuku-001", "shinjuku-004", "tokyo-public-1-2-0-3-4", "tokyo-station-7-8-9", "tokyo-drinking-stations-給水所-新宿区西新宿-3569-13969", "tokyo-drinking-stations-0-0-12-995", "shinjuku-facility-1", "daredemo-parks-広場-131041-3569-13969"}
    first, unknown, hall, station = (records[k] for k in ("shinjuku-001", "shinjuku-004", "tokyo-public-1-2-0-3-4", "tokyo-station-7-8-9"))
    assert (first["name"], first["opening_hours"], first["wheelchair"], first["kind"], first["row_number"]) == ("公園, 東側", "0700〜2200（夜間は閉鎖）", True, "public_toilet", 2)
    assert (unknown["address"], unknown["opening_hours"], unknown["wheelchair"], unknown["confidence"], unknown["row_number"]) == (None, None, None, "official", 5)
    assert (hall["name"], hall["address"], hall["opening_hours"], hall["updated"]) == ("庁舎 東（1F）", "東京都新宿区1本館", "9-17 / 休日は10-16", "2024-03")
    assert (station["name"], station["wheelchair"], station["updated"], station["toilet"]) == ("都営 鉄道駅", False, None, True)
    well, park = records["tokyo-drinking-stations-0-0-12-995"], records["daredemo-parks-広場-131041-3569-13969"]
    assert (well["name"], well["lat"], well["water"], well["updated"], well["toilet"]) == ("名称不明の給水地点", 12.0, True, "2025-09-16", None)
    assert (park["address"], park["wheelchair"], park["opening_hours"], park["lat"], park["updated"]) == ("東京都新宿区西新宿", True, "毎日", 35.69, "2025-05-26")
    rejects = {(r["dataset"], r["row_number"]): r["problem"] for r in got.rejects.collect()}
    city = [("coordinate_blank", 3), ("coordinate_not_numeric", 4), ("id_or_name_blank", 6), ("coordinate_out_of_area", 7)]
    assert rejects == {("shinjuku-public", n): p for p, n in city} | {("tokyo-public-accessible", 3): "name_blank", ("shinjuku-public-facilities", 3): "id_or_name_blank", ("daredemo-parks", 3): "name_blank"}
    manifest = {r["dataset"]: r for r in got.manifest.collect()}
    assert {k: (r["n_records"], r["n_rejected"]) for k, r in manifest.items()} == {"shinjuku-public": (2, 4), "tokyo-public-accessible": (1, 1), "tokyo-station-accessible": (1, 0), "tokyo-drinking-stations": (2, 0), "shinjuku-public-facilities": (1, 1), "daredemo-parks": (1, 1)}
    assert manifest["shinjuku-public"]["byte_size"] == len(FILES["shinjuku-public"].encode("utf-16-le")) and manifest["daredemo-parks"]["attribution"].endswith("（公園）」（CC BY）")
    # the same files later: the time of retrieval stays, and nothing is written again
    out = str(tmp_path / "out")
    assert set(got.publish(out, "one")) == {"records", "rejects", "reasons", "manifest"}
    again = normalise.run(spark, str(folder), "2026-08-01T00:00:00Z", got.manifest, GIVEN)
    assert again.publish(out, "two") == [] and {r["retrieved_at"] for r in again.manifest.collect()} == {"2026-07-01T00:00:00Z"}


def test_a_source_that_cannot_be_read_stops_the_run(spark, folder, tmp_path):
    for s in GIVEN:
        (tmp_path / f"{s.key}.csv").write_bytes((folder / f"{s.key}.csv").read_bytes())
    broken = tmp_path / "daredemo-parks.csv"
    broken.write_bytes("施設名,市区町村名,町丁目名\n広場,新宿区,\"西新宿\n".encode("cp932"))
    with pytest.raises(readers.MalformedFile, match="daredemo-parks"):
        normalise.run(spark, str(tmp_path), "t", sources=GIVEN)
    broken.write_bytes("施設名,市区町村名\n広場,新宿区\n".encode("cp932"))
    with pytest.raises(readers.MissingHeaders, match="町丁目名"):
        normalise.run(spark, str(tmp_path), "t", sources=GIVEN)
    broken.write_bytes("施設名,市区町村名,町丁目名\n広場,新宿区,西新宿\n".encode("cp932"))
    with pytest.raises(ValueError, match="without records"):
        normalise.run(spark, str(tmp_path), "t", sources=GIVEN).publish(str(tmp_path / "out"), "one")


def test_first_of_same_rest_points(spark):
    rows = [("b", "water", "ＡＢ", 35.0, 139.0), ("a", "water", "AB", 35.0000001, 139.0), ("c", "park", "AB", 35.0, 139.0), ("d", "water", "ab", 35.0, 139.0)]
    table = spark.createDataFrame(rows, "record_id string, category string, name string, lat double, lon double")
    assert {r["record_id"] for r in normalise.first_of_same(table).collect()} == {"a", "c", "d"}


CHECKS = """verificationId,candidateId,name,latitude,longitude,address,verifiedAt,verifier,verificationMethod,publiclyAccessible,seatingAvailable,indoorOrCovered,drinkingWaterAvailable,toiletAvailable,wheelchairAccessible,openingHoursObserved,accessRestrictions,evidenceReference,notes
v-1,a,一,35.69,139.69,新宿区,2026-07-19T10:00:00+09:00,team,on_site_observation,true,true,false,null,true,true,09:00-17:00,,https://example.com/a,現地
v-2,b,二,35.691,139.691,新宿区,2026-07-19T11:00:00+09:00,team,combined_on_site_and_official,true,null,true,null,null,true,,,urn:mine:b,
v-3,c,三,35.692,139.692,新宿区,2026-07-19T12:00:00+09:00,team,official_source_review,null,null,null,null,null,null,,,https://example.com/c,
v-4,a,四,35.692,139.692,,2026-07-19T12:00:00+09:00,team,combined_on_site_and_official,true,true,,,,,,,null,
v-5,a,五,35.692,139.692,,2026-07-19T12:00:00+09:00,team,combined_on_site_and_official,true,false,,,,,,,https://example.com/c,
v-6,a,六,35.692,139.692,,null,null,null,null,null,,,,,,,null,
v-7,a,七,35.692,139.692,,2026-07-19T12:00+09:00,team,on_site_visit,TRUE,NULL,yes,,,,,,urn:other:x,

v-8,z,,0,139.692,,2026-02-31T10:00:00+09:00,team,staff_confirmation,true,true,,,,,,,http://example.com/,
v-8,a,八,35,139.692,,,,,,,,,,,,,,
"""


def test_a_form_of_field_checks_is_judged_row_by_row(spark, tmp_path):
    (tmp_path / "checks.csv").write_text(CHECKS)
    rows = verify.from_form(readers.read_csv(spark, readers.Dataset("checks", str(tmp_path / "checks.csv"), required=verify.TEMPLATE_COLUMNS), numbered=True))
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string")
    checked = verify.validate(rows, known, "urn:mine:")
    levels = {r["verification_id"]: r["level"] for r in verify.typed(checked.where(F.size("reasons") == 0)).collect()}
    assert levels == {"v-1": "confirmed", "v-2": "supported", "v-3": "possible", "v-4": "confirmed", "v-5": "possible", "v-6": "possible"}
    found = [(r["row_number"], r["verification_id"], r["reasons"]) for r in verify.rejects(checked).orderBy(*verify.reject_order()).collect()]
    assert found == [
        (8, "v-7", ["indoorOrCovered:invalid_tristate_boolean", "invalid_evidence_reference", "invalid_verification_method", "invalid_verified_at", "publiclyAccessible:invalid_tristate_boolean", "seatingAvailable:invalid_tristate_boolean"]),
        (10, "v-8", ["duplicate_verification_id"]),
        (9, "v-8", ["duplicate_verification_id", "invalid_evidence_reference", "invalid_latitude", "invalid_verified_at", "missing_name", "unknown_candidate_id"]),
    ]


def test_points_of_geojson_files(spark, tmp_path):
    """Axes are swapped, properties stay text, and a file without features has no rows."""
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[139.7,35.6]},"properties":{"name":"水","public":true,"n":3,"none":null}}'
    (tmp_path / "a.geojson").write_text(f'{{"type":"FeatureCollection",\n"features":[{point},\n{point.replace("35.6", "35.7")}]}}')
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    found = readers.geojson_points(spark, str(tmp_path)).orderBy("lat").collect()
    assert [(r["lat"], r["lon"]) for r in found] == [(35.6, 139.7), (35.7, 139.7)]
    assert found[0]["properties"] == {"name": "水", "public": "true", "n": "3", "none": None}
