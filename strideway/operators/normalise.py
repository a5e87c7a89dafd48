"""Five kinds of source columns as records of one shape, and the whole way from files to tables that can be published."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.text import compact_id, hours_between, mark, nfkc, nullable, number, opening_hours, trimmed, year_month
from strideway.operators import ingest
from strideway.sources import readers, writers
from strideway.sources.catalogue import SOURCES, WIDE_DOOR, Source
from strideway.sources.staging import staged

#: Headings of weekdays, names for places without one, and when sources without a date of their own were updated.
DAYS = ("月曜日", "火曜日", "水曜日", "木曜日", "金曜日", "土曜日", "日曜日", "祝日", "その他")
NAMELESS_WATER, NAMELESS_STATION, UPDATED = "名称不明の給水地点", "鉄道駅", "2025-05-26"
COLUMNS = ("record_id", "name", "lat", "lon", "address", "category", "kind", "wheelchair", "toilet", "water", "opening_hours", "confidence", "updated", "dataset", "row_number", "problem")


class Cells:
    """The cells of a source's rows by heading: trimmed text, empty where blank or where the source has no such column."""

    def __init__(self, rows: DataFrame):
        self.known = set(rows.columns)

    def __call__(self, heading: str) -> Column:
        return F.coalesce(trimmed(F.col(f"`{heading}`")), F.lit("")) if heading in self.known else F.lit("")

    def first(self, *headings: str) -> Column:
        """The first cell that isn't blank, else null."""
        return F.coalesce(*[F.nullif(self(h), F.lit("")) for h in headings if h in self.known] or [F.lit(None).cast("string")])

    def joined(self, *headings: str) -> Column:
        return nullable(F.concat(*[self(h) for h in headings]))


@dataclass
class Fields:
    """What one kind of source says of a record; what it doesn't say is unknown."""

    record_id: Column
    name: Column
    address: Column
    category: str
    #: Cells without which a row is no record, and the reason then.
    needed: tuple[Column, ...] = ()
    reason: str = "id_or_name_blank"
    kind: str | None = None
    wheelchair: Column | None = None
    water: bool | None = None
    hours: Column | None = None
    updated: Column | None = None


def digits(c: Column) -> Column:
    """A number as a record id writes it: whole numbers without a point."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def city_toilet(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    hours = hours_between(c("利用開始時間"), c("利用終了時間"), c("利用可能時間特記事項"))
    return Fields(F.concat(F.lit("shinjuku-"), c("ID")), c("名称"), c.joined("所在地_連結表記"), "toilet", (c("ID"), c("名称")), kind="public_toilet", wheelchair=mark(c("車椅子使用者用トイレ有無")), hours=hours)


def accessible_toilet(c: Cells, record_id: Column, facility: Column, kind: str) -> Fields:
    name = F.concat(facility, F.when(c("トイレ名") != "", F.concat(F.lit(" "), c("トイレ名"))).otherwise(""), F.when(c("設置フロア") != "", F.concat(F.lit("（"), c("設置フロア"), F.lit("）"))).otherwise(""))
    updated = year_month(c.first("データの変更年月", "データの作成年月"))
    return Fields(record_id, name, c.joined("都道府県", "市区町村・番地", "ビル建物名"), "toilet", (facility,), "name_blank", kind, mark(c(WIDE_DOOR)), hours=opening_hours(*map(c, DAYS)), updated=updated)


def facility_toilet(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    record_id = compact_id(F.lit("tokyo-public"), *map(c, ("管理者種別番号", "部局番号", "施設種別番号", "施設通し番号", "施設内トイレ通し番号")))
    return accessible_toilet(c, record_id, c("施設名"), "facility_toilet_information")


def station_toilet(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    record_id = compact_id(F.lit("tokyo-station"), *map(c, ("管理者種別番号", "鉄道駅通し番号", "鉄道駅内トイレ通し番号")))
    station = trimmed(F.concat(c("鉄道会社名"), F.lit(" "), F.coalesce(c.first("鉄道駅名"), F.lit(NAMELESS_STATION))))
    return accessible_toilet(c, record_id, station, "station_toilet_information")


def water(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    record_id = compact_id(F.lit(source.key), c("施設名称"), c("所在地"), digits(lat), digits(lon))
    return Fields(record_id, F.coalesce(c.first("施設名称"), F.lit(NAMELESS_WATER)), c.joined("所在地"), "drinking_station", water=True)


def city_facility(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    return Fields(F.concat(F.lit("shinjuku-facility-"), c("ID")), c("名称"), c.joined("所在地_連結表記"), "public_facility", (c("ID"), c("名称")))


def barrier_free(c: Cells, source: Source, lat: Column, lon: Column) -> Fields:
    record_id = compact_id(F.lit(source.key), c("施設名"), c("全国地方公共団体コード"), digits(lat), digits(lon))
    lent = c("車いすの貸出の可否")
    wheelchair = F.when(lent == "有", True).when(lent == "無", False)
    return Fields(record_id, c("施設名"), c.joined("都道府県名", "市区町村名", "町丁目名"), "barrier_free_facility", (c("施設名"),), "name_blank", wheelchair=wheelchair, hours=nullable(c("対応可能日時（曜日や時間帯等）")))


NORMALISERS = {f.__name__: f for f in (city_toilet, facility_toilet, station_toilet, water, city_facility, barrier_free)}


def normalised(rows: DataFrame, source: Source) -> DataFrame:
    """A source's rows (text cells under its own headings, row_number if there is one) as COLUMNS; problem says why a row is no record.

    Coordinates come first: blank, no number, and for toilets outside the country's area; then what the normaliser needs. Rest points take
    the corrected coordinates where the plain ones are blank. A heading that is required and not there raises MissingHeaders.
    """
    if missing := [h for h in source.required if h not in rows.columns]:
        raise readers.MissingHeaders(f"{source.key}: {', '.join(missing)}")
    c, toilet = Cells(rows), source.kind == "toilet"
    y, x = (c(h) if toilet else F.coalesce(c.first(h, f"{h}_加工"), F.lit("")) for h in ("緯度", "経度"))
    lat, lon = number(y), number(x)
    f = NORMALISERS[source.normaliser](c, source, lat, lon)
    problem = F.when((y == "") | (x == ""), "coordinate_blank").when(lat.isNull() | lon.isNull(), "coordinate_not_numeric")
    if toilet:
        problem = problem.when(~(lat.between(ingest.SOUTH, ingest.NORTH) & lon.between(ingest.WEST, ingest.EAST)), "coordinate_out_of_area")
    if f.needed:
        problem = problem.when(functools.reduce(Column.__or__, [n == "" for n in f.needed]), f.reason)
    known = lambda v, kind: F.lit(None).cast(kind) if v is None else v
    out = {
        "record_id": f.record_id, "name": f.name, "lat": lat, "lon": lon, "address": f.address, "category": F.lit(f.category), "kind": known(f.kind and F.lit(f.kind), "string"),
        "wheelchair": known(f.wheelchair, "boolean"), "toilet": F.lit(True) if toilet else F.lit(None).cast("boolean"), "water": F.lit(f.water).cast("boolean"), "opening_hours": known(f.hours, "string"),
        "confidence": F.lit("official" if toilet else "possible"), "updated": known(f.updated, "string") if toilet else F.lit(source.updated or UPDATED),
        "dataset": F.lit(source.key), "row_number": F.col("row_number") if "row_number" in rows.columns else F.lit(None).cast("long"), "problem": problem,
    }
    return rows.select(*[v.alias(k) for k, v in out.items()])


def all_normalised(tables: dict[str, DataFrame], sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """The rows of all sources in one table; each is read once, in its own plan."""
    return functools.reduce(DataFrame.unionByName, [normalised(tables[s.key], s) for s in sources])


def first_of_same(records: DataFrame) -> DataFrame:
    """Rest points without those of one category, name (after NFKC) and coordinate (6 places); the smallest record_id stays."""
    key = [F.col("category"), nfkc(F.col("name")), *[F.floor(F.col(c) * 1e6 + 0.5) for c in ("lat", "lon")]]
    return records.groupBy(*[k.alias(f"_{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*records.columns), "record_id").alias("r")).select("r.*")


@dataclass
class Ingested:
    """Records by source, every row that is none with its reason and place, reasons counted, and a manifest row for each dataset."""

    records: DataFrame
    rejects: DataFrame
    reasons: DataFrame
    manifest: DataFrame

    def publish(self, folder: str, run: str) -> list[str]:
        """Write all four tables or nothing: a dataset without a single record stops the publication."""
        tables = {"records": self.records, "rejects": self.rejects, "reasons": self.reasons, "manifest": self.manifest}
        return writers.publish(tables, folder, run, {"datasets without records": self.manifest.where("n_records = 0")})


def dataset_table(spark: SparkSession, sources: tuple[Source, ...]) -> DataFrame:
    rows = [(s.key, s.page, s.resource, s.updated, s.encoding, s.licence, s.provider, s.name, "official_open_data", s.credit) for s in sources]
    return spark.createDataFrame(rows, "dataset string, page string, resource string, source_updated string, encoding string, licence string, provider string, dataset_name string, source_type string, attribution string")


def run(spark: SparkSession, folder: str, retrieved_at: str, previous: DataFrame | None = None, sources: tuple[Source, ...] = SOURCES) -> Ingested:
    """All files of a catalogue, `<folder>/<key>.csv`, to records, rejects, reasons and manifest.

    A file that is empty, has an unclosed quote or lacks a required heading raises, with its name. previous: the manifest before, whose
    time of retrieval stays where a file's content is the same.
    """
    tables = {s.key: readers.read_csv(spark, readers.Dataset(s.key, f"{folder}/{s.key}.csv", s.encoding, s.required), numbered=True) for s in sources}
    rows = staged(all_normalised(tables, sources), "normalised")
    records = rows.where("problem is null").drop("problem")
    files = readers.snapshots(spark, [f"{folder}/{s.key}.csv" for s in sources]).withColumn("dataset", F.regexp_extract("path", r"([^/]+)\.csv$", 1)).drop("path")
    manifest = ingest.manifest(rows, files, dataset_table(spark, sources), previous, F.lit(retrieved_at))
    return Ingested(records, rows.where("problem is not null").select("dataset", "row_number", "record_id", "name", "problem"), ingest.reject_counts(rows), manifest)
