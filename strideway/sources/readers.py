"""Sources: encoded CSV files, binary snapshots, JSON routes, routing responses and GeoJSON points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.text import trimmed
from strideway.sources import numbered as row_numbers

POINT = "struct<lat:double,lon:double>"
ROUTES = "routes array<struct<id:string,name:string,profile:string,coordinates:array<array<double>>,distanceMeters:double,durationSeconds:double,steepSlopeCount:int>>, generatedAt string"
RESPONSE = "struct<features:array<struct<geometry:struct<coordinates:array<array<double>>>,properties:struct<summary:struct<distance:double,duration:double>,segments:array<struct<steps:array<struct<distance:double,duration:double,instruction:string>>>>,extras:struct<steepness:struct<values:array<array<int>>>>>>>>"
FEATURES = "features array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"
STEEP = 4


@dataclass(frozen=True)
class Dataset:
    """One source file: where it is, how it is encoded, and the headers without which it isn't read."""

    key: str
    path: str
    encoding: str = "UTF-8"
    required: tuple[str, ...] = ()
    kind: str = "toilet"
    provider: str = ""
    licence: str = ""


class MissingHeaders(ValueError):
    pass


class MalformedFile(ValueError):
    """A file whose last quote isn't closed, or that has nothing but separators."""


#: Encodings in which no part of another character has the byte of a quote, so that lines of bytes can be counted.
BYTEWISE = ("UTF_8", "US_ASCII", "ISO_8859_1", "SHIFT_JIS", "SJIS", "EUC_JP", "WINDOWS_31J")
SEPARATORS = ',\r\n"'


def plain_name(encoding: str) -> str:
    return encoding.upper().replace("-", "_")


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Shift_JIS is one of the charsets that Spark takes only with spark.sql.legacy.javaCharsets, which then stays set in the session."""
    if plain_name(encoding) in ("SHIFT_JIS", "SJIS", "EUC_JP", "WINDOWS_31J"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def csv_problems(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file and problem of CSV files that can't be read: `unclosed_quote`, or `empty`.

    A quote opens and closes wherever it stands, and a doubled one changes nothing, so quotes are closed where their number is even.
    Empty is a file of nothing but separators, quotes and line ends. Files whose encoding keeps ASCII bytes apart are counted line by line
    by many tasks; others, as UTF-16, are decoded whole.
    """
    allow_charset(spark, encoding)
    # the driver's own list of the files, as scans leave out those without a byte
    every = spark.createDataFrame([(f,) for f in spark.read.format("binaryFile").load(path).inputFiles()], "file string")
    if plain_name(encoding) in BYTEWISE:
        lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    else:
        lines = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("text"))
    quotes = F.octet_length("text") - F.octet_length(F.replace("text", F.lit('"'), F.lit("")))
    filled = F.translate("text", SEPARATORS + "\ufeff", "") != ""
    # paths of the two readers differ in how they write the scheme's slashes
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    counted = lines.groupBy(place("file").alias("_place")).agg(F.sum(quotes).alias("quotes"), F.bool_or(filled).alias("filled"))
    met = every.withColumn("_place", place("file")).join(counted.hint("merge"), "_place", "left")
    problem = F.when(F.col("quotes") % 2 == 1, "unclosed_quote").when(~F.coalesce("filled", F.lit(False)), "empty")
    return met.select("file", problem.alias("problem")).where("problem is not null")


def read_csv(spark: SparkSession, dataset: Dataset, numbered: bool = False) -> DataFrame:
    """All fields as trimmed text (missing ones empty), rows that aren't blank, and dataset; extra columns are kept.

    numbered adds row_number, a record's place in its file: 2 for the first after the heading, blank rows not counted. Cells beyond the
    headings are dropped. A file with an unclosed quote, or an empty one, raises MalformedFile with its name; required headings that are
    missing raise MissingHeaders. Quoted cells may hold line ends, so a file is read by one task.
    """
    allow_charset(spark, dataset.encoding)
    if bad := csv_problems(spark, dataset.path, dataset.encoding).limit(20).collect():
        raise MalformedFile(f"{dataset.key}: " + ", ".join(f"{r['file']} ({r['problem']})" for r in bad))
    rows = spark.read.csv(dataset.path, header=True, multiLine=True, quote='"', escape='"', encoding=dataset.encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="\u0000")
    names = [c.lstrip("\ufeff").strip() for c in rows.columns]
    if missing := [h for h in dataset.required if h not in names]:
        raise MissingHeaders(f"{dataset.key}: {', '.join(missing)}")
    cells = {n: F.coalesce(trimmed(F.col(f"`{c}`")), F.lit("")) for c, n in zip(rows.columns, names, strict=True)}
    filled = rows.where(F.concat(*cells.values()) != "")
    if numbered:
        placed = row_numbers.numbered(row_numbers.located(filled).select(*[v.alias(n) for n, v in cells.items()], "_file", "_part", "_id"), first=2)
        return placed.select(*[F.col(f"`{n}`") for n in cells], "row_number").withColumn("dataset", F.lit(dataset.key))
    return filled.select(*[v.alias(n) for n, v in cells.items()]).withColumn("dataset", F.lit(dataset.key))


def snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as they are: path, bytes and SHA-256 of the content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))


def route_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Saved routes with their vertices, a row for each route."""
    own = spark.read.schema(ROUTES).json(path, multiLine=True).select("generatedAt", F.explode("routes").alias("r"))
    points = F.transform("r.coordinates", lambda c: F.struct(c[0].alias("lat"), c[1].alias("lon")))
    return own.select("r.id", "r.name", "r.profile", points.alias("points"), F.col("r.distanceMeters").alias("stated_m"), F.col("r.durationSeconds").alias("seconds"), F.col("r.steepSlopeCount").alias("steep_count"), F.col("generatedAt").alias("generated_at"))


def vertices(routes: DataFrame, key: str = "id") -> DataFrame:
    return routes.select(F.col(key).alias("route_id"), F.posexplode("points").alias("seq", "p")).select("route_id", "seq", "p.lat", "p.lon")


def routing_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """A routing service's stored answers as routes: axes swapped, steps in one list, steep stretches counted.

    Stated metres are rounded to whole ones. valid is false where there is no vertex, or length or time are missing or no finite numbers; such
    rows keep their other columns.
    """
    f = F.try_element_at(F.from_json(body, RESPONSE).getField("features"), F.lit(1))
    steep = F.filter(f["properties"]["extras"]["steepness"]["values"], lambda v: F.abs(v[2]) >= STEEP)
    seconds = f["properties"]["summary"]["duration"]
    points = F.transform(f["geometry"]["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon")))
    out = responses.withColumns(
        {
            "points": points,
            "stated_m": F.floor(f["properties"]["summary"]["distance"] + 0.5).cast("double"),
            "seconds": seconds,
            "minutes": F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5).cast("int")),
            "steps": F.flatten(F.transform(f["properties"]["segments"], lambda s: s["steps"])),
            "steep_count": F.coalesce(F.size(steep), F.lit(0)),
        }
    )
    ok = (F.size("points") >= 1) & F.col("stated_m").isNotNull() & F.col("seconds").isNotNull()
    return out.withColumn("minutes", F.when(F.col("seconds").isNotNull(), F.col("minutes"))).withColumn("valid", F.coalesce(ok, F.lit(False))).drop(body)


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return own.select(F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.properties").alias("properties"))


def snapshot_problems(routes: DataFrame, request: DataFrame, profiles: tuple[str, ...], metres: float = 50.0) -> DataFrame:
    """Rules that a saved set of routes breaks, a row for each (route_id null for those of the set).

    request: one row with from_lat, from_lon, to_lat, to_lon.
    """
    from strideway.functions.geo import haversine

    r = routes.crossJoin(F.broadcast(request))  # one row
    first, last = F.try_element_at("points", F.lit(1)), F.try_element_at("points", F.lit(-1))
    finite = F.forall("points", lambda p: p.lat.isNotNull() & p.lon.isNotNull() & ~F.isnan(p.lat) & ~F.isnan(p.lon))
    rules = {
        "duplicate_id": F.col("_n") > 1,
        "missing_id": F.col("id").isNull() | (F.trim("id") == ""),
        "too_few_vertices": F.coalesce(F.size("points") < 2, F.lit(True)),
        "vertex_not_finite": ~F.coalesce(finite, F.lit(False)),
        "start_elsewhere": haversine(first.lat, first.lon, F.col("from_lat"), F.col("from_lon")) > metres,
        "end_elsewhere": haversine(last.lat, last.lon, F.col("to_lat"), F.col("to_lon")) > metres,
        "distance_not_positive": ~F.coalesce(F.col("stated_m") > 0, F.lit(False)),
        "duration_not_positive": ~F.coalesce(F.col("seconds") > 0, F.lit(False)),
    }
    from pyspark.sql import Window

    r = r.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    found = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull()))
    own = r.select(F.col("id").alias("route_id"), found.alias("problem"))
    want = F.array(*[F.lit(p) for p in sorted(profiles)])
    whole = routes.agg(F.array_sort(F.collect_list("profile")).alias("p"), F.count_distinct("generated_at").alias("t"))
    of_set = F.explode(F.filter(F.array(F.when(F.col("p") != want, "profiles"), F.when(F.col("t") > 1, "generated_at")), lambda x: x.isNotNull()))
    return own.unionByName(whole.select(F.lit(None).cast("string").alias("route_id"), of_set.alias("problem")))


PLACE = "struct<latitude:double,longitude:double>"
SAVED = f"""schemaVersion int, snapshotId string, routeSetKind string, routingSchemaVersion string, coordinateOrder string, request struct<origin:{PLACE},destination:{PLACE},profiles:array<string>>,
source struct<sourceType:string,provider:string,snapshotMethod:string,sourceUrl:string,license:string,attribution:string,capturedAt:string,usage:string>,
routes array<struct<id:string,profile:string,name:string,provider:string,isFallback:boolean,distanceMeters:double,durationSeconds:double,durationMinutes:double,coordinates:array<array<double>>,sourceAttribution:string,generatedAt:string,
restSpotIds:array<string>,walkingSegments:array<string>,steepSlopeCount:double,indoorRestCount:double,warnings:array<string>>>"""
#: The profiles of a saved set, and what it must say of itself.
SAVED_PROFILES = ("standard", "step_avoiding", "wheelchair_profile")
SAVED_VALUES = {
    "schemaVersion": 1,
    "routeSetKind": "representative_dynamic_snapshot",
    "routingSchemaVersion": "1",
    "coordinateOrder": "latitude_longitude",
    "source.sourceType": "openstreetmap_route",
    "source.snapshotMethod": "one_time_public_worker_response",
    "source.license": "ODbL",
}
ROUTE_PROVIDER, MAP_CREDIT = "openrouteservice", "OpenStreetMap"


def saved_sets(spark: SparkSession, path: str) -> DataFrame:
    """Saved sets of routes as they are, a row for each file; values of a wrong type are null."""
    return spark.read.schema(SAVED).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))


def saved_set_problems(sets: DataFrame, key: str = "path", metres: float = 50.0) -> DataFrame:
    """Every rule that a saved set breaks: key, route_id (null for rules of the set) and the rule's name.

    A value that is missing breaks its rule. Rules of routes are judged for each route by itself.
    """
    from strideway.functions.geo import haversine
    from strideway.functions.text import instant

    there = lambda c: F.length(c) > 0
    on_earth = lambda lat, lon: lat.between(-90, 90) & lon.between(-180, 180)
    dated = lambda c: instant(c).isNotNull() & c.rlike(r"T\d{2}:\d{2}:\d{2}")
    want = F.array(*map(F.lit, sorted(SAVED_PROFILES)))
    each = lambda c: F.array_sort(c) == want
    whole = lambda c: (c >= 0) & (c == F.floor(c))

    def broken(rules: dict) -> F.Column:
        return F.explode(F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]), lambda x: x.isNotNull()))

    ids = F.transform("routes", lambda r: r["id"])
    of_set = {name: F.col(name) == value for name, value in SAVED_VALUES.items()} | {
        "snapshotId": there(F.col("snapshotId")),
        "request.origin": on_earth(F.col("request.origin.latitude"), F.col("request.origin.longitude")),
        "request.destination": on_earth(F.col("request.destination.latitude"), F.col("request.destination.longitude")),
        "request.profiles": each(F.col("request.profiles")),
        "routes": F.col("routes").isNotNull() & F.forall("routes", lambda r: r.isNotNull()),
        "routes.count": F.size("routes") == len(SAVED_PROFILES),
        "routes.profiles": each(F.transform("routes", lambda r: r["profile"])),
        "routes.ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "source.provider": there(F.col("source.provider")),
        "source.sourceUrl": F.col("source.sourceUrl").startswith("https://"),
        "source.attribution": F.contains(F.col("source.attribution"), F.lit(MAP_CREDIT)),
        "source.capturedAt": dated(F.col("source.capturedAt")),
        "source.usage": there(F.col("source.usage")),
    }
    r, points = (lambda name: F.col(f"r.{name}")), F.col("r.coordinates")
    end = lambda n, place: haversine(*[F.get(F.try_element_at(points, F.lit(n)), F.lit(i)) for i in (0, 1)], F.col(f"request.{place}.latitude"), F.col(f"request.{place}.longitude")) <= metres
    of_route = {
        "id": r("id") == r("profile"),
        "profile": r("profile").isin(*SAVED_PROFILES),
        "provider": r("provider") == ROUTE_PROVIDER,
        "isFallback": ~r("isFallback"),
        **{name: (r(name) > 0) & (r(name) < float("inf")) for name in ("distanceMeters", "durationSeconds", "durationMinutes")},
        "name": there(r("name")),
        "coordinates.count": F.size(points) >= 2,
        "coordinates": F.forall(points, lambda p: (F.size(p) == 2) & on_earth(F.get(p, F.lit(0)), F.get(p, F.lit(1)))),
        "start": end(1, "origin"),
        "end": end(-1, "destination"),
        "sourceAttribution": F.contains(r("sourceAttribution"), F.lit(MAP_CREDIT)),
        "generatedAt": dated(r("generatedAt")),
        "generatedAt.source": r("generatedAt") == F.col("source.capturedAt"),
        "restSpotIds": r("restSpotIds").isNotNull(),
        "walkingSegments": F.size("r.walkingSegments") > 0,
        "steepSlopeCount": whole(r("steepSlopeCount")),
        "indoorRestCount": whole(r("indoorRestCount")),
        "warnings": F.forall("r.warnings", lambda w: w.isNotNull()),
    }
    routes = sets.select(key, "request", "source", F.explode("routes").alias("r"))
    return sets.select(key, F.lit(None).cast("string").alias("route_id"), broken(of_set).alias("problem")).unionByName(routes.select(key, r("id").alias("route_id"), broken(of_route).alias("problem")))
