"""Source rows to typed records: every dropped row has a reason, every dataset a manifest entry."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.functions.text import mark, number

#: Where coordinates of a national dataset can lie.
SOUTH, NORTH, WEST, EAST = 20.0, 50.0, 120.0, 155.0


def record_problem(lat: Column, lon: Column, record_id: Column, name: Column, in_area: bool = True) -> Column:
    """Why a row can't be a record, the first reason in a fixed order; null if it can."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    y, x = number(lat), number(lon)
    out = F.when(blank(lat) | blank(lon), "coordinate_blank").when(y.isNull() | x.isNull(), "coordinate_not_numeric")
    if in_area:
        out = out.when(~(y.between(SOUTH, NORTH) & x.between(WEST, EAST)), "coordinate_out_of_area")
    return out.when(blank(record_id) | blank(name), "id_or_name_blank")


def typed_records(rows: DataFrame, lat: Column, lon: Column, record_id: Column, name: Column, in_area: bool = True, **more: Column) -> DataFrame:
    """rows as record_id, name, lat, lon and further columns, with problem."""
    out = rows.withColumn("problem", record_problem(lat, lon, record_id, name, in_area))
    return out.select("dataset", F.trim(record_id).alias("record_id"), F.trim(name).alias("name"), number(lat).alias("lat"), number(lon).alias("lon"), *[v.alias(k) for k, v in more.items()], "problem")


def either(*columns: Column) -> Column:
    """The first cell that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


@dataclass(frozen=True)
class Shape:
    """How one source's columns make records: for each value the columns that may hold it, the first that isn't blank counts."""

    dataset: str
    category: str
    lat: tuple[str, ...]
    lon: tuple[str, ...]
    record_id: tuple[str, ...]
    name: tuple[str, ...]
    address: tuple[str, ...] = ()
    #: Columns of marks (yes or no signs), by the name they get; any that a source lacks is unknown.
    marks: tuple[tuple[str, str], ...] = ()
    #: Whether rows outside the country's area are no records (toilets), and the name of places that have none (water).
    in_area: bool = True
    nameless: str | None = None


MARKS = ("seating", "water", "wheelchair")


def normalised(rows: DataFrame, shape: Shape) -> DataFrame:
    """The rows of one source as records, with problem; rows that are no records keep their reason."""
    missing = {c for f in (shape.lat, shape.lon, shape.record_id, shape.name, shape.address) for c in f} - set(rows.columns)
    if missing:
        raise ValueError(f"{shape.dataset} lacks the columns {sorted(missing)}")
    marks = dict(shape.marks)
    of = lambda names: either(*map(F.col, names)) if names else F.lit(None).cast("string")
    more = {m: mark(F.col(marks[m])) if m in marks else F.lit(None).cast("boolean") for m in MARKS}
    own = rows.withColumn("dataset", F.lit(shape.dataset))
    name = F.coalesce(of(shape.name), F.lit(shape.nameless)) if shape.nameless else of(shape.name)
    own = typed_records(own, of(shape.lat), of(shape.lon), of(shape.record_id), name, shape.in_area, address=of(shape.address), **more)
    return own.withColumn("category", F.lit(shape.category)).withColumn("record_id", F.concat("dataset", F.lit(":"), "record_id"))


def all_records(sources: dict[str, DataFrame], shapes: tuple[Shape, ...]) -> DataFrame:
    """The records of all sources of a catalogue in one table; each source is read once, by its own shape."""
    return functools.reduce(DataFrame.unionByName, [normalised(sources[s.dataset], s) for s in shapes])


def reject_counts(records: DataFrame) -> DataFrame:
    return records.where("problem is not null").groupBy("dataset", "problem").agg(F.count("*").alias("n"))


#: The reasons why a row is no record, in the order in which they are asked.
PROBLEMS = ("coordinate_blank", "coordinate_not_numeric", "coordinate_out_of_area", "id_or_name_blank", "name_blank")


def reject_profile(records: DataFrame) -> DataFrame:
    """A row for each dataset and each reason, with 0 where a dataset has none; one pass over the records."""
    n = records.groupBy("dataset").agg(*[F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS])
    return n.unpivot("dataset", list(PROBLEMS), "problem", "n")


#: Fixed value: the category of spots that nobody has listed officially.
ESTIMATED_SPOT = "estimated_rest_spot"


def official_confidence(category: Column) -> Column:
    """What a listing alone can tell of a place: an estimated spot stays estimated, any other is possible."""
    return F.when(category == ESTIMATED_SPOT, "estimated").otherwise("possible")


def rest_candidates(records: DataFrame, estimated: DataFrame) -> DataFrame:
    """Records and estimated spots in one table of possible rest points, with confidence; toilets are none.

    records: as normalised, without problem; estimated: record_id, name, lat, lon and category.
    """
    cols = ("record_id", "name", "lat", "lon")
    own = records.where("problem is null and category <> 'public_toilet'").select(*cols, "category")
    spots = estimated.where("category <> 'public_toilet'").select(*cols, F.lit(ESTIMATED_SPOT).alias("category"))
    return own.unionByName(spots).withColumn("confidence", official_confidence(F.col("category")))


def record_order(name: Column) -> list[Column]:
    """The order in which records are written: dataset, record, name (after NFKC), coordinates, unknown ones as blank."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [blank("dataset"), blank("record_id"), name, F.col("lat"), F.col("lon")]


def require_rows(records: DataFrame) -> DataFrame:
    """Datasets of which no row is a record; publishing checks that there are none."""
    return records.groupBy("dataset").agg(F.count_if(F.col("problem").isNull()).alias("n")).where("n = 0")


def manifest(records: DataFrame, snapshots: DataFrame, datasets: DataFrame, previous: DataFrame | None, retrieved_at: Column) -> DataFrame:
    """A row for each dataset: content hash, size, kept and dropped rows, retrieved_at (kept while the hash is), generated_at.

    snapshots: dataset, byte_size, content_sha256; datasets: dataset and what describes it.
    """
    counts = records.groupBy("dataset").agg(F.count_if(F.col("problem").isNull()).alias("n_records"), F.count_if(F.col("problem").isNotNull()).alias("n_rejected"))
    rows = datasets.join(snapshots.hint("merge"), "dataset").join(counts.hint("merge"), "dataset", "left").withColumn("retrieved_at", retrieved_at)
    rows = rows.fillna(0, ["n_records", "n_rejected"])
    if previous is not None:
        rows = retained(rows, previous)
    return rows.crossJoin(rows.agg(F.max("retrieved_at").alias("generated_at")))  # one row


def retained(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """rows with the previous retrieved_at where the content is the same as then."""
    old = previous.select("dataset", "content_sha256", F.col("retrieved_at").alias("_was"))
    return rows.join(old.hint("merge"), ["dataset", "content_sha256"], "left").withColumn("retrieved_at", F.coalesce("_was", "retrieved_at")).select(*rows.columns)


def longest_prefix(ids: DataFrame, datasets: DataFrame, key: str = "source_id") -> DataFrame:
    """The dataset of each source id: equal to it, or its beginning before : or -; the longest wins; null where none fits.

    Every beginning that ends before a separator is looked up, so the join is one of equality.
    """
    parts = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.when(F.substring(key, i + 1, F.lit(1)).isin(":", "-", ""), F.substring(key, F.lit(1), i)))
    rows = ids.select(key, F.explode_outer(F.filter(parts, lambda p: p.isNotNull())).alias("_p"))
    met = rows.join(datasets.select(F.col("dataset").alias("_p"), F.col("dataset")).hint("merge"), "_p", "left")
    return met.groupBy(key).agg(F.max_by("dataset", F.when(F.col("dataset").isNotNull(), F.length("dataset"))).alias("dataset"))
