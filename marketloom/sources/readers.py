"""Readers that shape published files into tables. All lazily, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.parsing import PARK_WORDS, proper_name
from marketloom.sources.features import split_features

PLACE = ["category", "kind", "name", "detail", "latitude", "longitude", "source"]
COORDS = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text; an empty field stays an empty text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True).na.fill("")


def paged_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of paged JSON responses in the order of their ``_id``, each once: as the first page has it, by the files' names, and there
    the first of it. record: DDL of a record without ``_id``."""
    pages = spark.read.schema(f"records array<struct<_id: long, {record}>>").json(path)
    each = pages.select(F.col("_metadata.file_path").alias("file"), F.posexplode("records").alias("at", "r"))
    return each.groupBy("r._id").agg(F.min_by("r", F.struct("file", "at")).alias("r")).orderBy("_id").select("r.*").drop("_id")


def schema_difference(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns."""
    return [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]


def reconcile_by(df: DataFrame, stated: DataFrame, by: str) -> DataFrame:
    """(by, rows, stated, complete) of each source: its rows against the number that it states."""
    return stated.join(df.groupBy(by).agg(F.count("*").alias("rows")), by, "left").select(by, F.coalesce("rows", F.lit(0)).alias("rows"), "stated", (F.coalesce("rows", F.lit(0)) == F.col("stated")).alias("complete"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: row count and an order-insensitive sum of row hashes, for telling whether a snapshot has changed."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def stamped(df: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    return df.withColumns({"_ingested_at": F.current_timestamp() if at is None else at, "_source": F.lit(source)})


def log_run(run: DataFrame, path: str) -> None:
    """Append a run's row to the log."""
    run.write.mode("append").parquet(path)


def latest_run(log: DataFrame, at: str = "ingested_at") -> DataFrame:
    """The log's newest row; of equal times the one with the greatest values."""
    return log.agg(F.max_by(F.struct("*"), F.struct(at, *(c for c in log.columns if c != at))).alias("r")).select("r.*")


def year_series(spark: SparkSession, path: str, series: str) -> DataFrame:
    """(year, value) of one series of a statistics table in JSON; unreadable values are left out."""
    doc = spark.read.schema("Data struct<row: array<struct<seriesNo: string, rowText: string, columns: array<struct<key: string, value: string>>>>>").json(path, multiLine=True)
    rows = doc.select(F.explode("Data.row").alias("r")).where(F.col("r.seriesNo") == series).select(F.explode("r.columns").alias("c"))
    return rows.select(F.col("c.key").try_cast("int").alias("year"), F.col("c.value").try_cast("double").alias("value")).where("year is not null and value is not null")


def geojson(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(properties, type, coordinates as JSON text) of every feature. With ``split_bytes`` several tasks read each document, by
    ranges of so many bytes; without, a document is one task, but any path will do that Spark can read."""
    if split_bytes:
        f = split_features(spark, path, split_bytes).withColumnRenamed("feature", "f")
    else:
        doc = spark.read.text(path, wholetext=True)
        f = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    return f.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("f", "$.geometry.type").alias("type"), F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"))


def coordinates(kind: str) -> Column:
    return F.from_json("coordinates", COORDS[kind])


def _points(features: DataFrame, category: str, kind: Column, name: Column, detail: Column, source: str) -> DataFrame:
    p = coordinates("Point")
    return features.where("type = 'Point'").select(F.lit(category).alias("category"), kind.alias("kind"), name.alias("name"), detail.alias("detail"), p[1].alias("latitude"), p[0].alias("longitude"), F.lit(source).alias("source"))


def prop(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


#: Codes that stand in place of a station's name.
STATION_CODES = {
    "CC9": "PAYA LEBAR MRT STATION", "CC30": "KEPPEL MRT STATION", "CC31": "CANTONMENT MRT STATION", "CC32": "PRINCE EDWARD ROAD MRT STATION",
    "DT4": "HUME MRT STATION", "DT18": "TELOK AYER MRT STATION", "NE18": "PUNGGOL COAST MRT STATION",
}
#: What the last word of a park's name may end with.
PARK_ENDINGS = ("PK", "PARK", "GARDEN", "GARDENS", "GDN", "RESERVE", "GREEN", "PROMENADE")


def nothing() -> Column:
    return F.lit(None).cast("string")


def filled(x: Column) -> Column:
    """The trimmed text, null if empty."""
    return F.when(F.trim(x) != "", F.trim(x))


def stations(features: DataFrame, source: str) -> DataFrame:
    codes = F.create_map(*[F.lit(v) for kv in STATION_CODES.items() for v in kv])
    raw = F.upper(filled(prop("STATION_NA")))
    full = F.coalesce(F.try_element_at(codes, raw), raw)
    name = proper_name(F.regexp_replace(full, r"\s+(MRT|LRT)\s+STATION$", ""))
    return _points(features, "train", F.when(full.contains("LRT"), "LRT").otherwise("MRT"), name, F.trim(F.coalesce(prop("EXIT_CODE"), F.lit(""))), source).where("name is not null")


def bus_stops(features: DataFrame, source: str) -> DataFrame:
    n = filled(prop("BUS_STOP_NUM"))
    return _points(features.where(n.isNotNull()), "bus", nothing(), F.concat(F.lit("Bus stop "), n), n, source)


def hawker_centres(features: DataFrame, source: str) -> DataFrame:
    open_ = features.where(prop("STATUS").startswith("Existing") & (prop("NAME") != ""))
    return _points(open_, "hawker", nothing(), proper_name(prop("NAME")), prop("STATUS"), source)


def parks(features: DataFrame, source: str) -> DataFrame:
    name = F.upper(filled(prop("NAME")))
    last = F.element_at(F.split(name, " "), -1)
    listed = features.where(last.rlike(f"({'|'.join(PARK_ENDINGS)})$"))
    return _points(listed, "park", nothing(), proper_name(name, PARK_WORDS), nothing(), source)


def line_parts(features: DataFrame, source: str) -> DataFrame:
    """(name, loop, points, source): one row per line of two points at least; multi-part lines are split."""
    lines = F.when(F.col("type") == "LineString", F.array(coordinates("LineString"))).when(F.col("type") == "MultiLineString", coordinates("MultiLineString"))
    return features.select(F.coalesce(filled(prop("PARK")), F.lit("Park connector")).alias("name"), filled(prop("PCN_LOOP")).alias("loop"), F.explode(lines).alias("points"), F.lit(source).alias("source")).where(F.size("points") >= 2)


def outer_rings() -> Column:
    return F.when(F.col("type") == "Polygon", F.slice(coordinates("Polygon"), 1, 1)).when(F.col("type") == "MultiPolygon", F.transform(coordinates("MultiPolygon"), lambda p: p[0]))


def buildings(features: DataFrame) -> DataFrame:
    """(block, street_code, postal_code, latitude, longitude): the mean vertex of all outer rings, averaged per block."""
    pts = features.select(F.upper(filled(prop("BLK_NO"))).alias("block"), F.upper(filled(prop("ST_COD"))).alias("street_code"), filled(prop("POSTAL_COD")).alias("postal"), F.flatten(outer_rings()).alias("v"))
    pts = pts.where("block is not null and street_code is not null and size(v) > 0")
    mean = lambda i: F.aggregate("v", F.lit(0.0), lambda a, p: a + p[i]) / F.size("v")
    return pts.select("block", "street_code", "postal", mean(1).alias("la"), mean(0).alias("lo")).groupBy("block", "street_code").agg(F.min("postal").alias("postal_code"), F.avg("la").alias("latitude"), F.avg("lo").alias("longitude"))


#: Levels of schools and their kinds; all others are secondary schools.
SCHOOL_KINDS = {"PRIMARY": "Primary", "MIXED LEVEL (P1-S4)": "Primary", "JUNIOR COLLEGE": "Junior college", "CENTRALISED INSTITUTE": "Junior college"}
SCHOOL_COLUMNS = ["school_name", "postal_code", "mainlevel_code"]


def schools(csv: DataFrame, postal: DataFrame, source: str) -> DataFrame:
    """Schools placed by a (postal_code, latitude, longitude) table; unplaced ones have null coordinates."""
    missing, _ = schema_difference(csv, SCHOOL_COLUMNS)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = F.create_map(*[F.lit(v) for kv in SCHOOL_KINDS.items() for v in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.upper(F.trim("mainlevel_code"))), F.lit("Secondary"))
    code = F.trim("postal_code")
    s = csv.select(proper_name(F.col("school_name")).alias("name"), kind.alias("kind"), F.lpad(code, F.greatest(F.lit(6), F.length(code)), F.lit("0")).alias("postal_code"))
    return s.join(postal, "postal_code", "left").select(F.lit("school").alias("category"), "kind", "name", F.col("postal_code").alias("detail"), "latitude", "longitude", F.lit(source).alias("source"))


def unplaced(places: DataFrame) -> DataFrame:
    """One row: how many places have no position."""
    return places.agg(F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("unplaced"))


def malls(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Named malls of a map extract; areas have their position in ``center``."""
    doc = spark.read.schema("elements array<struct<lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>").json(path, multiLine=True)
    e = doc.select(F.explode("elements").alias("e"))
    name, la, lo = F.try_element_at("e.tags", F.lit("name")), F.coalesce("e.center.lat", "e.lat"), F.coalesce("e.center.lon", "e.lon")
    return e.where((name != "") & la.isNotNull()).select(F.lit("mall").alias("category"), nothing().alias("kind"), F.trim(name).alias("name"), nothing().alias("detail"), la.alias("latitude"), lo.alias("longitude"), F.lit(source).alias("source"))


def all_places(*tables: DataFrame) -> DataFrame:
    out = tables[0].select(PLACE)
    for t in tables[1:]:
        out = out.unionByName(t.select(PLACE))
    return out


def planning_areas(features: DataFrame) -> DataFrame:
    """(planning_area, region, central_area, type, coordinates); names from properties, else from an HTML description table."""

    def named(key: str) -> Column:
        cells = F.split(F.coalesce(prop("Description"), F.lit("")), f"<th>{key}</th>")
        cell = F.substring_index(F.substring_index(F.get(cells, F.lit(1)), "</td>", 1), "<td>", -1)
        return F.upper(F.coalesce(filled(prop(key)), filled(cell)))

    areas = features.where("type in ('Polygon', 'MultiPolygon')").select(named("PLN_AREA_N").alias("planning_area"), named("REGION_N").alias("region"), F.coalesce(named("CA_IND") == "Y", F.lit(False)).alias("central_area"), "type", "coordinates")
    return areas.where("planning_area is not null")


def area_rings(areas: DataFrame) -> DataFrame:
    """One row for each outer ring of the planning areas, as an array of [lon, lat]."""
    return areas.withColumn("ring", F.explode(outer_rings())).drop("type", "coordinates")
