"""Registered queries of sources and sinks: each writes files or tables from the test tables and reads them with a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans import adapter as a
from marketloom.plans.queries import query, rounded
from marketloom.sources import readers, snapshots, tables
from marketloom.sources.scratch import shared_folder, stored


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _document(df: DataFrame, outer: str, each: Column) -> DataFrame:
    """One JSON document a partition: {"<outer>": [...]}; a published file is one document."""
    rows = df.select(F.spark_partition_id().alias("p"), F.to_json(each).alias("j"))
    return rows.groupBy("p").agg(F.concat(F.lit(f'{{"type": "FeatureCollection", "{outer}": ['), F.array_join(F.collect_list("j"), ","), F.lit("]}")).alias("value")).select("value")


def _collection(spark: SparkSession, features: DataFrame, name: str) -> DataFrame:
    """Features (properties struct, type, coordinates) written as GeoJSON files and read back."""
    path = _path(spark, name)
    _document(features, "features", F.struct("properties", F.struct("type", "coordinates").alias("geometry"))).write.text(path)
    return readers.geojson(spark, path)


def _at(k: Column) -> Column:
    return F.array(103.65 + (k * 104729 % 10009) / 10009 * 0.35, 1.25 + (k * 7919 % 10007) / 10007 * 0.2)


def _points(spark: SparkSession, d: str, **properties: Column) -> DataFrame:
    s = a.table(spark, d, "supplier")
    return s.select(F.struct(*[x.alias(n) for n, x in properties.items()]).alias("properties"), F.lit("Point").alias("type"), _at(F.col("s_suppkey")).alias("coordinates"))


_XY = "round(1.25::DOUBLE + (s_suppkey * 7919 % 10007) / 10007.0::DOUBLE * 0.2::DOUBLE, 6) AS latitude, round(103.65::DOUBLE + (s_suppkey * 104729 % 10009) / 10009.0::DOUBLE * 0.35::DOUBLE, 6) AS longitude"


def _shown(places: DataFrame) -> DataFrame:
    return places.select("category", "kind", "name", "detail", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'NA' ELSE c_name END AS c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer", ())
def text_csv(spark: SparkSession, d: str) -> DataFrame:
    path, k = _path(spark, "csv"), F.col("c_custkey")
    a.table(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, "").when(k % 7 == 1, "NA").otherwise(F.col("c_name")).alias("c_name"), "c_nationkey").write.option("header", True).option("emptyValue", "").csv(path)
    return readers.text_csv(spark, path, ["c_custkey", "c_name", "c_nationkey"])


@query("SELECT s_name AS name, s_acctbal AS balance FROM supplier", ())
def paged_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages of suppliers, some of which come on two pages."""
    path = _path(spark, "pages")
    s = a.table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("page"), F.struct(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("r"))
    s = s.unionByName(s.where("r._id % 3 = 0").withColumn("page", F.col("page") + 5))
    s.groupBy("page").agg(F.collect_list("r").alias("records")).select("records").write.json(path)
    return readers.paged_records(spark, path, "name: string, balance: double").select("name", "balance")


@query("SELECT 'c_custkey' AS column_name, false AS missing, false AS unexpected UNION ALL SELECT 'c_name', false, false UNION ALL SELECT 'nothing', true, false UNION ALL SELECT unnest(['c_acctbal', 'c_mktsegment', 'c_nationkey']), false, true FROM (SELECT 1 FROM customer LIMIT 1)", ())
def schema_check(spark: SparkSession, d: str) -> DataFrame:
    expected = ["c_custkey", "c_name", "nothing"]
    missing, unexpected = readers.schema_difference(a.table(spark, d, "customer"), expected)
    return spark.createDataFrame([(c, c in missing, c in unexpected) for c in [*expected, *unexpected]], "column_name string, missing boolean, unexpected boolean")


@query("SELECT o_orderstatus AS source, count(*) AS rows, count(*) + (o_orderstatus = 'F')::INT AS stated, o_orderstatus <> 'F' AS complete FROM orders GROUP BY o_orderstatus", ())
def row_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source against what it states; one states a row too many."""
    o = a.table(spark, d, "orders")
    stated = o.groupBy(F.col("o_orderstatus").alias("source")).agg((F.count("*") + (F.first("o_orderstatus") == "F").cast("int")).alias("stated"))
    return readers.reconcile_by(o.withColumnRenamed("o_orderstatus", "source"), stated, "source")


@query("SELECT t AS pair, t <> 'one row changed' AS same, (SELECT count(*) FROM customer) AS rows FROM (SELECT unnest(['shuffled', 'one row changed']) AS t)", ())
def snapshot_change(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a snapshot, of the same rows in another order and of a snapshot with one other value."""
    c = a.table(spark, d, "customer")
    first, second = readers.content_hash(c).select("rows", "digest"), readers.content_hash(c.repartition(7, "c_name")).select(F.col("digest").alias("d2"))
    third = readers.content_hash(c.withColumn("c_acctbal", F.when(F.col("c_custkey") == 7, 0.001).otherwise(F.col("c_acctbal")))).select(F.col("digest").alias("d3"))
    one = first.join(second).join(third)
    return one.select(F.explode(F.array(F.struct(F.lit("shuffled").alias("pair"), (F.col("digest") == F.col("d2")).alias("same")), F.struct(F.lit("one row changed").alias("pair"), (F.col("digest") == F.col("d3")).alias("same")))).alias("x"), "rows").select("x.*", "rows")


_SECOND = """first AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderkey AS k, o_totalprice AS price FROM orders),
second AS (SELECT month, k, CASE WHEN month = DATE '1997-03-01' AND k % 3 = 0 THEN price + 1 ELSE price END AS price FROM first WHERE month <> DATE '1996-02-01' AND NOT (month = DATE '1998-01-01' AND k % 5 = 0))"""


@query("""SELECT month, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, added IS NOT NULL AS rewritten, coalesce(rows, 0) AS rows, round(coalesce(price, 0), 2) AS price FROM (SELECT month FROM first GROUP BY month)
 LEFT JOIN (SELECT month, sum((s.k IS NOT NULL)::INT)::BIGINT AS added, sum((f.k IS NOT NULL)::INT)::BIGINT AS removed FROM first f FULL JOIN second s USING (month, k) WHERE f.price IS DISTINCT FROM s.price GROUP BY month) USING (month)
 LEFT JOIN (SELECT month, count(*) AS rows, sum(price) AS price FROM second GROUP BY month) USING (month)""", (_SECOND,))
def incremental_months(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a table by months, then a second snapshot of them: a month's prices changed, some orders and a whole month gone."""
    path, month = _path(spark, "snapshots"), F.trunc("o_orderdate", "MM")
    first = stored(a.table(spark, d, "orders").select(month.alias("month"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")))
    at = lambda day: F.col("month") == F.lit(day).cast("date")
    price = F.when(at("1997-03-01") & (F.col("k") % 3 == 0), F.col("price") + 1).otherwise(F.col("price"))
    second = stored(first.where(~at("1996-02-01") & ~(at("1998-01-01") & (F.col("k") % 5 == 0))).withColumn("price", price))
    snapshots.refresh(first, path)
    touched = snapshots.refresh(second, path)
    now = spark.read.schema("k long, price double, month date").parquet(f"{path}/rows").groupBy("month").agg(F.count("*").alias("rows"), F.sum("price").alias("price"))
    out = first.select("month").distinct().join(touched.withColumn("rewritten", F.lit(True)), "month", "left").join(now, "month", "left").fillna(0, ["added", "removed", "rows", "price"])
    return out.select("month", "added", "removed", F.coalesce("rewritten", F.lit(False)).alias("rewritten"), "rows", F.round("price", 2).alias("price"))


@query("SELECT o_orderkey, 'orders' AS _source, TIMESTAMP '2024-06-15 00:00:00' AS _ingested_at FROM orders", ())
def stamped_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.stamped(a.table(spark, d, "orders").select("o_orderkey"), "orders", F.lit("2024-06-15").cast("timestamp_ntz"))


@query("SELECT year(o_orderdate)::BIGINT AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1", ())
def year_series(spark: SparkSession, d: str) -> DataFrame:
    """A statistics table of two series, of which one is read; a year that can't be read is left out."""
    path = _path(spark, "stats")
    y = a.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    cells = y.agg(F.collect_list(F.struct(F.col("y").cast("string").alias("key"), F.col("v").cast("string").alias("value"))).alias("c")).withColumn("c", F.concat("c", F.array(F.struct(F.lit("2050").alias("key"), F.lit("na").alias("value")))))
    row = lambda n: F.struct(F.lit(n).alias("seriesNo"), F.lit("x").alias("rowText"), F.col("c").alias("columns"))
    cells.select(F.to_json(F.struct(F.struct(F.array(row("1.2"), row("1.1")).alias("row")).alias("Data"))).alias("value")).write.text(path)
    return readers.year_series(spark, path, "1.1").select(F.col("year").cast("long").alias("year"), "value")


@query(f"SELECT 'train' AS category, CASE WHEN s_suppkey % 5 = 2 THEN 'LRT' ELSE 'MRT' END AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'Telok Ayer' WHEN 1 THEN 'Bedok' WHEN 2 THEN 'Sengkang' ELSE 'Bishan-Ang' END AS name, 'Exit ' || s_suppkey % 3 AS detail, {_XY} FROM supplier WHERE s_suppkey % 5 <> 4", ())
def station_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "DT18").when(k % 5 == 1, "BEDOK MRT STATION").when(k % 5 == 2, "sengkang lrt station").when(k % 5 == 3, "BISHAN-ANG MRT STATION").otherwise(" ")
    return _shown(readers.stations(_collection(spark, _points(spark, d, STATION_NA=name, EXIT_CODE=F.concat(F.lit("Exit "), (k % 3).cast("string"))), "stations"), "x"))


@query(f"SELECT 'bus' AS category, NULL::VARCHAR AS kind, 'Bus stop ' || s_suppkey AS name, s_suppkey::VARCHAR AS detail, {_XY} FROM supplier WHERE s_suppkey % 4 <> 0", ())
def bus_stop_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _shown(readers.bus_stops(_collection(spark, _points(spark, d, BUS_STOP_NUM=F.when(k % 4 != 0, F.concat(F.lit(" "), k.cast("string"))).otherwise("")), "stops"), "x"))


@query(f"SELECT 'bus' AS category, NULL::VARCHAR AS kind, 'Bus stop ' || s_suppkey AS name, s_suppkey::VARCHAR AS detail, {_XY} FROM supplier", ())
def split_document_rows(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers in one document, of which every task reads a range of bytes."""
    path = _path(spark, "one")
    stops = _points(spark, d, BUS_STOP_NUM=F.col("s_suppkey").cast("string"))
    _document(stops.coalesce(1), "features", F.struct(F.lit("Feature").alias("type"), "properties", F.struct("type", "coordinates").alias("geometry"))).write.text(path)
    return _shown(readers.bus_stops(readers.geojson(spark, path, split_bytes=16 << 10), "x"))


@query(f"SELECT 'hawker' AS category, NULL::VARCHAR AS kind, 'Old Airport Rd (Kato Ng)' AS name, 'Existing (new)' AS detail, {_XY} FROM supplier WHERE s_suppkey % 3 = 0", ())
def hawker_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _shown(readers.hawker_centres(_collection(spark, _points(spark, d, NAME=F.lit("OLD AIRPORT RD (KATO NG)"), STATUS=F.when(k % 3 == 0, "Existing (new)").otherwise("Under Construction")), "hawkers"), "x"))


@query(f"SELECT 'park' AS category, NULL::VARCHAR AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'Tiong Bahru Park' WHEN 1 THEN 'East Coast Promenade' ELSE 'Hort Garden' END AS name, NULL::VARCHAR AS detail, {_XY} FROM supplier WHERE s_suppkey % 4 < 3", ())
def park_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "Tiong Bahru PK").when(k % 4 == 1, "EAST COAST PROMENADE").when(k % 4 == 2, "HORT GDN").otherwise("WEST WOODS")
    return _shown(readers.parks(_collection(spark, _points(spark, d, NAME=name), "parks"), "x"))


@query("SELECT 'Park connector' AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'East' END AS loop, n::BIGINT AS points FROM nation, unnest([2, 3]) u(n)", ())
def line_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations as lines of two parts; a third part of one point is left out."""
    k = F.col("n_nationkey")
    parts = F.array(F.array(_at(k), _at(k + 1)), F.array(_at(k), _at(k + 1), _at(k + 2)), F.array(_at(k)))
    f = a.table(spark, d, "nation").select(F.struct(F.lit("").alias("PARK"), F.when(k % 2 == 0, "East").alias("PCN_LOOP")).alias("properties"), F.lit("MultiLineString").alias("type"), parts.alias("coordinates"))
    return readers.line_parts(_collection(spark, f, "lines"), "x").select("name", "loop", F.size("points").cast("long").alias("points"))


@query("SELECT s_suppkey::VARCHAR AS block, 'BE1' AS street_code, '46' || s_suppkey AS postal_code, round(la + 1.1::DOUBLE / 2, 6) AS latitude, round(lo + 1.1::DOUBLE / 2, 6) AS longitude FROM (SELECT s_suppkey, (s_suppkey * 7919 % 10007) / 10007.0::DOUBLE AS la, (s_suppkey * 104729 % 10009) / 10009.0::DOUBLE AS lo FROM supplier)", ())
def building_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as buildings of two outlines each, one of them in two parts."""
    k = F.col("s_suppkey")
    x, y = (k * 104729 % 10009) / 10009, (k * 7919 % 10007) / 10007
    square = lambda dx: F.array(F.array(x + dx, y + dx), F.array(x + dx + 1, y + dx), F.array(x + dx + 1, y + dx + 1), F.array(x + dx, y + dx + 1))
    own = F.struct(F.concat(F.lit(" "), k.cast("string")).alias("BLK_NO"), F.lit("be1").alias("ST_COD"), F.concat(F.lit("46"), k.cast("string")).alias("POSTAL_COD")).alias("properties")
    s = a.table(spark, d, "supplier")
    one = s.select(own, F.lit("Polygon").alias("type"), F.array(square(0.0)).alias("coordinates"))
    two = s.select(own, F.lit("MultiPolygon").alias("type"), F.array(F.array(square(0.05)), F.array(square(0.15))).alias("coordinates"))
    path = _path(spark, "buildings")
    for part in (one, two):
        _document(part, "features", F.struct("properties", F.struct("type", "coordinates").alias("geometry"))).write.mode("append").text(path)
    return readers.buildings(readers.geojson(spark, path)).select("block", "street_code", "postal_code", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("SELECT s_name AS name, list_extract(['Primary', 'Primary', 'Junior college', 'Secondary'], (s_suppkey % 4 + 1)::BIGINT) AS kind, lpad(s_suppkey::VARCHAR, 6, '0') AS detail, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey / 10.0::DOUBLE END AS latitude FROM supplier", ())
def school_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    level = F.element_at(F.array(*[F.lit(x) for x in ("primary", "MIXED LEVEL (P1-S4)", "CENTRALISED INSTITUTE", "SECONDARY")]), (k % 4 + 1).cast("int"))
    path = _path(spark, "schools")
    a.table(spark, d, "supplier").select(F.col("s_name").alias("school_name"), k.alias("postal_code"), level.alias("mainlevel_code")).write.option("header", True).csv(path)
    known = a.table(spark, d, "supplier").where(k % 3 > 0).select(F.lpad(k.cast("string"), 6, "0").alias("postal_code"), (k / 10.0).alias("latitude"), F.lit(103.8).alias("longitude"))
    return readers.schools(readers.text_csv(spark, path, readers.SCHOOL_COLUMNS), known, "x").select("name", "kind", "detail", "latitude")


@query("SELECT count(*) FILTER (WHERE s_suppkey % 3 = 0) AS unplaced FROM supplier", ())
def unplaced_schools(spark: SparkSession, d: str) -> DataFrame:
    return readers.unplaced(school_rows(spark, d).withColumn("longitude", F.col("latitude")))


@query("SELECT s_name AS name, s_suppkey / 10.0::DOUBLE AS latitude FROM supplier WHERE s_suppkey % 4 > 0", ())
def mall_rows(spark: SparkSession, d: str) -> DataFrame:
    """A map extract of points and areas; some have no name."""
    k, path = F.col("s_suppkey"), _path(spark, "malls")
    la = k / 10.0
    e = F.struct(F.when(k % 2 == 0, la).alias("lat"), F.when(k % 2 == 0, F.lit(103.8)).alias("lon"), F.when(k % 2 == 1, F.struct(la.alias("lat"), F.lit(103.8).alias("lon"))).alias("center"), F.when(k % 4 > 0, F.create_map(F.lit("name"), F.concat(F.col("s_name"), F.lit(" ")))).alias("tags"))
    _document(a.table(spark, d, "supplier"), "elements", e).write.text(path)
    return readers.malls(spark, path, "x").select("name", "latitude")


@query("SELECT category, count(*) AS places FROM (SELECT 'bus' AS category FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'hawker' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'park' FROM supplier WHERE s_suppkey % 4 < 3 UNION ALL SELECT 'train' FROM supplier WHERE s_suppkey % 5 <> 4) GROUP BY category", ())
def place_sources(spark: SparkSession, d: str) -> DataFrame:
    """All sources of places in one table."""
    each = [f(spark, d).withColumn("source", F.lit("x")) for f in (bus_stop_rows, hawker_rows, park_rows, station_rows)]
    return readers.all_places(*each).groupBy("category").agg(F.count("*").alias("places"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'AREA ' ELSE 'PLACE ' END || n_nationkey AS planning_area, 'REGION ' || n_regionkey AS region, n_nationkey % 3 = 0 AS central_area, 5::BIGINT AS points FROM nation", ())
def planning_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas whose names stand in properties or in a description's table."""
    k = F.col("n_nationkey")
    name, region = F.concat(F.when(k % 2 == 0, "Area ").otherwise("Place "), k.cast("string")), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))
    central = F.when(k % 3 == 0, "Y").otherwise("N")
    table = F.concat(F.lit("<table><tr><th>PLN_AREA_N</th> <td>"), name, F.lit("</td></tr><tr><th>REGION_N</th> <td>"), region, F.lit("</td></tr><tr><th>CA_IND</th><td>"), central, F.lit("</td></tr></table>"))
    plain = k % 2 == 0
    own = F.struct(F.when(plain, name).alias("PLN_AREA_N"), F.when(plain, region).alias("REGION_N"), F.when(plain, central).alias("CA_IND"), F.when(~plain, table).alias("Description")).alias("properties")
    ring = F.array(*[F.array(x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (k + 1.0, F.lit(0.0)), (k + 1.0, F.lit(1.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0)))])
    f = a.table(spark, d, "nation").select(own, F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return readers.area_rings(readers.planning_areas(_collection(spark, f, "areas"))).select("planning_area", "region", "central_area", F.size("ring").cast("long").alias("points"))


@query("SELECT c_nationkey::BIGINT AS nation, count(*) * 2 AS rows FROM customer GROUP BY 1", ())
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table overwritten, then appended to, documented, read by name and dropped."""
    name = f"silver_t{uuid.uuid4().hex}"
    c = a.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"))
    tables.write_table(c.limit(1), name)
    tables.write_table(c, name)
    tables.write_table(c, name, "append")
    tables.describe_table(spark, name, "customers' nations", "customer")
    out = stored(tables.read_table(spark, name).groupBy("nation").agg(F.count("*").alias("rows")))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT c_nationkey::BIGINT AS nation, NULL::DOUBLE AS income FROM customer GROUP BY 1", ())
def optional_table(spark: SparkSession, d: str) -> DataFrame:
    """A join with a table that does not exist gives empty columns."""
    none = tables.read_table(spark, f"bronze_t{uuid.uuid4().hex}", "nation long, income double")
    return a.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation")).distinct().join(none, "nation", "left")


@query("SELECT 'customers' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'summary', count(*) FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)", ())
def serving_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pruned tables as Parquet with a manifest of their rows; two summaries become one."""
    both = a.table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(a.table(spark, d, "region").select(F.col("r_name").alias("name")))
    folder = _path(spark, "serving")
    tables.publish({"customers": (a.table(spark, d, "customer"), ["c_custkey", "c_name"]), "summary": (both, ["name"])}, folder)
    return spark.read.schema("table string, rows long").json(f"{folder}/manifest")


@query("SELECT s_suppkey AS place, CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE (s_suppkey / 2.0)::DOUBLE::VARCHAR END AS value, s_suppkey % 3 = 0 AS none FROM supplier", ())
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that JSON has no word for become null, also inside structs and arrays."""
    k = F.col("s_suppkey")
    x = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(k / 2.0)
    df = a.table(spark, d, "supplier").select(k.alias("place"), F.struct(x.alias("x"), F.array(x, F.lit(1.0)).alias("y")).alias("s"))
    j = tables.json_rows(df).select(F.get_json_object("json", "$.place").cast("long").alias("place"), F.coalesce(F.get_json_object("json", "$.s.x"), F.lit("null")).alias("value"), (F.get_json_object("json", "$.s.y[0]").isNull() | (F.get_json_object("json", "$.s.y[0]") == "null")).alias("none"))
    return rounded(j)
