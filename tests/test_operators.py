import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import affordability, clean, forecast, geometry, market, matching, pricing, spatial
from marketloom.sources import readers, tables

GOOD = {"month": "2019-08", "town": " punggol ", "flat_type": "3 room", "block": "77C", "street_name": "EDGEFIELD  PLAINS", "storey_range": "13 TO 15", "floor_area_sqm": "68.5", "flat_model": "Premium", "lease_commence_date": "2004", "remaining_lease": "83 years 06 months", "resale_price": "391450.5"}


def raw(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes], ", ".join(f"{c} string" for c in GOOD))


def test_clean_types_a_good_row(spark):
    r = clean.clean(raw(spark, {}), "2020-02-29").first()
    assert r["is_valid"] and r["invalid_reasons"] == "" and (r["town"], r["flat_type"], r["street_name"]) == ("PUNGGOL", "3 ROOM", "EDGEFIELD PLAINS")
    assert (r["price"], r["area"], r["storey_mid"], r["lease"], r["psm"]) == (391450.5, 68.5, 14, 83.5, round(391450.5 / 68.5, 2))
    assert (r["year"], r["quarter"], r["months_since_start"], r["lease_source"], r["lease_age"]) == (2019, 3, 31, "reported", 15.58)


BROKEN = {
    "non_positive_price": {"resale_price": ["-1", "none", "0.0"]}, "non_positive_floor_area": {"floor_area_sqm": ["-3", "", "abc"]}, "implausible_floor_area": {"floor_area_sqm": ["19.9", "401"]},
    "unparseable_month": {"month": ["08-2019", "", "2019-13"]}, "future_month": {"month": ["2020-03"]}, "missing_town": {"town": ["", "null"]}, "missing_flat_type": {"flat_type": ["   ", "NaN"]},
    "unparseable_storey_range": {"storey_range": ["15 TO 13", "TOP"]}, "impossible_lease": {"remaining_lease": ["100 years", "0 years"], "lease_commence_date": ["1959", "2021", "?"]},
}


def test_every_rule_names_its_reason(spark):
    cases = [(reason, {field: value}) for reason, fields in BROKEN.items() for field, values in fields.items() for value in values]
    df = raw(spark, *[c for _, c in cases]).coalesce(1)
    got = [r["invalid_reasons"].split(";") for r in clean.clean(df, "2020-02-29").collect()]
    assert all(reason in g for (reason, _), g in zip(cases, got)), list(zip(cases, got))


def test_clean_takes_its_date_from_the_stamps(spark):
    df = raw(spark, {}, {"month": "2019-09"}).withColumn("_ingested_at", F.lit("2019-08-20T10:00:00+00:00"))
    assert sorted(r["invalid_reasons"] for r in clean.clean(df).collect()) == ["", "future_month"]


def test_duplicates_and_outliers_stay_in_models(spark):
    df = spark.createDataFrame([(True, "4 ROOM", True, True), (True, "1 ROOM", False, False), (False, "4 ROOM", False, False)], "is_valid boolean, flat_type string, is_duplicate boolean, is_price_outlier boolean")
    assert sorted(r["exclude_reason"] or "" for r in clean.exclusion(df).collect()) == ["", "invalid_record", "sparse_flat_type"]


def test_clean_needs_columns(spark):
    with pytest.raises(ValueError):
        clean.clean(raw(spark, {}).drop("town"), "2024-06-15")


@pytest.fixture(scope="module")
def sales(spark):
    """Nine sales a month of two towns and three types over four years, whose prices climb by a wave."""
    r = random.Random(23)
    rows = []
    for at, (town, kind) in enumerate((t, k) for t in "AB" for k in "345"):
        for month in range(48):
            level = 300_000 * (1 + at / 10) * (1 + month / 100 + 0.02 * math.sin(month / 4))
            rows += [(dt.date(2020 + month // 12, month % 12 + 1, 1), town, kind, r.choice("MN"), r.uniform(55, 110), level * r.uniform(0.95, 1.05), float(r.randint(2, 25)), 1985 + at, len(rows) + i) for i in range(9)]
    return spark.createDataFrame(rows, "month date, town string, flat_type string, flat_model string, area double, price double, storey_mid double, lease_year int, sale_id int").withColumn("psm", F.col("price") / F.col("area"))


def test_market_monthly(spark, sales):
    m = market.market_monthly(sales, dt.date(2023, 12, 1)).toPandas()
    assert len(m) == 12 * 48 and (m.groupby(["town", "flat_type"]).size() == 48).all()
    top = m[(m.town == "ALL") & (m.flat_type == "ALL")]
    assert top.transactions.sum() == 2 * 3 * 48 * 9
    p = sales.toPandas()
    assert top[top.month == dt.date(2021, 5, 1)].median_price.iloc[0] == pytest.approx(p[p.month == dt.date(2021, 5, 1)].price.median())


def test_index_uses_only_the_past(spark, sales):
    idx = {r["month"]: r["market_index_psm"] for r in market.market_index(sales, dt.date(2023, 12, 1)).collect()}
    p = sales.toPandas()
    past = p[(p.month >= dt.date(2021, 2, 1)) & (p.month < dt.date(2021, 5, 1))].psm.median()
    assert idx[dt.date(2021, 5, 1)] == pytest.approx(past) and dt.date(2024, 1, 1) in idx


def test_forecast_rows_do_not_look_ahead(spark, sales):
    f = forecast.series_features(market.market_monthly(sales, dt.date(2023, 12, 1)))
    rows = forecast.feature_rows(f)
    assert rows.where("target_month <= origin_month").isEmpty()
    done = forecast.errors(forecast.backtest_rows(rows, dt.date(2023, 12, 1)))
    assert {r["method"] for r in forecast.scorecard(done).collect()} == set(forecast.METHODS)
    assert forecast.intervals(done).where("q10 > q90").isEmpty()


def test_rank_towns(spark):
    prices = spark.createDataFrame([("A", 800_000.0, 50), ("B", 500_000.0, 50), ("C", 650_000.0, 50), ("D", 100_000.0, 3)], "town string, median_price double, transactions int")
    home = spark.createDataFrame([(1, 9000.0, 200_000.0)], "household int, income double, savings double")
    assert [r["town"] for r in affordability.rank_towns(prices, home).orderBy("rank").collect()] == ["B", "C", "A"]
    one = affordability.assess(spark.createDataFrame([(600_000.0, 9000.0, 100_000.0), (0.0, 9000.0, 0.0)], "p double, i double, s double"), F.col("p"), F.col("i"), F.col("s")).collect()
    assert one[0]["upfront_shortfall"] == 62_600 and one[1]["loan"] is None


def test_spatial_against_brute_force(spark):
    r = random.Random(3)
    a = [(i, r.uniform(0, 5000), r.uniform(0, 5000)) for i in range(60)] + [(99, None, None)]
    b = [(i, r.uniform(0, 5000), r.uniform(0, 5000)) for i in range(40)]
    left, right = spark.createDataFrame(a, "l int, x_m double, y_m double"), spark.createDataFrame(b, "r int, x_m double, y_m double")
    dist = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    near = {x["l"]: x["r"] for x in spatial.nearest(left, right, "l", "r", 100.0).collect()}
    assert near == {p[0]: min(b, key=lambda q: (dist(p, q), q[0]))[0] for p in a[:-1]}
    counts = {x["l"]: x["n"] for x in spatial.count_within(left, right, 700.0, "l", "r").collect()}
    assert counts == {p[0]: sum(dist(p, q) <= 700 for q in b) if p[1] is not None else 0 for p in a}
    line = spark.createDataFrame([(1, [[0.0, 0.0], [50.0, 0.4], [100.0, 0.0], [100.0, 90.0]])], "id int, points array<array<double>>")
    assert spatial.simplify_lines(line, 4.0).first()["points"] == [[0, 0], [100, 0], [100, 90]]


def test_address_match(spark):
    home = spark.createDataFrame([("T", "1", "BEDOK NTH ST 2"), ("T", "2", "BEDOK NTH ST 2"), ("T", "9", "BEDOK NTH ST 2"), ("U", "5", "XYZ RD")], "town string, block string, street_name string")
    built = spark.createDataFrame([("1", "BEN1", 1.3, 103.9), ("2", "BEN1", 1.301, 103.9), ("1", "BEX1", 1.2, 103.7)], "block string, street_code string, latitude double, longitude double")
    got = {(r["town"], r["block"]): (r["location_source"], r["street_code"]) for r in matching.match_addresses(home, built).collect()}
    assert got == {("T", "1"): ("building", "BEN1"), ("T", "2"): ("building", "BEN1"), ("T", "9"): ("street", "BEN1"), ("U", "5"): ("none", None)}


def test_a_street_far_from_its_town_loses_its_code(spark):
    home = spark.createDataFrame([("T", str(i), "BEDOK ST") for i in range(5)] + [("T", "50", "DOVER RD"), ("T", "60", "CLIVE RD")], "town string, block string, street_name string")
    built = spark.createDataFrame([(str(i), "BED1", 1.3, 103.9) for i in range(5)] + [("50", "DOV1", 1.4, 103.7), ("60", "CLI1", 1.301, 103.9), ("60", "CLI2", 1.39, 103.9)], "block string, street_code string, latitude double, longitude double")
    got = {r["block"]: (r["location_source"], r["street_code"], r["latitude"]) for r in matching.match_addresses(home, built).collect()}
    assert got["50"] == ("town", None, 1.3) and got["60"] == ("building", "CLI1", 1.301)


def test_only_malls_are_merged(spark):
    places = spark.createDataFrame([("mall", "Big Mall", 1.3, 103.8), ("mall", "BIG-MALL", 1.3001, 103.8), ("mall", "Big Mall", 1.35, 103.8), ("train", "Bedok", 1.3, 103.8), ("train", "Bedok", 1.3, 103.8), ("bus", None, None, 103.8)], "category string, name string, latitude double, longitude double")
    assert sorted(r["category"] for r in matching.clean_places(places).collect()) == ["mall", "mall", "train", "train"]


def test_address_without_building_takes_the_town(spark):
    home = spark.createDataFrame([("T", "1", "BEDOK ST"), ("T", "2", "XYZ RD")], "town string, block string, street_name string")
    built = spark.createDataFrame([("1", "BED1", 1.3, 103.9)], "block string, street_code string, latitude double, longitude double")
    got = {r["block"]: (r["location_source"], r["latitude"]) for r in matching.match_addresses(home, built).collect()}
    assert got == {"1": ("building", 1.3), "2": ("town", 1.3)}


def test_readers(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"STATION_NA": "BEDOK MRT STATION", "EXIT_CODE": "A"}, "geometry": {"type": "Point", "coordinates": [103.9, 1.3]}}, {"properties": {"NAME": "L", "PCN_LOOP": "East"}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[1, 1]]]}},
        {"properties": {"BLK_NO": "7", "ST_COD": "BE1", "POSTAL_COD": "460007"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}},
    ]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    f = readers.geojson(spark, str(tmp_path / "x.json"))
    s = readers.stations(f, "t").first()
    assert (s["name"], s["kind"], s["latitude"]) == ("Bedok", "MRT", 1.3)
    assert readers.line_parts(f, "t").count() == 1
    assert readers.buildings(f).first()["latitude"] == 1.0
    (tmp_path / "a.csv").write_text("a,b\n1,\nNA,x\n")
    assert [tuple(r) for r in readers.text_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()] == [("1", ""), ("NA", "x")]
    assert readers.content_hash(f.select("type")).first()["rows"] == 3


def test_tables(spark):
    with pytest.raises(ValueError):
        tables.checked("other_table")
    assert json.loads(tables.json_rows(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()["json"]) == {"a": None, "b": 1}


def test_town_map(spark):
    square = lambda x: [[x, 0.0], [x + 10, 0.0], [x + 10, 10.0], [x, 10.0], [x, 0.0]]
    areas = spark.createDataFrame([("BEDOK", "E", False, square(0.0)), ("ORCHARD", "C", True, square(20.0)), ("MUSEUM", "C", True, square(40.0)), ("KALLANG", "C", False, square(60.0)), ("TUAS", "W", False, square(80.0))], "planning_area string, region string, central_area boolean, ring array<array<double>>")
    towns = spark.createDataFrame([("BEDOK",), ("PUNGGOL",), ("CENTRAL AREA",), ("KALLANG/WHAMPOA",)], "town string")
    shapes = geometry.town_map(areas, towns)
    got = {r["name"]: r for r in shapes.collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"BEDOK": "town", "CENTRAL AREA": "town", "KALLANG/WHAMPOA": "town", "TUAS": "context"}
    assert got["CENTRAL AREA"]["merged"] and got["CENTRAL AREA"]["label_x"] == pytest.approx(35) and got["BEDOK"]["svg_path"] == "M0.0,0.0 10.0,0.0 10.0,10.0 0.0,10.0Z"
    assert [r["name"] for r in geometry.towns_not_drawn(shapes, towns).collect()] == ["PUNGGOL"]
    assert "ORCHARD" in {r["name"] for r in geometry.town_map(areas, towns.where("town = 'BEDOK'")).collect()}


def test_colours(spark):
    breaks = lambda *v: geometry.colour_breaks(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()["breaks"]
    assert breaks(*map(float, range(10, 0, -1))) == [3, 5, 7, 9] and breaks(1.0, 2.0, 3.0) == [] and breaks(None, 5.0, 1.0, 2.0, 4.0, 3.0) == [2, 3, 4, 5]
    shades = spark.createDataFrame([(2.9,), (3.0,), (9.0,), (None,)], "v double").select(geometry.shade(F.col("v"), F.array(*map(F.lit, (3.0, 5.0, 7.0, 9.0)))).alias("s")).collect()
    assert [r["s"] for r in shades] == [0, 1, 4, None]


def test_closed_rings_keep_their_corners(spark):
    ring = [[0.0, 0.0], [5.0, 0.1], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 4.0], [0.0, 0.0]]
    got = spatial.simplify_lines(spark.createDataFrame([(1, ring)], "id int, points array<array<double>>"), 0.5, closed=True).first()["points"]
    assert got == [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]


def test_nearest_reaches_any_distance(spark):
    left, right = (spark.createDataFrame(rows, f"{n} int, x_m double, y_m double") for n, rows in (("l", [(1, 0.0, 0.0), (2, 9e6, 9e6)]), ("r", [(5, 1.0, 0.0)])))
    assert {x["l"]: x["r"] for x in spatial.nearest(left, right, "l", "r", 1.0).collect()} == {1: 5, 2: 5}
    assert spatial.nearest(left, right.limit(0), "l", "r", 1.0).count() == 0


def test_valuation_of_an_exact_model(spark):
    class Twice:
        def transform(self, df):
            return df.withColumn("prediction", F.ln(F.col("area") * 2))

    flats = spark.createDataFrame([("x", "A", "3", 500.0, 100.0, 5.0, 1990, "M"), ("y", "A", "3", None, 80.0, 5.0, 1990, "M")], "flat string, town string, flat_type string, asking double, area double, storey_mid double, lease_year int, flat_model string")
    typical = spark.createDataFrame([("A", "3", 80.0, 5.0, 1990, "M")], "town string, flat_type string, typical_area double, typical_storey_mid double, typical_lease_year int, typical_flat_model string")
    index = spark.createDataFrame([(dt.date(2020, 1, 1), 10.0)], "month date, market_index_psm double")
    ranges = spark.createDataFrame([("ALL", 0.0, 0.0)], "flat_type string, q10 double, q90 double")
    got = {r["flat"]: r for r in pricing.valuation(Twice(), flats, typical, index, ranges).collect()}
    assert got["x"]["estimate"] == pytest.approx(2000) and got["x"]["position"] == "below" and got["x"]["effect_area"] == 400 and got["x"]["effect_storey_mid"] == 0
    assert got["y"]["position"] is None and got["y"]["difference"] is None and got["y"]["range_basis"] == "ALL"
