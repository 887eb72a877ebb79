"""Ties, and searches of places that meet each box of neighbours once."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import comparables, nearby, reports, spatial


def test_share_of_income_rounds_ties_to_even(spark):
    homes = [(1, "t", "4", 10219.5, 0.0, 1e5, 0.0), (2, "t", "4", 3505.5, 0.0, 1e5, 0.0)]  # 13.55 and -61.05 %
    H = spark.createDataFrame(homes, "household long, town string, flat_type string, income double, savings double, own_price double, own_limit double")
    S = spark.createDataFrame([("t", "4", 1e5, 50)], "town string, flat_type string, median_12m double, sales_12m long")
    B = spark.createDataFrame([(2020, 9000.0)], "year int, income double")
    got = {x["household"]: x["income_vs_benchmark_pct"] for x in reports.affordability_report(H, S, B).collect()}
    assert got == {1: 13.6, 2: -61.0}


@pytest.mark.parametrize("origin", [False, True])
def test_equal_differences_are_ties(spark, origin):
    # 33 and 25 lie equally far from 29, but 3.3 - 2.9 and 2.9 - 2.5 differ in the last bits; the smaller id comes first
    pairs = [(float(t), float(t + s), float(t - s)) for t in range(10, 60) for s in range(1, 9) if abs(t / 10 - (t + s) / 10) != abs(t / 10 - (t - s) / 10)]
    sales, targets = [], []
    for i, (t, a, b) in enumerate(pairs[:40]):
        first, second = (a, b) if abs(t / 10 - a / 10) > abs(t / 10 - b / 10) else (b, a)
        sales += [("a", f"x{i}", first), ("b", f"x{i}", second)]
        targets.append((f"x{i}", f"x{i}", t))
    S = spark.createDataFrame([(i, town, "4", x, 5.0, 1990, "A", 1.0, dt.date(2022, 6, 1), 0.0, 0.0) for i, town, x in sales], "sale_id string, town string, flat_type string, area double, storey_mid double, lease_year int, flat_model string, price double, month date, x_m double, y_m double")
    T = spark.createDataFrame([(i, town, "4", x, 5.0, 1990, "A", 0.0, 0.0) for i, town, x in targets], "target string, town string, flat_type string, t_area double, t_storey double, t_lease int, t_model string, t_x double, t_y double")
    if not origin:
        S, T = S.drop("x_m", "y_m"), T.drop("t_x", "t_y")
    got = comparables.find_comparables(T, S, dt.date(2022, 6, 1)).where("rank = 1").collect()
    assert len(got) == len(targets) and {x["sale_id"] for x in got} == {"a"}


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(5)
    places = [(i, c, r.choice(["MRT", "LRT"]) if c == "train" else None, f"n{r.randrange(30)}", r.gauss(0, 900), r.gauss(0, 900)) for i in range(600) for c in [r.choice([*nearby.MARKED, "bus"])]]
    blocks = [(i, r.gauss(0, 1500), r.gauss(0, 1500)) for i in range(150)] + [(200, 9e4, 9e4), (201, None, 0.0)]
    return blocks, places, spark.createDataFrame(blocks, "block long, x_m double, y_m double"), spark.createDataFrame(places, "place long, category string, kind string, name string, x_m double, y_m double")


def test_markers_against_a_plain_version(points):
    blocks, places, B, P = points
    want = {}
    for b, x, y in blocks:
        for c, (radius, most) in nearby.MARKED.items():
            each = sorted((math.hypot(x - p[4], y - p[5]), p[0], (p[3], p[2]) if c == "train" else p[0]) for p in places if p[1] == c) if x is not None else []
            seen, kept = set(), []
            for m, p, station in each:
                if m <= radius and station not in seen and len(kept) < most:
                    seen.add(station)
                    kept.append(p)
            for n, p in enumerate(kept or [x[1] for x in each[:1]]):
                want[b, c, n + 1] = p
    got = {(x["block"], x["category"], x["rank"]): x["place"] for x in nearby.markers(B, P, "block").collect()}
    assert got == want


def test_top_within_against_a_plain_version(points):
    blocks, places, B, P = points
    want = {(b, n + 1): p for b, x, y in blocks if x is not None for n, (m, p) in enumerate(sorted((math.hypot(x - q[4], y - q[5]), q[0]) for q in places)[:6]) if m <= 700}
    got = {(x["block"], x["rank"]): x["place"] for x in spatial.top_within(B, P, 700.0, 6, "block", "place").collect()}
    assert got == want


def test_counts_against_a_plain_version(points):
    blocks, places, B, P = points
    for radius in (40.0, 700.0, 5000.0):
        want = {b: sum(math.hypot(x - p[4], y - p[5]) <= radius for p in places) if x is not None else 0 for b, x, y in blocks}
        assert {x["block"]: x["n"] for x in spatial.count_within(B, P, radius, "block", "place").collect()} == want


def test_dense_points_are_counted_by_cells(spark):
    """3,000 points that all lie well within the radius of each other."""
    dense = spark.range(3000).selectExpr("id AS l", "id % 7 * 1.0 AS x_m", "id % 11 * 1.0 AS y_m")
    got = spatial.count_within(dense, dense.withColumnRenamed("l", "r"), 1600.0, "l", "r")
    assert {x["n"] for x in got.select("n").distinct().collect()} == {3000}


def test_search_is_dealt_to_all_cores(spark):
    # 4,000 rows in few boxes weigh little, so that the pairs of all boxes lay in one task
    r = random.Random(11)
    rows = lambda n: spark.createDataFrame([(i, r.uniform(0, 9000), r.uniform(0, 9000)) for i in range(n)], "id long, x_m double, y_m double")
    near = spatial.nearest(rows(4000).withColumnRenamed("id", "a"), rows(300).withColumnRenamed("id", "b"), "a", "b")
    assert len([n for n in near.rdd.glom().map(len).collect() if n]) >= min(4, spark.sparkContext.defaultParallelism)


def test_counts_are_read_twice_for_all_totals(spark):
    from marketloom.operators import distribution as D

    counts = spark.createDataFrame([("x", dt.date(2020, 1, 1), t, f, float(i), 1) for i, (t, f) in enumerate([("a", "1"), ("a", "2"), ("b", "1")] * 5)], "measure string, month date, town string, flat_type string, value double, n long")
    bins = [int(r[0]) for r in counts.select(D.bin_of(counts["value"], 8)).distinct().collect()]
    wanted = spark.createDataFrame([(0, "x", dt.date(2020, 1, 1), "ALL", "1", b) for b in bins] + [(1, "x", dt.date(2020, 1, 1), "a", "2", b) for b in bins], "gid long, measure string, month date, town string, flat_type string, bin long")
    got = D.values_inside(counts, wanted, ["town", "flat_type"], True, 8)
    assert sorted((r["gid"], r["value"]) for r in got.collect()) == sorted([(0, float(i)) for i in range(15) if i % 3 != 1] + [(1, float(i)) for i in range(15) if i % 3 == 1])
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


SMALLEST = "/root/testdata/sf0.001"


def test_bands_and_shares_hold_no_group_whole(spark):
    from marketloom.plans import geography, queries

    for df in (queries.v_price_by_walk(spark, SMALLEST), geography.near_share(spark, SMALLEST)):
        assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_reports_make_the_monthly_table_once(spark, monkeypatch):
    from marketloom.operators import market
    from marketloom.plans import listings
    from marketloom.plans import reports as plans

    calls, prices = [], market.market_prices
    monkeypatch.setattr(market, "market_prices", lambda *a, **k: calls.append("prices") or prices(*a, **k))
    monkeypatch.setattr(market, "market_monthly", lambda *a, **k: pytest.fail("the whole monthly table is not needed"))
    for q in (plans.forecast_report, plans.comparison_outlook, listings.median_cross_check):
        calls.clear()
        q(spark, SMALLEST)
        assert calls == ["prices"]


def test_flags_are_counted_without_parsing_again(spark):
    from marketloom.operators import clean

    good = ("2020-01", "A", "4 ROOM", "1", "S", "01 TO 03", "90", "M", "1990", "69 years", "500000")
    bad = [{0: "2020/01"}, {1: " ", 10: "0"}, {5: "HIGH"}, {10: "n/a"}]
    rows = [good, *[tuple(b.get(i, x) for i, x in enumerate(good)) for b in bad]]
    flags = clean.clean(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in clean.RAW)), "2020-06-01")
    got = clean.by_reason(flags)
    assert {r["reason"]: r["rows"] for r in got.collect()} == {"unparseable_month": 1, "impossible_lease": 1, "missing_town": 1, "non_positive_price": 2, "unparseable_storey_range": 1}
    pulled = flags.withColumn("pulled", F.lit("2020-03-01").cast("date"))
    for df in (got, clean.last_complete_month(pulled, "pulled")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in plan if x.strip(" :+-").startswith("Filter") and "storey_range" in x]
    assert clean.last_complete_month(pulled, "pulled").collect()[0][0] == dt.date(2020, 1, 1)


def test_texts_are_read_by_one_pattern(spark):
    from marketloom.functions import parsing

    texts = ["61 years04 months", " 61 YEAR", "61", "61 4 month", "61 4", "61years 12 months", "1234", "61 months", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1)
    made = df.select(parsing.lease_years(F.col("x")))
    assert [r[0] and round(r[0], 6) for r in made.collect()] == [61.333333, 61.0, 61.0, 61.333333, None, None, None, None, None, None]
    assert "transform" not in made._jdf.queryExecution().optimizedPlan().toString()
    low = spark.createDataFrame([(x,) for x in ("10 to 12", "3TO1", "1 TO 2 TO 3", "HIGH", "100 TO 101", "0 TO 3", None)], "x string").coalesce(1)
    assert [r[0] and tuple(r[0]) for r in low.select(parsing.storeys(F.col("x"))).collect()] == [(10, 12, 11.0), None, None, None, None, None, None]


def test_households_are_dealt_to_all_cores(spark):
    from marketloom.operators import affordability

    # households are few bytes, so that all of them lay in one task
    homes = spark.range(400).coalesce(1).selectExpr("id AS household", "3000.0D + id AS income", "id * 20.0D AS savings")
    prices = spark.createDataFrame([(f"t{i}", 2e5 + 1e4 * (i * 7 % 10), 20) for i in range(10)], "town string, median_price double, transactions long")
    ranked = affordability.rank_towns(prices, homes)
    assert len([n for n in ranked.select("household").rdd.glom().map(len).collect() if n]) >= min(4, spark.sparkContext.defaultParallelism)
    assert [r["town"] for r in ranked.where("household = 7").orderBy("rank").collect()] == [f"t{i}" for i in sorted(range(10), key=lambda i: i * 7 % 10)]
    assert ranked.count() == 4000


def test_features_are_searched_side_by_side(points, monkeypatch):
    import threading

    B, P = points[2:]
    lines = B.sparkSession.createDataFrame([(1, "one", [[-500.0, 0.0], [500.0, 0.0]])], "line long, name string, points array<array<double>>")
    together = threading.Barrier(4)
    for name in ("nearest_of_kinds", "count_within", "nearest_line"):
        monkeypatch.setattr(spatial, name, lambda *a, _f=getattr(spatial, name), **k: together.wait(20) >= 0 and _f(*a, **k))
    assert nearby.features(B, P, lines, "block").count() == 152


def test_items_need_no_counts(spark, monkeypatch):
    from marketloom.plans import geography

    monkeypatch.setattr(spatial, "count_within", lambda *a, **k: pytest.fail("the list shows no counts"))
    assert not geography.nearby_items(spark, SMALLEST).isEmpty()


def test_nearest_blocks_searches_its_town_alone(spark, monkeypatch):
    from marketloom.plans import adapter, geography

    sizes, search = [], spatial.block_features
    monkeypatch.setattr(spatial, "block_features", lambda blocks, *a: sizes.append(blocks.count()) or search(blocks, *a))
    assert not geography.nearest_blocks(spark, SMALLEST).isEmpty()
    assert sizes == [adapter.table(spark, SMALLEST, "customer").where("c_nationkey = 7").count()]


def test_totals_and_months_are_made_of_cells(spark, monkeypatch):
    from marketloom.operators import market

    read = []
    for name in ("rollup", "month_rows"):
        monkeypatch.setattr(market, name, lambda df, *a, _f=getattr(market, name), **k: read.append(df.count()) or _f(df, *a, **k))
    first, second, last = dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 4, 1)
    rows = [(m, t, "x", float(i)) for m in (first, last) for t in "ab" for i in range(9)] + [(last, "a", "x", None), (second, None, "x", 1.0), (None, "a", "x", 1.0), (dt.date(2020, 5, 1), "a", "x", 1.0)]
    sales = spark.createDataFrame(rows, "month date, town string, flat_type string, price double")
    got = {(x["month"], x["town"], x["flat_type"]): (x["transactions"], x["median_price"]) for x in market.market_prices(sales, last).collect()}
    assert len(got) == 4 * 6 and got[second, "a", "x"] == (0, None)
    assert got[last, "a", "x"] == (10, 4.0) and got[last, "b", "ALL"] == (9, 4.0) and got[last, "ALL", "ALL"] == (19, 4.0)  # a sale without price counts as one
    assert max(read) <= 5  # two towns in two months, and the one without a town


def test_a_value_is_looked_up_once_for_all_totals(spark):
    from marketloom.operators import distribution as D

    day, keys = dt.date(2020, 1, 1), ["town", "flat_type"]
    rows = [("x", day, t, f, v) for t, f in (("a", "1"), ("a", "2"), ("b", "1")) for v in (10.0, 10.001, 50.0, -10.0, 0.0)]
    counts = spark.createDataFrame([(*x, 1) for x in rows], "measure string, month date, town string, flat_type string, value double, n long")
    cells = counts.groupBy("measure", "month", *keys, D.bin_of(F.col("value"), 8).alias("bin")).agg(F.sum("n").alias("n"))
    for finer in (1, 256):
        bin_ = lambda v: spark.range(1).select(D.bin_of(F.lit(v), 8 * finer)).first()[0]
        asked = [(0, "ALL", "ALL", 10.0), (1, "a", "ALL", 10.0), (2, "ALL", "1", -10.0), (3, "b", "1", 0.0), (4, "b", "2", 10.0)]
        wanted = spark.createDataFrame([(g, "x", day, t, f, bin_(v)) for g, t, f, v in asked], "gid long, measure string, month date, town string, flat_type string, bin long")
        met = {(x["town"], x["flat_type"], x["bin"]): sorted(x["gids"]) for x in D.wanted_cells(cells, wanted, keys, True, finer).collect()}
        assert met == {("a", "1", bin_(10.0)): [0, 1], ("a", "2", bin_(10.0)): [0, 1], ("b", "1", bin_(10.0)): [0], ("a", "1", bin_(-10.0)): [2], ("b", "1", bin_(-10.0)): [2], ("b", "1", bin_(0.0)): [3]}
        got = D.values_inside(counts, wanted, keys, True, 8 * finer, cells, finer)
        near = [10.0, 10.001] if bin_(10.0) == bin_(10.001) else [10.0]
        assert sorted((x["gid"], x["value"]) for x in got.collect()) == sorted([(0, v) for v in near * 3] + [(1, v) for v in near * 2] + [(2, -10.0)] * 2 + [(3, 0.0)])
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # no row is copied before it is looked up


def test_prices_are_read_from_columns(spark, monkeypatch):
    from marketloom.operators import market
    from marketloom.plans import adapter, queries
    from marketloom.sources.scratch import written

    empty = spark.createDataFrame([], "month date, v double")
    assert written(empty).schema == empty.schema and written(empty).count() == 0
    seen = []
    monkeypatch.setattr(market, "market_prices", lambda sales, last: seen.append(sales))
    queries.prices(spark, SMALLEST)
    assert sorted(seen[0].collect()) == sorted(adapter.sales(spark, SMALLEST).select("month", "town", "flat_type", "price").collect())
    assert "ReadSchema: struct<price:double>" in seen[0].select("price")._jdf.queryExecution().executedPlan().toString()
