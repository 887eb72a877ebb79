"""Exact quantiles, nearest-k joins, split readers, incremental tables and saved models against plain versions."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.config import Comparables, Quality
from marketloom.operators import artefact, clean, comparables, distribution, forecast, market, neighbours, pricing, reports, spatial
from marketloom.operators.distribution import Span, counted, every_month, only, quantiles, this_and_next
from marketloom.sources import readers, snapshots, tables

ALL = "ALL"


def months(n):
    return [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_quantiles_of_every_group(spark, monkeypatch, most):
    monkeypatch.setattr(distribution, "MOST_VALUES", most)
    monkeypatch.setattr(distribution, "MOST_WANTED", 400_000 if most > 3 else 0)
    r = random.Random(5)
    rows = [(r.choice(months(7)), r.choice("ab"), r.choice("xyz"), r.choice([r.uniform(-5, 5), r.gauss(1e5, 1e3), 0.0, -0.0, 7.0, 7.0, 1e-9, -3e12])) for _ in range(1500)]
    rows += [(months(7)[2], "a", "x", None), (months(7)[2], None, "x", 1.0), (None, "a", "x", 1.0), (months(9)[8], "c", "z", 4.0), (months(7)[1], "a", "y", float("nan"))]
    df = spark.createDataFrame(rows, "month date, town string, type string, v double").repartition(3)
    early = F.col("month") <= F.lit(months(3)[2])
    spans = {"one": Span("v", every_month(), (0.25, 0.5, 0.99)), "three": Span("v", this_and_next(3)), "early": Span("w", only(early), (0.1,))}
    counts = counted(df, ["town", "type"], {"v": F.col("v"), "w": 2 * F.col("v")})
    got = {(x["span"], x["label"], x["town"], x["type"]): (x["total"], x["q"]) for x in quantiles(counts, ["town", "type"], spans).collect()}
    p = pd.DataFrame(rows, columns=["month", "town", "type", "v"]).dropna(subset=["month", "town", "v"])
    want = {}
    for town in ("a", "b", "c", ALL):
        for type_ in ("x", "y", "z", ALL):
            s = p[((p.town == town) | (town == ALL)) & ((p.type == type_) | (type_ == ALL))]
            for i, m in enumerate(months(11)):
                for name, lows, probs in (("one", {m}, (0.25, 0.5, 0.99)), ("three", set(months(11)[max(0, i - 2) : i + 1]), (0.5,))):
                    v = s[s.month.isin(lows)].v
                    if len(v):
                        want[name, m, town, type_] = (len(v), [float(np.quantile(v, q)) for q in probs])
            v = s[s.month <= months(3)[2]].v * 2
            if len(v):
                want["early", None, town, type_] = (len(v), [float(np.quantile(v, 0.1))])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-9, abs=1e-12), k


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "month date, town string, v double")
    assert quantiles(counted(df, ["town"], {"v": F.col("v")}), ["town"], {"s": Span("v", every_month())}).count() == 0
    assert quantiles(counted(df, [], {"v": F.col("v")}), [], {"s": Span("v", every_month())}).count() == 0


def test_bins_never_fall(spark):
    r = random.Random(1)
    xs = sorted([0.0, 5e-324, 1e-300, 1.0, 2.0, 4.0, 1e300] + [r.uniform(-1, 1) * 10 ** r.uniform(-12, 12) for _ in range(3000)] + [2.0**k * (1 + e) for k in range(-20, 20) for e in (-1e-15, 0, 1e-15)] + [-8.0, -1e300])
    for bins in (32, 32 * 256, 32 * 256**3):
        got = [x["b"] for x in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select("x", distribution.bin_of(F.col("x"), bins).alias("b")).orderBy("x").collect()]
        assert got == sorted(got)


def test_robust_z(spark):
    r = random.Random(3)
    rows = [("a", r.gauss(5, 1)) for _ in range(101)] + [("b", 2.0)] * 7 + [("b", 9.0)] + [("c", None), (None, 1.0)] + [("d", float(i // 3)) for i in range(40)]
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)], "id int, g string, x double")
    got = {x["id"]: x for x in clean.robust_z(df.where("x is not null"), "x", ["g"], Quality(outlier_z=2.0, outlier_group=8)).collect()}
    for g in "abd":
        v = np.array([x for k, x in rows if k == g])
        m = np.median(v)
        mad = np.median(np.abs(v - m))
        for i, (k, x) in enumerate(rows):
            if k == g:
                z = 0.6745 * (x - m) / mad if mad else 0.0
                assert got[i]["robust_z"] == pytest.approx(z) and got[i]["group_size"] == len(v) and got[i]["is_outlier"] == (abs(z) > 2 and len(v) >= 8)
    assert len(got) == len(rows) - 2


def plain_nearest(left, right):
    """(id, x, y) each -> id: (distance, id), ties to the smaller id."""
    return {i: min((math.hypot(x - a, y - b), j) for j, a, b in right if a is not None) for i, x, y in left if None not in (x, y)}


@pytest.mark.parametrize("shape", ["even", "one_cell", "one_place", "dense_and_far"])
def test_nearest_whatever_the_density(spark, shape):
    r = random.Random(8)
    spread = {"even": 3e4, "one_cell": 1.0, "one_place": 0.0, "dense_and_far": 2.0}[shape]
    right = [(i, 100 + r.random() * spread, 200 + r.random() * spread) for i in range(400)] + [(900, None, 1.0)]
    left = [(i, 100 + r.random() * max(1, spread), 200 + r.random() * max(1, spread)) for i in range(150)] + [(500, 1.0, None)]
    if shape == "dense_and_far":
        right += [(950, 9e5, -9e5), (951, 9e5, -9e5)]
        left += [(300, 9e5 + 5, -9e5), (301, -7e5, 4e5), (302, 4e5, -4e5)]
    want = plain_nearest(left, right)
    L, R = spark.createDataFrame(left, "l long, x_m double, y_m double"), spark.createDataFrame(right, "r long, x_m double, y_m double")
    got = {x["l"]: (x["metres"], x["r"]) for x in spatial.nearest(L, R, "l", "r").collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0]) for i in want)


def test_cells_hold_few_candidates(spark):
    """A dense town costs its own points' neighbourhoods, not all pairs."""
    r = random.Random(2)
    pts = [(i, r.random() * 10, r.random() * 10) for i in range(2000)] + [(9000, 1e6, 1e6)]
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def metres(x, y, a, b):
        met.add(1)
        return math.hypot(x - a, y - b)

    L, R = spark.createDataFrame(pts, "l long, x double, y double"), spark.createDataFrame(pts, "r long, a double, b double")
    found = neighbours.nearest_k(L, R, "l", [("x", "a"), ("y", "b")], metres("x", "y", "a", "b"), ["r"], k=1, least_side=0.01)
    assert found.where("l <> r").count() == 0 and found.count() == len(pts)
    assert met.value < 100 * len(pts)  # all pairs would be 2,000 each


def plain_comparables(targets, sales, last, c, origin):
    out = {}
    for t in targets:
        each = []
        for s in sales:
            age = (last.year - s["month"].year) * 12 + last.month - s["month"].month
            if (s["town"], s["flat_type"]) != (t["town"], t["flat_type"]) or not 0 <= age < c.months or None in (s["area"], t["t_area"]):
                continue
            d = math.sqrt(((t["t_area"] - s["area"]) / c.area) ** 2 + ((t["t_storey"] - s["storey_mid"]) / c.storey) ** 2 + ((t["t_lease"] - s["lease_year"]) / c.lease) ** 2 + (age / c.recency) ** 2) + (0.25 if t["t_model"] != s["flat_model"] else 0)
            if origin and None not in (t["t_x"], s["x_m"]):
                d = math.hypot(d, math.hypot(t["t_x"] - s["x_m"], t["t_y"] - s["y_m"]) / c.metres)
            each.append((round(d, 9), age, s["sale_id"]))
        if each:
            out[t["target"]] = [x[2] for x in sorted(each)[: c.top]]
    return out


@pytest.mark.parametrize("origin", [False, True])
def test_comparables(spark, origin):
    r, c, last = random.Random(4), Comparables(), dt.date(2022, 6, 1)
    sales = []
    for i in range(900):
        hot = i % 3 == 0  # a third are the same flat, sold again and again
        sales.append(dict(sale_id=f"s{i:04}", month=months(30)[r.randrange(30)], town="t1" if hot else r.choice(["t1", "t2"]), flat_type="4", area=90.0 if hot else r.uniform(40, 150), storey_mid=5.0 if hot else float(r.randint(1, 40)),
                          lease_year=1990 if hot else r.randint(1970, 2015), flat_model="A" if hot else r.choice("AB"), price=1.0, x_m=r.choice([None, r.uniform(0, 9e3)]), y_m=r.uniform(0, 9e3)))
    sales.append(sales[1] | {"sale_id": "none", "area": None})
    targets = [dict(target=f"t{i}", town=r.choice(["t1", "t2", "t3"]), flat_type="4", t_area=r.choice([90.0, r.uniform(30, 200)]), t_storey=float(r.randint(1, 50)), t_lease=r.randint(1960, 2020), t_model=r.choice("ABC"), t_x=r.choice([None, r.uniform(0, 9e3)]), t_y=r.uniform(0, 9e3)) for i in range(60)]
    S = spark.createDataFrame([tuple(x.values()) for x in sales], "sale_id string, month date, town string, flat_type string, area double, storey_mid double, lease_year int, flat_model string, price double, x_m double, y_m double")
    T = spark.createDataFrame([tuple(x.values()) for x in targets], "target string, town string, flat_type string, t_area double, t_storey double, t_lease int, t_model string, t_x double, t_y double")
    if not origin:
        S, T = S.drop("x_m", "y_m"), T.drop("t_x", "t_y")
    got = {}
    for x in comparables.find_comparables(T, S, last, c).orderBy("target", "rank").collect():
        got.setdefault(x["target"], []).append(x["sale_id"])
    assert got == plain_comparables(targets, sales, last, c, origin)


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(9)
    docs = []
    for k in range(3):
        fs = []
        for i in range(200):
            odd = r.choice(["plain", 'a "quoted" {brace}', '{"type":"Feature"}', "\\", "日本 é", "}{", "features", 'x{"', ""])
            fs.append({"type": "Feature", "properties": {"NAME": odd, "N": i, "type": "x"}, "geometry": {"type": "Point", "coordinates": [round(r.uniform(103, 104), 6), 1.25]}} if i % 2 else {"geometry": {"coordinates": [[103.5, 1.5], [103.25, 1.25]], "type": "LineString"}, "properties": {"PARK": odd, "features": "none"}, "type": "Feature"})
        docs.append(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": fs}, ensure_ascii=bool(k), indent=k or None))
    for k, text in enumerate(docs):
        (tmp_path / f"d{k}.geojson").write_text(text)
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    rows = lambda df: sorted((sorted((x["properties"] or {}).items()), x["type"], json.dumps(json.loads(x["coordinates"]))) for x in df.collect())
    want = rows(readers.geojson(spark, str(tmp_path)))
    assert len(want) == 600
    for split in (50, 997, 10_000, 1 << 25):
        got = readers.geojson(spark, str(tmp_path), split_bytes=split)
        assert rows(got) == want
        if split == 10_000:
            assert got.rdd.getNumPartitions() > 8


def test_incremental_snapshots(spark, tmp_path):
    def snapshot(rows):
        return spark.createDataFrame(rows, "month date, town string, price double")

    def table():
        return sorted((str(x["month"]), x["town"], x["price"]) for x in spark.read.schema("town string, price double, month date").parquet(f"{tmp_path}/rows").collect())

    def files():
        return {p: p.stat().st_mtime_ns for p in tmp_path.glob("rows/*/*.parquet")}

    first = [(m, t, float(i)) for i, m in enumerate(months(6)) for t in "abc"] + [(months(6)[1], "a", 1.0), (None, "a", 1.0)]
    assert {x["month"]: (x["added"], x["removed"]) for x in snapshots.refresh(snapshot(first), str(tmp_path)).collect()} == {m: (3 + (m == months(6)[1]), 0) for m in months(6)} | {None: (1, 0)}
    before = files()
    assert snapshots.refresh(snapshot(first[::-1]), str(tmp_path)).count() == 0 and files() == before
    second = [x if x != (months(6)[2], "b", 2.0) else (months(6)[2], "b", 9.0) for x in first]
    assert [tuple(x) for x in snapshots.refresh(snapshot(second), str(tmp_path)).collect()] == [(months(6)[2], 1, 1)]
    same = lambda fs: {p: t for p, t in fs.items() if "2020-03" not in str(p)}
    assert same(files()) == same(before) and table() == sorted((str(m), t, p) for m, t, p in second)
    third = [x for x in second if x[0] != months(6)[4] and x[0] is not None][1:] + [(dt.date(2024, 1, 1), "z", 1.0)]
    got = {x["month"]: (x["added"], x["removed"]) for x in snapshots.refresh(snapshot(third), str(tmp_path)).collect()}
    assert got == {months(6)[0]: (0, 1), months(6)[4]: (0, 3), None: (0, 1), dt.date(2024, 1, 1): (1, 0)}
    assert table() == sorted((str(m), t, p) for m, t, p in third)


@pytest.fixture(scope="module")
def flats(spark):
    """Sales whose price follows the area, and falls where nothing is known of the way to the train."""
    r = random.Random(7)
    rows = []
    for i in range(1400):
        m, area, walk = months(24)[i % 24], r.uniform(50, 120), None if r.random() < 0.3 else r.uniform(100, 2000)
        rows.append((f"s{i}", m, r.choice("ab"), "4 ROOM" if i % 40 else "1 ROOM", "A", area, 5.0, 1990, float(i % 24), area * 100 * (0.5 if walk is None else 1.0), 100 * (0.5 if walk is None else 1.0), walk, i % 50 != 0))
    df = spark.createDataFrame(rows, "sale_id string, month date, town string, flat_type string, flat_model string, area double, storey_mid double, lease_year int, months_since_start double, price double, psm double, mrt_m double, is_valid boolean")
    index = spark.createDataFrame([(m, 100.0) for m in months(25)], "month date, market_index_psm double")
    return df, index


def test_excluded_sales_are_not_modelled(flats):
    df, index = flats
    frame = pricing.modelling_frame(df, index)
    assert frame.columns == [*df.columns[1:2], df.columns[0], *df.columns[2:], "market_index_psm", "target"]
    assert frame.count() == df.where("is_valid and flat_type <> '1 ROOM'").count() < df.count()
    plain = pricing.modelling_frame(df.drop("is_valid"), index)
    assert "is_valid" not in plain.columns and plain.count() == df.where("flat_type <> '1 ROOM'").count()


def test_a_missing_number_alone_predicts(flats):
    df, index = flats
    frame = pricing.modelling_frame(df.withColumn("mrt_m", F.when(F.col("mrt_m").isNotNull(), F.lit(700.0))), index)  # only whether it is missing tells anything
    model = pricing.boosting([*pricing.NUMERIC, "mrt_m"], trees=8, gaps=("mrt_m",)).fit(frame)
    off = pricing.predict(model, frame).agg(F.avg(F.abs(F.col("predicted") / F.col("price") - 1))).first()[0]
    assert off < 0.1


def test_a_saved_model_scores_as_the_fitted_one(spark, flats, tmp_path):
    df, index = flats
    frame, last, folder = pricing.modelling_frame(df, index).cache(), months(24)[-1], str(tmp_path)
    with pytest.raises(ValueError):
        artefact.load(spark, folder)
    assert [artefact.publish(frame, index, last, ["mrt_m"], folder, trees=3) for _ in range(2)] == [1, 2]
    m = artefact.load(spark, folder)
    assert (m.version, m.location, m.trained_to, m.rows) == (2, ["mrt_m"], last, frame.count()) and artefact.versions(spark, folder) == [1, 2]
    assert m.comparison.count() == 4 and pricing.selected(m.comparison) == m.name and m.ranges.where("flat_type = 'ALL'").count() == 1
    again = pricing.candidates(["mrt_m"], m.rows, 3)[m.name].fit(frame)  # fitted on all sales, not on the training part
    both = pricing.predict(m.model, frame).select("sale_id", "predicted").join(pricing.predict(again, frame).select("sale_id", F.col("predicted").alias("p")), "sale_id")
    assert both.where(F.abs(F.col("predicted") / F.col("p") - 1) > 1e-9).count() == 0
    unseen = frame.limit(5).withColumn("town", F.lit("never seen")).withColumn("flat_model", F.lit("new"))
    assert pricing.predict(m.model, unseen).where("predicted > 0").count() == 5
    (tmp_path / "v2/facts/_SUCCESS").unlink()  # a version that was never finished
    assert artefact.load(spark, folder).version == 1


def test_market_tables_by_counts(spark):
    r = random.Random(6)
    rows = [(r.choice(months(20)), r.choice(["a", "b"]), r.choice(["x", "y"]), float(r.randint(1, 30)), float(r.randint(1, 9)), 5.0) for _ in range(700)]
    sales = spark.createDataFrame(rows, "month date, town string, flat_type string, price double, psm double, area double")
    p = pd.DataFrame(rows, columns=["month", "town", "flat_type", "price", "psm", "area"])
    got = market.pooled_median(sales, 3).toPandas()
    for x in got.sample(60, random_state=1).itertuples():
        near = [m for m in months(30) if 0 <= (x.month.year - m.year) * 12 + x.month.month - m.month < 3]
        s = p[p.month.isin(near) & ((p.town == x.town) | (x.town == ALL)) & ((p.flat_type == x.flat_type) | (x.flat_type == ALL))]
        assert (x.pooled_median, x.pooled_count) == (s.price.median(), len(s))
    assert (got.groupby(["month", "town", "flat_type"]).size() == 1).all()


def test_all_methods_are_judged_alike(spark):
    r = random.Random(11)
    rows = [(m, t, k, 300.0 + 5 * i + 40 * (k == "y") + r.uniform(-9, 9)) for i, m in enumerate(months(48)) for t in "ab" for k in "xy" for _ in range(8)]
    sales, last = spark.createDataFrame(rows, "month date, town string, flat_type string, price double"), months(48)[-1]
    table = market.market_prices(sales, last)
    assert table.count() == 9 * 48 and table.where("transactions = 0").count() == 0
    features = forecast.feature_rows(forecast.series_features(table)).cache()
    predictions = forecast.boosted(features, last, trees=2).cache()
    methods = (*forecast.METHODS, "boosted")
    long = forecast.errors(forecast.with_boosted(forecast.backtest_rows(features, last), predictions), methods)
    compared = {x["method"]: x for x in forecast.compared(forecast.scorecard(long)).collect()}
    assert set(compared) == set(methods) and len({x["n"] for x in compared.values()}) == 1 and sum(x["selected"] for x in compared.values()) == 1
    assert compared["trend_24m"]["selected"]  # prices climb in a line
    ranks = reports.method_ranking(forecast.scorecard(long)).where("horizon = 0").orderBy("rank").collect()
    assert [x["rank"] for x in ranks] == [1, 2, 3, 4] and ranks[0]["method"] == "trend_24m" and [x["mape"] for x in ranks] == sorted(x["mape"] for x in ranks)
    # a backtest in which the trees alone are right selects them, and they are published
    best = long.withColumn("ape", F.when(F.col("method") == "boosted", F.lit(0.0)).otherwise(F.col("ape")))
    out = forecast.published(features, best, last, methods, predictions)
    got = {(x["town"], x["flat_type"], x["horizon"]): (x["method"], x["forecast"]) for x in out.collect()}
    want = {(x["town"], x["flat_type"], x["horizon"]): ("boosted", round(math.exp(x["boosted"]) / 1000) * 1000.0) for x in predictions.where(F.col("origin_month") == F.lit(last)).collect()}
    assert got == want and len(got) == 9 * 6


def test_outlook_of_towns(spark):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "group int, town string")
    published = spark.createDataFrame([("a", "ALL", h, months(50)[40 + h], 100.0, 100.0 + h, float(h), "up", False) for h in (1, 6)] + [("b", "x", 6, months(50)[46], 1.0, 1.0, 0.0, "stable", True)], "town string, flat_type string, horizon int, target_month date, recent double, forecast double, change_pct double, direction string, uncertain boolean")
    monthly = spark.createDataFrame([(m, "a", "ALL", 9 if i % 2 else 1, float(i)) for i, m in enumerate(months(41))] + [(months(41)[-1], "b", "x", 9, 1.0)], "month date, town string, flat_type string, transactions int, median_price double")
    got = {x["town"]: x for x in reports.comparison_outlook(groups, published, monthly, months(41)[-1], months=12).collect()}
    assert (got["a"]["target_month"], got["a"]["forecast"], got["a"]["direction"]) == (months(50)[46], 106.0, "up")
    assert [x["price"] for x in got["a"]["series"]] == [float(i) if i % 2 else None for i in range(29, 41)]
    assert got["b"]["forecast"] is None and got["b"]["series"] == got["c"]["series"] == []


def test_notes_of_a_table_are_read_back(spark):
    spark.sql("DROP TABLE IF EXISTS gold_notes")
    tables.write_table(spark.range(3), "gold_notes")
    assert tables.table_facts(spark, "gold_notes") == {}
    tables.describe_table(spark, "gold_notes", "it's a \\ test", "range")
    assert tables.table_facts(spark, "gold_notes") == {"comment": "it's a \\ test", "layer": "gold", "source": "range"}
    spark.sql("DROP TABLE gold_notes")


def test_facets_are_validated(spark):
    df = spark.createDataFrame([("a",), ("b",)], "town string")
    assert market.validate_facet(df, "town", "a") == "a" and market.validate_facet(df, "town", ALL) == ALL
    with pytest.raises(ValueError):
        market.validate_facet(df, "town", "z")


def test_the_first_page_of_a_record_counts(spark, tmp_path):
    for page, records in (("p1", [(2, "two"), (1, "one")]), ("p2", [(1, "late"), (3, "three"), (3, "again")])):
        (tmp_path / f"{page}.json").write_text(json.dumps({"records": [{"_id": i, "name": n} for i, n in records]}))
    assert [x["name"] for x in readers.paged_records(spark, str(tmp_path), "name: string").collect()] == ["one", "two", "three"]


def test_missing_buildings_take_their_streets_place(spark):
    """Every outline of the registered query is there; here one home's is not."""
    from marketloom.operators import matching

    home = spark.createDataFrame([("t", b, "ABC ST") for b in ("1", "2", "3")], "town string, block string, street_name string")
    built = spark.createDataFrame([(b, "ABS0", float(b), 100.0) for b in ("1", "2")], "block string, street_code string, latitude double, longitude double")
    got = {x["block"]: x["location_source"] for x in matching.match_addresses(home, built).collect()}
    assert got["1"] == got["2"] == "building" and got["3"] in ("street", "town")
