"""Searches that follow the coordinates that spread, and price models that are fitted on compact rows."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marketloom.config import Comparables
from marketloom.operators import comparables, pricing


def test_comparables_of_far_places_are_not_compared(spark, monkeypatch):
    """Flats alike in area, storey and lease, but kilometres apart, meet the sales around them, not all of their town."""
    r, met, search = random.Random(6), spark.sparkContext.accumulator(0), comparables.nearest_k

    @F.udf("double")
    def counted(d):
        met.add(1)
        return d

    monkeypatch.setattr(comparables, "nearest_k", lambda t, s, i, coords, d, *a, **k: search(t, s, i, coords, counted(d), *a, **k))
    sales = [(f"s{i:04}", dt.date(2022, 6, 1), "t", "4", 90.0 + i % 3, 5.0, 1990, "A", 1.0, None if i % 500 == 0 else r.uniform(0, 3e4), r.uniform(0, 3e4)) for i in range(2000)]
    targets = [(f"t{i}", "t", "4", 91.0, 5.0, 1990, "A", None if i == 0 else r.uniform(0, 3e4), r.uniform(0, 3e4)) for i in range(200)]
    S = spark.createDataFrame(sales, "sale_id string, month date, town string, flat_type string, area double, storey_mid double, lease_year int, flat_model string, price double, x_m double, y_m double")
    T = spark.createDataFrame(targets, "target string, town string, flat_type string, t_area double, t_storey double, t_lease int, t_model string, t_x double, t_y double")
    c, got = Comparables(), {}
    for x in comparables.find_comparables(T, S, dt.date(2022, 6, 1), c).orderBy("target", "rank").collect():
        got.setdefault(x["target"], []).append(x["sale_id"])
    for t in targets:
        apart = lambda s: 0.0 if None in (t[7], s[9]) else ((t[7] - s[9]) ** 2 + (t[8] - s[10]) ** 2) / c.metres**2
        assert got[t[0]] == [i for _, i in sorted((round((((t[3] - s[4]) / c.area) ** 2 + apart(s)) ** 0.5, 9), s[0]) for s in sales)[: c.top]]
    assert met.value < 0.5 * len(targets) * len(sales)


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(9)
    rows = []
    for i in range(1500):
        area, walk = r.uniform(50, 120), None if r.random() < 0.2 else r.uniform(100, 2000)
        rows.append((f"s{i:04}", dt.date(2021 + i % 24 // 12, i % 12 + 1, 1), r.choice("abc"), r.choice("45"), "A" if i % 700 else "rare", area, float(r.randint(1, 40)), r.randint(1970, 2010), float(i % 24), area * r.uniform(90, 110) * (1 if walk else 0.8), 100.0, walk))
    df = spark.createDataFrame(rows, "sale_id string, month date, town string, flat_type string, flat_model string, area double, storey_mid double, lease_year int, months_since_start double, price double, psm double, mrt_m double")
    return df.withColumns({"market_index_psm": F.lit(100.0), "target": F.ln(F.col("price") / 100)}).cache()


def test_ridge_of_sums_is_that_of_all_rows(frame):
    numeric, n = [*pricing.NUMERIC, "mrt_m"], frame.count()
    plain = Pipeline(stages=[
        StringIndexer(inputCols=pricing.CATEGORIES, outputCols=[f"{c}_i" for c in pricing.CATEGORIES], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in pricing.CATEGORIES], outputCols=[f"{c}_v" for c in pricing.CATEGORIES]),
        Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median"), VectorAssembler(inputCols=[f"{c}_f" for c in numeric], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PolynomialExpansion(degree=2, inputCol="scaled", outputCol="poly"),
        VectorAssembler(inputCols=[f"{c}_v" for c in pricing.CATEGORIES] + ["poly"], outputCol="features"), LinearRegression(labelCol="target", regParam=1 / n, elasticNetParam=0.0, standardization=False),
    ]).fit(frame)
    model = pricing.candidates(["mrt_m"], n, 3)["ridge"].fit(frame)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), rel=1e-6, abs=1e-9)
    assert model.stages[-1].intercept == pytest.approx(plain.stages[-1].intercept)
    assert model.stages[-1].summary.numInstances < n  # Spark's regression saw few rows


def test_importance_is_scored_by_several_tasks(frame):
    class Model:
        def transform(self, rows):
            self.parts = rows.rdd.getNumPartitions()
            return rows.withColumn("prediction", F.when(F.col("area") > 85, -1.0).otherwise(0.0))

    model = Model()
    got = {x["feature"]: x["share_pct"] for x in pricing.permutation_importance(model, frame.withColumn("target", F.when(F.col("area") > 85, -1.0).otherwise(0.0)), ["area", "storey_mid", "town"], sample=400).collect()}
    assert model.parts > 1 and got == {"area": 100.0, "storey_mid": 0.0, "town": 0.0}
