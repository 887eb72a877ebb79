"""Registered queries of composite reports and fitted price models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import numbers
from marketloom.operators import artefact, comparables, forecast, market, nearby, pricing, reports
from marketloom.plans import adapter as a
from marketloom.plans.geography import GEO, LOCATED, TYPICAL, located, typical
from marketloom.plans.queries import (
    _EV, _IN, ASSESS, EVENT, FOLDS, MONTHLY, PUBLISHED, REFERENCE_TYPE, SALES, SUMMARY, TIERS, _duty, backtest, kpis_sql, outlook, prices, query, rounded, town_summary,
)
from marketloom.sources.scratch import shared_folder, stored, written

_KPIS = ("median_3m", "median_prev3m", "median_3m_year_ago", "median_psm", "sales_3m", "sales_prev3m", "sales_3m_year_ago", "sales_12m", "sales_prev12m", "quarter_pct", "year_pct", "volume_pct")
_STUDY = (*[f"{x}_{n}" for n in _EV for x in ("median", "sales")], "change_pct", "trend_pct")


def _melt(section: str, item: str, columns: tuple[str, ...], source: str) -> str:
    """SQL for the rows that ``reports.measures`` makes."""
    cast = ", ".join(f'"{c}"::DOUBLE AS "{c}"' for c in columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT '{section}' AS section, item, measure, floor(value * 1e4 + 0.50001) / 1e4 AS value FROM (UNPIVOT (SELECT {item} AS item, {cast} FROM ({source}) src) ON {names} INTO NAME measure VALUE value)"


_SERIES = """SELECT g.month, coalesce(n, 0) AS sales, CASE WHEN n >= 5 THEN m END AS median_price, CASE WHEN n >= 5 THEN q1 END AS p25, CASE WHEN n >= 5 THEN q3 END AS p75
 FROM (SELECT unnest(generate_series((SELECT min(month) FROM shown)::TIMESTAMP, (SELECT last FROM ends)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) g LEFT JOIN (SELECT month, count(*) AS n, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM shown GROUP BY month) USING (month)"""
_BINS = """SELECT lo + b * step AS low, coalesce(n, 0) AS count FROM (SELECT lo, step, unnest(range(0, greatest(1, ceil((hi - lo) / step))::BIGINT)) AS b FROM hist) LEFT JOIN (SELECT floor((least(greatest(price, lo), hi - 1e-9) - lo) / step)::BIGINT AS b, count(*) AS n FROM shown, hist, ends WHERE """ + _IN["12m"] + """ GROUP BY 1) USING (b)"""
_RANK = f"""SELECT town, median_psm, median_price, sales, round_even((median_price / old - 1) * 100, 4) AS yoy_pct FROM (SELECT town, quantile_cont(psm, 0.5) FILTER (WHERE {_IN['12m']}) AS median_psm, quantile_cont(price, 0.5) FILTER (WHERE {_IN['12m']}) AS median_price, count(*) FILTER (WHERE {_IN['12m']}) AS sales, quantile_cont(price, 0.5) FILTER (WHERE {_IN['prev12m']}) AS old FROM base, ends GROUP BY town) WHERE sales >= 10"""
_EVENT = f"""SELECT *, CASE WHEN sales_before >= 20 AND sales_after >= 20 THEN round_even((median_after / median_before - 1) * 100, 4) END AS change_pct, CASE WHEN sales_before >= 20 AND sales_earlier >= 20 THEN round_even((median_before / median_earlier - 1) * 100, 4) END AS trend_pct
 FROM (SELECT {', '.join(f'quantile_cont(price, 0.5) FILTER (WHERE {w}) AS median_{n}, count(*) FILTER (WHERE {w}) AS sales_{n}' for n, w in _EV.items())} FROM own, ends) WHERE sales_before >= 20 AND sales_after >= 20"""


@query(" UNION ALL ".join((
    _melt("kpis", "''", _KPIS, kpis_sql("own")), _melt("series", "strftime(month, '%Y-%m')", ("sales", "median_price", "p25", "p75"), _SERIES), _melt("distribution", "low::BIGINT::VARCHAR", ("count",), _BINS),
    _melt("ranking", "town", ("median_psm", "median_price", "sales", "yoy_pct"), _RANK), _melt("event", f"'{EVENT}'", _STUDY, _EVENT),
)), (SALES, "base AS (SELECT sales.* FROM sales, ends WHERE storey_mid BETWEEN 1 AND 25 AND month <= last)", "own AS (SELECT * FROM base WHERE town = 'NATION_3')", "shown AS (SELECT * FROM own WHERE year(month) >= 1999)",
     f"hist0 AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS z FROM shown, ends WHERE {_IN['12m']})", "hist AS (SELECT s AS step, floor(a / s) * s AS lo, ceil(z / s) * s AS hi FROM (SELECT a, z, CASE WHEN z - a < 20000 THEN 500.0::DOUBLE ELSE 5000.0::DOUBLE END AS s FROM hist0))"))
def market_report(spark: SparkSession, d: str) -> DataFrame:
    s = stored(a.sales(spark, d).select("month", "town", "flat_type", "storey_mid", "price", "psm"))
    return rounded(reports.market_report(s, a.last_month(spark, d), EVENT, town="NATION_3", year_from=1999, histogram=(500.0, 5000.0, 20_000.0), storey_mid=(1, 25)))


def _best(section: str, value: str, order: str, n: int, where: str) -> str:
    columns = ("median_12m", "median_psm_12m", "sales_12m", "yoy_pct", "five_year_pct")
    return _melt(section, "town", columns, f"""SELECT * FROM summary WHERE town <> 'ALL' AND flat_type = 'ALL' AND {where} ORDER BY "{value}" {order}, town LIMIT {n}""")


@query(" UNION ALL ".join((
    _melt("kpis", "''", _KPIS, kpis_sql("sales")), _melt("year_to_date", "''", ("this_year", "last_year"), "SELECT count(*) FILTER (WHERE year(month) = year(last) AND month(month) <= month(last)) AS this_year, count(*) FILTER (WHERE year(month) = year(last) - 1 AND month(month) <= month(last)) AS last_year FROM sales, ends"),
    _best("dearest", "median_12m", "DESC", 5, '"sales_12m" >= 50'), _best("cheapest", "median_12m", "ASC", 5, '"sales_12m" >= 50'), _best("rising", "yoy_pct", "DESC", 3, '"sales_12m" >= 100 AND yoy_pct IS NOT NULL'), _best("falling", "yoy_pct", "ASC", 3, '"sales_12m" >= 100 AND yoy_pct IS NOT NULL'),
)), (SALES, SUMMARY))
def overview_report(spark: SparkSession, d: str) -> DataFrame:
    """Over all types, since no single type of these data has a hundred sales a year in a town."""
    s, last = stored(a.sales(spark, d).select("month", "town", "flat_type", "price", "psm")), a.last_month(spark, d)
    return rounded(reports.overview_report(s, stored(town_summary_of(s, last)), last, "ALL"))


def town_summary_of(sales: DataFrame, last) -> DataFrame:
    return rounded(market.town_summary(sales, last))


_HOMES = """homes AS (SELECT c_custkey AS household, CASE WHEN c_custkey % 11 = 0 THEN 'ALL' ELSE n_name END AS town, list_extract(['SMALL', 'MEDIUM', 'LARGE'], (c_custkey % 3 + 1)::BIGINT) AS flat_type, 3000.0::DOUBLE + abs(c_acctbal) AS income, abs(c_acctbal) * 20 AS cash, CASE WHEN c_custkey % 4 = 0 THEN 250000.0::DOUBLE + c_custkey ELSE 0 END AS own_price, CASE WHEN c_custkey % 5 = 0 THEN 1200.0::DOUBLE ELSE 0 END AS own_limit FROM customer JOIN nation ON c_nationkey = n_nationkey),
tens AS (SELECT town, flat_type, "median_12m" * 10 AS median_12m, "sales_12m" AS sales_12m FROM summary),
buyers AS (SELECT h.*, CASE WHEN own_price > 0 THEN own_price ELSE median_12m END AS price, CASE WHEN own_price > 0 THEN 'own' WHEN median_12m IS NOT NULL THEN 'median' ELSE 'none' END AS price_source FROM homes h LEFT JOIN tens USING (town, flat_type))"""
_CAP = "CASE WHEN own_limit > 0 THEN least(income * 0.3::DOUBLE, own_limit) ELSE income * 0.3::DOUBLE END"
_REACH = f"""reach0 AS (SELECT household, income, greatest(cash, 0) AS c, {_CAP} AS cap, median_12m AS p, {_duty('median_12m')} AS duty FROM homes JOIN tens USING (flat_type) WHERE tens.town <> 'ALL' AND sales_12m >= 5 AND median_12m IS NOT NULL),
reach1 AS (SELECT *, p * (1 - 0.75::DOUBLE) + duty AS upfront, p - p * 0.75::DOUBLE + duty AS up FROM reach0), reach2 AS (SELECT *, greatest(p * 0.75::DOUBLE - greatest(c - up, 0), 0) AS borrowed FROM reach1),
reach AS (SELECT household, count(*) FILTER (WHERE round_even(CASE WHEN borrowed <= 0 THEN 0 ELSE borrowed * (0.026::DOUBLE / 12) / (1 - power(1 + 0.026::DOUBLE / 12, -300)) END, 0) <= cap AND round_even(greatest(up - c, 0), 0) = 0) AS within_reach FROM reach2 GROUP BY household)"""


@query(f"""SELECT household, price_source, floor(price * 1e4 + 0.50001) / 1e4 AS price, round_even(borrowed, 0) AS loan, round_even(monthly, 0) AS monthly_repayment, round_even(ratio, 4) AS repayment_ratio, round_even((income - 9000) * 100 / 9000, 1) AS income_vs_benchmark_pct, coalesce(within_reach, 0) AS within_reach, round_even({_CAP}, 0) AS repayment_cap FROM assessed LEFT JOIN reach USING (household)""", (SALES, SUMMARY, _HOMES, ASSESS, _REACH))
def affordability_report(spark: SparkSession, d: str) -> DataFrame:
    summary = town_summary(spark, d).withColumn("median_12m", F.col("median_12m") * 10)
    k = F.col("c_custkey")
    homes = a.table(spark, d, "customer").join(a.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("household"), F.when(k % 11 == 0, "ALL").otherwise(F.col("n_name")).alias("town"), F.element_at(F.array(F.lit("SMALL"), F.lit("MEDIUM"), F.lit("LARGE")), (k % 3 + 1).cast("int")).alias("flat_type"), (F.lit(3000.0) + F.abs("c_acctbal")).alias("income"), (F.abs("c_acctbal") * 20).alias("savings"),
        F.when(k % 4 == 0, F.lit(250_000.0) + k).otherwise(F.lit(0.0)).alias("own_price"), F.when(k % 5 == 0, F.lit(1200.0)).otherwise(F.lit(0.0)).alias("own_limit"))
    income = a.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.lit(9000.0).alias("income"))
    out = reports.affordability_report(homes, summary, income, least=5)
    return rounded(out.select("household", "price_source", "price", "loan", "monthly_repayment", "repayment_ratio", "income_vs_benchmark_pct", "within_reach", F.col("budget.repayment_cap").alias("repayment_cap")))


_WANTED = "wanted AS (SELECT n_name AS town, t AS flat_type FROM nation, unnest(['ALL', 'SMALL', 'NONE']) u(t))"


@query("""SELECT town, flat_type, 'history' AS part, month, CASE WHEN transactions >= 5 THEN floor(median_price * 1e4 + 0.50001) / 1e4 END AS price, NULL AS lower, NULL AS upper FROM monthly0 SEMI JOIN published USING (town, flat_type) SEMI JOIN wanted USING (town, flat_type) WHERE month > (SELECT last FROM ends) - to_months(48)
 UNION ALL SELECT town, flat_type, 'forecast', target_month, forecast, lower, upper FROM published SEMI JOIN wanted USING (town, flat_type) UNION ALL SELECT town, flat_type, 'unavailable', NULL, NULL, NULL, NULL FROM wanted ANTI JOIN published USING (town, flat_type)""", (SALES, MONTHLY, FOLDS, TIERS, PUBLISHED, _WANTED))
def forecast_report(spark: SparkSession, d: str) -> DataFrame:
    wanted = a.table(spark, d, "nation").select(F.col("n_name").alias("town"), F.explode(F.array(*[F.lit(t) for t in ("ALL", "SMALL", "NONE")])).alias("flat_type"))
    by_month = stored(prices(spark, d))
    out = reports.forecast_report(wanted, stored(outlook(spark, d, by_month)), by_month, a.last_month(spark, d))
    return rounded(out.select("town", "flat_type", "part", "month", "price", "lower", "upper"))


@query("SELECT town, array_to_string(list_sort(list(DISTINCT flat_type)), ', ') AS flat_types FROM published GROUP BY town", (SALES, MONTHLY, FOLDS, TIERS, PUBLISHED))
def forecast_types(spark: SparkSession, d: str) -> DataFrame:
    return reports.forecast_types(outlook(spark, d)).withColumn("flat_types", F.array_join("flat_types", ", "))


_CARDS = """buyers AS (SELECT town, "median_12m" * 10 AS price, 9000.0::DOUBLE AS income, 20000.0::DOUBLE AS cash FROM summary WHERE flat_type = 'ALL' AND town <> 'ALL' AND "median_12m" IS NOT NULL)""", ASSESS, """cards AS (SELECT s.town, s."median_12m" AS median_price, five_year_pct, round_even(ratio, 4) AS repayment_ratio, greatest(1, ceil(train_m * 1.3 / 80)) AS train_minutes FROM summary s LEFT JOIN assessed USING (town) LEFT JOIN (SELECT town, train_m FROM typical WHERE flat_type = 'ALL') USING (town) WHERE s.flat_type = 'ALL' AND s.town <> 'ALL'),
grouped AS (SELECT (n_nationkey % 9)::BIGINT AS g, n_name AS town FROM nation)"""


@query("""SELECT g AS "group", count(*) AS towns, arg_min(c.town, (median_price, c.town)) AS cheapest, CASE WHEN count(*) >= 2 THEN round(max(median_price) - min(median_price), 4) END AS gap, CASE WHEN count(five_year_pct) >= 2 THEN arg_min(c.town, (-five_year_pct, c.town)) FILTER (WHERE five_year_pct IS NOT NULL) END AS fastest,
 CASE WHEN count(repayment_ratio) = count(*) AND count(*) >= 2 THEN arg_min(c.town, (repayment_ratio, c.town)) END AS easiest, CASE WHEN count(train_minutes) = count(*) AND min(train_minutes) < max(train_minutes) THEN arg_min(c.town, (train_minutes, c.town)) END AS nearest_train FROM grouped JOIN cards c USING (town) WHERE median_price IS NOT NULL GROUP BY g""", (SALES, SUMMARY, GEO, LOCATED, TYPICAL, *_CARDS))
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    """Nations compared in groups of up to three."""
    from marketloom.operators import affordability

    s = town_summary(spark, d).where("flat_type = 'ALL' and town <> 'ALL'").select("town", F.col("median_12m").alias("median_price"), "five_year_pct")
    paid = affordability.assess(s, F.col("median_price") * 10, F.lit(9000.0), F.lit(20_000.0)).select("town", "median_price", "five_year_pct", "repayment_ratio")
    access = typical(spark, d).where("flat_type = 'ALL'").select("town", numbers.walk_minutes(F.col("train_m")).alias("train_minutes"))
    groups = a.table(spark, d, "nation").select((F.col("n_nationkey") % 9).cast("long").alias("group"), F.col("n_name").alias("town"))
    return rounded(reports.comparison(groups, paid.join(access, "town", "left")))


@query("SELECT horizon, row_number() OVER (PARTITION BY horizon ORDER BY mape, method) AS rank, method, round(mape, 4) AS mape, n FROM (SELECT method, CASE WHEN grouping(horizon) = 1 THEN 0 ELSE horizon END AS horizon, count(*) AS n, avg(ape) AS mape FROM errs GROUP BY GROUPING SETS ((method), (method, horizon)))", (SALES, MONTHLY, FOLDS))
def method_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.method_ranking(forecast.scorecard(backtest(spark, d))).withColumn("rank", F.col("rank").cast("long")))


@query("""SELECT (n_nationkey % 9)::BIGINT AS "group", n_name AS town, target_month, recent, forecast, round_even((forecast / recent - 1) * 100, 2) AS change_pct, CASE WHEN abs((forecast / recent - 1) * 100) < 1.5 THEN 'stable' WHEN forecast > recent THEN 'up' WHEN forecast < recent THEN 'down' END AS direction, coalesce(months, 0) AS months, coalesce(known, 0) AS known, floor(mean_price * 1e3 + 0.50001) / 1e3 AS mean_price
 FROM nation LEFT JOIN (SELECT * FROM published WHERE flat_type = 'ALL' AND horizon = 6) p ON p.town = n_name LEFT JOIN (SELECT town, count(*) AS months, count(*) FILTER (WHERE transactions >= 5) AS known, avg(median_price) FILTER (WHERE transactions >= 5) AS mean_price FROM monthly0 WHERE flat_type = 'ALL' AND month > (SELECT last FROM ends) - to_months(60) GROUP BY town) m ON m.town = n_name""", (SALES, MONTHLY, FOLDS, TIERS, PUBLISHED))
def comparison_outlook(spark: SparkSession, d: str) -> DataFrame:
    """The outlook of every nation in its group of up to three, and what its last 60 months hold."""
    groups = a.table(spark, d, "nation").select((F.col("n_nationkey") % 9).cast("long").alias("group"), F.col("n_name").alias("town"))
    by_month = stored(prices(spark, d))
    out = reports.comparison_outlook(groups, outlook(spark, d, by_month), by_month, a.last_month(spark, d))
    known = F.filter("series", lambda x: x["price"].isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x["price"]) / F.when(F.size(known) > 0, F.size(known))
    return out.select("group", "town", "target_month", "recent", "forecast", "change_pct", "direction", F.size("series").cast("long").alias("months"), F.size(known).cast("long").alias("known"), (F.floor(mean * 1e3 + 0.50001) / 1e3).alias("mean_price"))


@query("""SELECT block, flat_type, greatest(1, round_even(99 - (year(nx) + (month(nx) - 1) / 12 - newest), 0))::DOUBLE AS lease_left, round_even(area, 0) AS area, flat_model, coalesce(n, 0) AS sales_of_type FROM (SELECT DISTINCT block, t AS flat_type FROM sales, unnest(['SMALL', 'LARGE']) u(t)) LEFT JOIN (SELECT block, max(lease_year) FILTER (WHERE month = top) AS newest FROM (SELECT *, max(month) OVER (PARTITION BY block) AS top FROM sales) GROUP BY block) USING (block)
 LEFT JOIN (SELECT block, flat_type, quantile_cont(area, 0.5) AS area, count(*) AS n FROM sales GROUP BY ALL) USING (block, flat_type) LEFT JOIN (SELECT block, flat_type, arg_min(flat_model, (-k, flat_model)) AS flat_model FROM (SELECT block, flat_type, flat_model, count(*) AS k FROM sales GROUP BY ALL) GROUP BY ALL) USING (block, flat_type), (SELECT (last + INTERVAL 1 MONTH)::DATE AS nx FROM ends)""", (SALES,))
def block_prefill(spark: SparkSession, d: str) -> DataFrame:
    s = stored(a.sales(spark, d).select("block", "month", "flat_type", "flat_model", "area", "lease_year"))
    wanted = s.select("block").distinct().withColumn("flat_type", F.explode(F.array(F.lit("SMALL"), F.lit("LARGE"))))
    return rounded(reports.block_prefill(wanted, s, a.last_month(spark, d), ["block"]).select("block", "flat_type", "lease_left", "area", "flat_model", "sales_of_type"))


@query("""SELECT w.town, w.flat_type, CASE WHEN o.town IS NOT NULL THEN 'town' WHEN n.flat_type IS NOT NULL THEN 'national' ELSE 'none' END AS scope, coalesce(o.area, n.area) AS area, coalesce(o.sales, n.sales) AS sales FROM (SELECT n_name || CASE WHEN n_nationkey % 5 = 0 THEN ' X' ELSE '' END AS town, t AS flat_type FROM nation, unnest(['SMALL', 'NONE']) u(t)) w
 LEFT JOIN (SELECT town, flat_type, quantile_cont(area, 0.5) AS area, count(*) AS sales FROM sales GROUP BY ALL) o USING (town, flat_type) LEFT JOIN (SELECT flat_type, quantile_cont(area, 0.5) AS area, count(*) AS sales FROM sales GROUP BY ALL) n ON n.flat_type = w.flat_type""", (SALES,))
def typical_or_national(spark: SparkSession, d: str) -> DataFrame:
    """Typical flats of towns, one in five of which is unknown."""
    s = stored(a.sales(spark, d).select("town", "flat_type", "flat_model", "area", "storey_mid", "lease_year"))
    k = F.col("n_nationkey")
    wanted = a.table(spark, d, "nation").select(F.concat("n_name", F.when(k % 5 == 0, " X").otherwise("")).alias("town"), F.explode(F.array(F.lit("SMALL"), F.lit("NONE"))).alias("flat_type"))
    own, all_ = comparables.typical_flats(s), comparables.typical_flats(s.withColumn("town", F.lit("ALL"))).drop("town")
    return rounded(reports.typical_with_fallback(own, all_, wanted).select("town", "flat_type", "scope", "area", "sales"))


@query("SELECT flat_type, array_to_string(list(flat_model ORDER BY n DESC, flat_model), ', ') AS models FROM (SELECT flat_type, flat_model, count(*) AS n FROM sales GROUP BY ALL) GROUP BY flat_type", (SALES,))
def models_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    return reports.models_by_frequency(a.sales(spark, d), ["flat_type"]).withColumn("models", F.array_join("models", ", "))


@query("SELECT storey_mid, row_number() OVER (ORDER BY storey_mid) AS place FROM (SELECT DISTINCT storey_mid FROM sales)", (SALES,))
def storeys_in_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.storeys_in_order(a.sales(spark, d)))


_EST = "est AS (SELECT sale_id AS flat, price AS asking, m * area AS estimate, m * area * 0.9::DOUBLE AS low, m * area * 1.1::DOUBLE AS high FROM sales JOIN (SELECT town, flat_type, quantile_cont(psm, 0.5) AS m FROM sales GROUP BY ALL) USING (town, flat_type))"


@query("SELECT flat, round_even((asking - estimate) / 100, 0) * 100 AS difference, floor((asking - estimate) / estimate * 1e3 + 0.50001) / 1e3 AS difference_share, CASE WHEN asking < low THEN 'below' WHEN asking > high THEN 'above' ELSE 'within' END AS position FROM est", (SALES, _EST))
def asking_position(spark: SparkSession, d: str) -> DataFrame:
    """Every sale's price as an asking price, beside the usual price of its town and type and a tenth on either side."""
    s = a.sales(spark, d)
    m = s.groupBy("town", "flat_type").agg(numbers.median(F.col("psm")).alias("m"))
    e = s.join(F.broadcast(m), ["town", "flat_type"]).select(F.col("sale_id").alias("flat"), F.col("price").alias("asking"), (F.col("m") * F.col("area")).alias("estimate"))
    out = pricing.asking_position(e.withColumns({"low": F.col("estimate") * 0.9, "high": F.col("estimate") * 1.1}))
    return rounded(out.select("flat", "difference", ((F.col("asking") - F.col("estimate")) / F.col("estimate")).alias("difference_share"), "position"), 3)


@query("""SELECT p_partkey AS flat, array_to_string(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'excluded_type' END, CASE WHEN NOT p_size * 8.0 BETWEEN 20 AND 300 THEN 'area_out_of_range' END, CASE WHEN NOT p_partkey % 120 BETWEEN 1 AND 99 THEN 'lease_out_of_range' END, CASE WHEN p_partkey % 7 = 0 THEN 'unreadable_storey' END], lambda x: x IS NOT NULL), ';') AS refused FROM part""", ())
def refused_inputs(spark: SparkSession, d: str) -> DataFrame:
    from marketloom.functions import parsing

    k = F.col("p_partkey")
    storey = parsing.storeys(F.when(k % 7 == 0, "GROUND").otherwise("04 TO 06"))["mid"]
    flats = a.table(spark, d, "part").select(k.alias("flat"), F.when(k % 10 == 0, "1 ROOM").otherwise("4 ROOM").alias("flat_type"), (F.col("p_size") * 8.0).alias("area"), (k % 120).alias("lease_left"), storey.alias("storey_mid"))
    return pricing.refused(flats).select("flat", "refused")


#: Trees of the registered models; published settings are 500. The README has times.
TREES = 12


def model_frame(spark: SparkSession, d: str, *unused: str) -> tuple[DataFrame, list[str]]:
    """The sales with index, target and what is near their block, without the columns ``unused``. The joined sales are written
    once; index and target are added as they are read."""
    last = a.last_month(spark, d)
    s, location = pricing.attach_location(a.sales(spark, d), located(spark, d).drop("latitude", "longitude", "x_m", "y_m"), ["block"])
    s = written(s.drop(*unused))
    return pricing.modelling_frame(s.where(F.col("month") <= F.lit(last)), stored(market.market_index(s, last))), location


@query("SELECT count(*) AS sales, count(mrt_m) AS placed, round(avg(mrt_m), 3) AS mrt_m, round(avg(city_km), 3) AS city_km, round(avg(bus_stops_400m), 3) AS bus_stops_400m FROM sales LEFT JOIN gfeat USING (block)", (SALES, GEO, LOCATED))
def sales_with_location(spark: SparkSession, d: str) -> DataFrame:
    s, _ = pricing.attach_location(a.sales(spark, d), located(spark, d), ["block"])
    return s.agg(F.count("*").alias("sales"), F.count("mrt_m").alias("placed"), *[F.round(F.avg(c), 3).alias(c) for c in ("mrt_m", "city_km", "bus_stops_400m")])


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    frame, location = model_frame(spark, d, "sale_id", "street", "block")
    return pricing.compete(frame, a.last_month(spark, d), location, TREES)[1]


@query()
def price_model(spark: SparkSession, d: str) -> DataFrame:
    return pricing.compare_models(_predictions(spark, d))


MODEL_ROWS = f"""placed AS (SELECT s.*, g.mrt_m FROM sales s LEFT JOIN gfeat g USING (block), ends WHERE month <= last AND flat_type NOT IN ('1 ROOM', 'MULTI-GENERATION')),
held AS (SELECT placed.* FROM placed, ends WHERE month > last - to_months(6))"""


@query("SELECT model, flat_type, count(*) AS n, min(month) AS first_month, max(month) AS last_month, round(sum(price), 2) AS price FROM held, (SELECT unnest(['rule_of_thumb', 'ridge', 'boosting', 'boosting_flat_only']) AS model) GROUP BY ALL", (SALES, GEO, LOCATED, MODEL_ROWS))
def price_model_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the models are compared on: every one of them predicts every held-out sale, and nothing else."""
    out = _predictions(spark, d).where("predicted > 0").groupBy("model", "flat_type")
    return out.agg(F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.round(F.sum("price"), 2).alias("price"))


@query()
def price_ranges(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price_ranges(_predictions(spark, d))


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of the selected model, fitted on the sales before the last six months."""
    frame, location = model_frame(spark, d, "street")
    last = a.last_month(spark, d)
    models, predictions = pricing.compete(frame, last, location, TREES)
    name = pricing.selected(pricing.compare_models(predictions))
    numeric = [*pricing.NUMERIC, *([] if name == "boosting_flat_only" else location)]
    return pricing.permutation_importance(models[name], pricing.split(frame, last)[1], [*pricing.CATEGORIES, *numeric])


@query()
def valuation_report(spark: SparkSession, d: str) -> DataFrame:
    """The last month's sales as flats to value, their prices as asking prices, by a saved model: the one selected on the last
    six months and fitted again on all sales; with each flat's comparable sales."""
    frame, location = model_frame(spark, d, "street")
    last, folder = a.last_month(spark, d), f"{shared_folder(spark)}/price-models-{uuid.uuid4().hex}"
    artefact.publish(frame, market.market_index(frame, last), last, location, folder, TREES)
    m = artefact.load(spark, folder)
    flats = frame.where(F.col("month") == F.lit(last))
    asked = flats.select(F.col("sale_id").alias("flat"), "town", "flat_type", F.col("price").alias("asking"), *pricing.SWAPPED, *m.location)
    usual = comparables.typical_flats(frame).select("town", "flat_type", F.col("area").alias("typical_area"), F.col("storey").alias("typical_storey_mid"), F.col("lease_year").cast("int").alias("typical_lease_year"), F.col("model").alias("typical_flat_model"))
    places = frame.groupBy("town", "flat_type").agg(*[numbers.median(F.col(c)).alias(f"typical_{c}") for c in m.location])
    valued = pricing.valuation(m.model, asked, usual.join(places, ["town", "flat_type"]), m.index, m.ranges, m.location, start_year=1995)
    targets = flats.select(F.col("sale_id").alias("target"), "town", "flat_type", F.col("area").alias("t_area"), F.col("storey_mid").alias("t_storey"), F.col("lease_year").alias("t_lease"), F.col("flat_model").alias("t_model"))
    return pricing.with_comparables(valued, comparables.find_comparables(targets, frame, last))
