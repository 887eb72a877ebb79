"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.config import Loan, Quality
from marketloom.functions import numbers
from marketloom.operators import affordability, clean, comparables, forecast, market, pricing, spatial
from marketloom.operators.distribution import Span, counted, every_month, quantiles
from marketloom.plans import adapter as a
from marketloom.sources.scratch import stored, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The SQL without its CTEs, for reports that are put together from several queries.
BODIES: dict[str, str] = {}
EVENT = "1999-06-01"

#: CTEs that the SQL below shares.
SALES = """sales AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, n_name AS town, p_type AS flat_type, p_brand AS flat_model, l_quantity AS area, p_size::DOUBLE AS storey_mid,
 1960 + l_partkey % 35 AS lease_year, l_extendedprice AS price, l_extendedprice / l_quantity AS psm, o_custkey AS block, c_mktsegment AS street, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sale_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
ends AS (SELECT (date_trunc('month', max(l_shipdate)) - INTERVAL 1 MONTH)::DATE AS last FROM lineitem)"""
LABELS = "CASE WHEN grouping(town) = 1 THEN 'ALL' ELSE town END AS town, CASE WHEN grouping(flat_type) = 1 THEN 'ALL' ELSE flat_type END AS flat_type"
SETS = "GROUPING SETS ((month, town, flat_type), (month, town), (month, flat_type), (month))"
PLACES = """blocks AS (SELECT c_custkey AS block, 1.25::DOUBLE + (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 0.2::DOUBLE AS la, 103.65::DOUBLE + (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 0.35::DOUBLE AS lo FROM customer),
places AS (SELECT s_suppkey AS place, (s_suppkey % 6)::INT AS kind, 1.25::DOUBLE + (s_suppkey * 7919 % 10007) / 10007.0::DOUBLE * 0.2::DOUBLE AS la, 103.65::DOUBLE + (s_suppkey * 104729 % 10009) / 10009.0::DOUBLE * 0.35::DOUBLE AS lo FROM supplier),
apart AS (SELECT block, place, kind, sqrt(((b.lo - 103.8198::DOUBLE) * 111289.00473113023::DOUBLE - (p.lo - 103.8198::DOUBLE) * 111289.00473113023::DOUBLE) ** 2 + ((b.la - 1.3521::DOUBLE) * 110574.0::DOUBLE - (p.la - 1.3521::DOUBLE) * 110574.0::DOUBLE) ** 2) AS metres FROM blocks b, places p)"""
MONTHLY = f"""base AS (SELECT sales.* FROM sales, ends WHERE month <= last),
stats AS (SELECT month, {LABELS}, count(*) AS transactions, quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.25) AS p25_price, quantile_cont(price, 0.75) AS p75_price, avg(price) AS mean_price, quantile_cont(psm, 0.5) AS median_psm, quantile_cont(area, 0.5) AS median_area FROM base GROUP BY {SETS}),
ahead AS (SELECT (month + to_months(i::INT))::DATE AS month, town, flat_type, price FROM base, unnest(range(3)) u(i)),
pooled AS (SELECT month, {LABELS}, quantile_cont(price, 0.5) AS pooled_median, count(*) AS pooled_count FROM ahead GROUP BY {SETS}),
series AS (SELECT DISTINCT town, flat_type FROM pooled),
grid AS (SELECT town, flat_type, m::DATE AS month FROM series, (SELECT unnest(generate_series((SELECT min(month) FROM base)::TIMESTAMP, (SELECT last FROM ends)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)),
monthly0 AS (SELECT month, town, flat_type, coalesce(transactions, 0) AS transactions, median_price, mean_price, p25_price, p75_price, median_psm, median_area, pooled_median, coalesce(pooled_count, 0) AS pooled_count
 FROM grid LEFT JOIN stats USING (month, town, flat_type) LEFT JOIN pooled USING (month, town, flat_type))"""


def query(sql: str | None = None, ctes: tuple[str, ...] = (SALES,)):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            BODIES[f.__name__] = sql
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many places by the same arithmetic as in ``_r``, whole numbers as long."""
    k = 10.0**digits
    return df.select(*[(F.floor(F.col(c) * k + 0.50001) / k).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def monthly(spark: SparkSession, d: str) -> DataFrame:
    sales = stored(a.sales(spark, d).select("month", "town", "flat_type", "price", "psm", "area"))  # read by several aggregations
    return market.market_monthly(sales, a.last_month(spark, d))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return market.market_prices(written(a.sales(spark, d).select("month", "town", "flat_type", "price")), a.last_month(spark, d))


def _r(*names: str, n: int = 4) -> str:
    return ", ".join(f"floor({c} * 1e{n} + 0.50001) / 1e{n} AS {c}" for c in names)


@query(f"""SELECT month, town, flat_type, transactions, {_r('median_price', 'mean_price', 'p25_price', 'p75_price', 'median_psm', 'median_area', 'pooled_median')}, pooled_count,
 round_even((median_price / lag(median_price) OVER w - 1) * 100, 4) AS mom_pct, round_even((median_price / lag(median_price, 12) OVER w - 1) * 100, 4) AS yoy_pct, round_even((pooled_median / lag(pooled_median, 12) OVER w - 1) * 100, 4) AS yoy_3m_pct,
 floor(CASE WHEN count(median_price) OVER w3 >= 2 THEN avg(median_price) OVER w3 END * 1e4 + 0.50001) / 1e4 AS rolling_avg_3m, floor(CASE WHEN count(median_price) OVER w6 >= 3 THEN avg(median_price) OVER w6 END * 1e4 + 0.50001) / 1e4 AS rolling_avg_6m FROM monthly0
 WINDOW w AS (PARTITION BY town, flat_type ORDER BY month), w3 AS (PARTITION BY town, flat_type ORDER BY month ROWS 2 PRECEDING), w6 AS (PARTITION BY town, flat_type ORDER BY month ROWS 5 PRECEDING)""", (SALES, MONTHLY))
def market_monthly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monthly(spark, d))


@query(f"SELECT month, town, flat_type, {_r('pooled_median')}, pooled_count FROM pooled", (SALES, MONTHLY))
def pooled_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.pooled_median(a.sales(spark, d).where(F.col("month") <= F.lit(a.last_month(spark, d)))))


_W = {"12m": (0, 12), "prev12m": (12, 12), "5y_ago": (60, 12), "3m": (0, 3), "prev3m": (3, 3), "3m_year_ago": (12, 3)}
_IN = {n: f"(month > last - to_months({b + k}) AND month <= last - to_months({b}))" for n, (b, k) in _W.items()}


def _pct(x: str, y: str, name: str) -> str:
    return f'CASE WHEN "sales_{x}" >= 5 AND "sales_{y}" >= 5 THEN round_even(("median_{x}" / "median_{y}" - 1) * 100, 4) END AS {name}'


SUMMARY = f"""summary AS (SELECT town, flat_type, {', '.join(f'floor("median_{n}" * 1e4 + 0.50001) / 1e4 AS "median_{n}", "sales_{n}"' for n in _W)}, floor("median_psm_12m" * 1e4 + 0.50001) / 1e4 AS "median_psm_12m", floor("median_psm_3m" * 1e4 + 0.50001) / 1e4 AS "median_psm_3m", {_pct('12m', 'prev12m', 'yoy_pct')}, {_pct('3m', '3m_year_ago', 'yoy_3m_pct')}, {_pct('3m', 'prev3m', 'momentum_pct')}, {_pct('12m', '5y_ago', 'five_year_pct')}, (SELECT last FROM ends) AS as_of_month
 FROM (SELECT {LABELS}, {', '.join(f'quantile_cont(price, 0.5) FILTER (WHERE {w}) AS "median_{n}", count(*) FILTER (WHERE {w}) AS "sales_{n}"' for n, w in _IN.items())}, {', '.join(f'quantile_cont(psm, 0.5) FILTER (WHERE {_IN[n]}) AS "median_psm_{n}"' for n in ('12m', '3m'))} FROM sales, ends WHERE {' OR '.join(_IN.values())} GROUP BY GROUPING SETS ((town, flat_type), (town), (flat_type), ())))"""


@query("SELECT * FROM summary", (SALES, SUMMARY))
def town_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.town_summary(a.sales(spark, d), a.last_month(spark, d)))


INDEX = """ip AS (SELECT (month + to_months(i::INT))::DATE AS month, psm FROM sales, ends, unnest(range(1, 4)) u(i) WHERE month <= last),
ig AS (SELECT unnest(generate_series((SELECT min(month) FROM sales)::TIMESTAMP, (SELECT last + INTERVAL 1 MONTH FROM ends)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month),
ix AS (SELECT month, quantile_cont(psm, 0.5) AS x, count(*) AS n FROM ip GROUP BY month),
idx AS (SELECT ig.month, first_value(x IGNORE NULLS) OVER (ORDER BY ig.month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS market_index_psm, coalesce(n, 0) AS index_transactions FROM ig LEFT JOIN ix USING (month))"""


@query("SELECT month, round(market_index_psm, 4) AS market_index_psm, index_transactions FROM idx", (SALES, INDEX))
def market_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.market_index(a.sales(spark, d), a.last_month(spark, d)))


RAW = """raw0 AS (SELECT *, (l_orderkey * 7 + l_partkey) % 100 AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
typed AS (SELECT k, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN DATE '2030-01-01' ELSE date_trunc('month', l_shipdate)::DATE END AS month, CASE WHEN k = 4 THEN NULL ELSE upper(p_brand) END AS town, CASE WHEN k = 5 THEN NULL ELSE upper(p_type) END AS flat_type,
 CASE WHEN k = 6 THEN NULL ELSE p_size + 1.0 END AS storey_mid, CASE WHEN k = 7 THEN 0 WHEN k = 8 THEN 900 ELSE trunc(l_quantity) + 20 END AS area, 1960 + l_partkey % 35 AS lease_year, CASE WHEN k = 9 THEN 0 WHEN k = 10 THEN NULL ELSE trunc(l_extendedprice) END AS price,
 CASE WHEN k = 1 THEN 120 WHEN k % 3 = 0 THEN NULL ELSE 1960 + l_partkey % 35 + 99 - year(l_shipdate) + (l_orderkey % 10) / 12 END AS reported FROM raw0),
derived AS (SELECT *, 99 - (year(month) + (month(month) - 1) / 12 - lease_year) AS der FROM typed),
leased AS (SELECT *, round_even(coalesce(reported, der), 2) AS lease FROM derived),
flagged AS (SELECT *, list_filter([CASE WHEN month IS NULL THEN 'unparseable_month' END, CASE WHEN month > DATE '2002-01-01' THEN 'future_month' END, CASE WHEN town IS NULL THEN 'missing_town' END, CASE WHEN flat_type IS NULL THEN 'missing_flat_type' END,
 CASE WHEN NOT coalesce(price > 0, false) THEN 'non_positive_price' END, CASE WHEN NOT area > 0 THEN 'non_positive_floor_area' END, CASE WHEN area > 0 AND NOT area BETWEEN 20 AND 400 THEN 'implausible_floor_area' END, CASE WHEN storey_mid IS NULL THEN 'unparseable_storey_range' END,
 CASE WHEN NOT coalesce(lease > 0 AND lease <= 99, false) OR NOT coalesce(lease_year BETWEEN 1960 AND year(month), false) THEN 'impossible_lease' END], lambda x: x IS NOT NULL) AS reasons FROM leased)"""


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean(a.raw_records(spark, d), "2002-01-15")


@query("SELECT array_to_string(reasons, ';') AS invalid_reasons, coalesce(abs(reported - der) > 2, false) AS lease_mismatch, count(*) AS n, round(sum(price), 2) AS price, round(sum(lease), 1) AS lease, count(storey_mid) AS storeys FROM flagged GROUP BY 1, 2", (RAW,))
def clean_flags(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(spark, d).groupBy("invalid_reasons", "lease_mismatch").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("lease"), 1).alias("lease"), F.count("storey_mid").alias("storeys"))


@query("SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM flagged) GROUP BY reason", (RAW,))
def invalid_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return clean.by_reason(cleaned(spark, d))


_CHECKS = {"months_parse": "month IS NULL", "no_future_months": "list_contains(reasons, 'future_month')", "town_present": "town IS NULL", "flat_type_present": "flat_type IS NULL", "price_positive": "NOT coalesce(price > 0, false)", "area_positive": "NOT area > 0", "storey_parses": "storey_mid IS NULL", "lease_possible": "list_contains(reasons, 'impossible_lease')", "lease_agrees": "coalesce(abs(reported - der) > 2, false)"}


@query("SELECT check_name, failed_rows, failed_rows = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {w}) AS failed_rows FROM flagged" for n, w in _CHECKS.items()) + ")", (RAW,))
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    return clean.scorecard(cleaned(spark, d))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE len(reasons) = 0) AS valid_rows, round_even(count(*) FILTER (WHERE len(reasons) = 0) * 100 / count(*), 4) AS valid_pct, count(*) FILTER (WHERE coalesce(abs(reported - der) > 2, false)) AS lease_mismatches, count(*) - count(month) AS missing_month, count(*) - count(town) AS missing_town, count(*) - count(price) AS missing_price, count(DISTINCT town) AS towns, count(DISTINCT flat_type) AS flat_types, min(month) AS first_month, max(month) AS last_month FROM flagged", (RAW,))
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return clean.quality_summary(cleaned(spark, d), ["month", "town", "price"])


@query("SELECT max(month) AS last_month FROM flagged WHERE len(reasons) = 0 AND month < (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem)", (RAW,))
def last_complete_month(spark: SparkSession, d: str) -> DataFrame:
    pulled = a.table(spark, d, "lineitem").agg(F.max("l_shipdate").alias("pulled"))
    return clean.last_complete_month(cleaned(spark, d).join(F.broadcast(pulled)), "pulled")


@query("SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE r > 1) AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag ORDER BY l_orderkey) AS r FROM lineitem) GROUP BY l_returnflag", ())
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    df = clean.flag_duplicates(a.table(spark, d, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"], "l_orderkey")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if("is_duplicate").alias("duplicates"))


@query("""SELECT town, flat_type, year, count(*) AS sales, count(*) FILTER (WHERE abs(z) > 2.5 AND n >= 30) AS outliers FROM (SELECT town, flat_type, year, n, CASE WHEN mad > 0 THEN 0.6745 * (x - m) / mad ELSE 0 END AS z FROM logs JOIN mids USING (town, flat_type, year) JOIN mads USING (town, flat_type, year)) GROUP BY ALL""",
       (RAW, "logs AS (SELECT town, flat_type, year(month)::BIGINT AS year, ln(round_even(price / area, 2)) AS x FROM flagged WHERE len(reasons) = 0)", "mids AS (SELECT town, flat_type, year, quantile_cont(x, 0.5) AS m, count(*) AS n FROM logs GROUP BY ALL)", "mads AS (SELECT town, flat_type, year, quantile_cont(abs(x - m), 0.5) AS mad FROM logs JOIN mids USING (town, flat_type, year) GROUP BY ALL)"))
def price_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Valid records by the log of their price per area, within town, type and year; the bound is lowered, since these data have no outlier beyond 5."""
    records = stored(cleaned(spark, d).select("town", "flat_type", "year", "psm", "is_valid"))  # parsed once, read by each median
    flagged = clean.flag_outliers(records, Quality(outlier_z=2.5)).where("is_valid")
    return flagged.groupBy("town", "flat_type", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("sales"), F.count_if("is_price_outlier").alias("outliers"))


def kpis_sql(source: str) -> str:
    """Counts and medians of a filtered table of sales."""
    names = ("3m", "prev3m", "3m_year_ago")
    gated = lambda n, name: f"""CASE WHEN "sales_3m" >= 5 AND "sales_{n}" >= 5 THEN round_even(("median_3m" / "median_{n}" - 1) * 100, 4) END AS {name}"""
    return f"""SELECT {', '.join(f'round("median_{n}", 4) AS "median_{n}"' for n in names)}, round(median_psm, 4) AS median_psm, {', '.join(f'"sales_{n}"' for n in (*names, '12m', 'prev12m'))},
 {gated('prev3m', 'quarter_pct')}, {gated('3m_year_ago', 'year_pct')}, CASE WHEN "sales_prev12m" > 0 THEN round_even(("sales_12m" / "sales_prev12m" - 1) * 100, 4) END AS volume_pct
 FROM (SELECT {', '.join(f'quantile_cont(price, 0.5) FILTER (WHERE {_IN[n]}) AS "median_{n}"' for n in names)}, quantile_cont(psm, 0.5) FILTER (WHERE {_IN['3m']}) AS median_psm, {', '.join(f'count(*) FILTER (WHERE {_IN[n]}) AS "sales_{n}"' for n in (*names, '12m', 'prev12m'))} FROM {source}, ends)"""


@query(kpis_sql("(SELECT * FROM sales WHERE town = 'NATION_3')"))
def market_kpis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.kpis(market.facets(a.sales(spark, d), town="NATION_3", flat_type="ALL"), a.last_month(spark, d)))


@query("SELECT count(*) FILTER (WHERE year(month) = year(last) AND month(month) <= month(last)) AS this_year, count(*) FILTER (WHERE year(month) = year(last) - 1 AND month(month) <= month(last)) AS last_year FROM sales, ends")
def ytd(spark: SparkSession, d: str) -> DataFrame:
    return market.year_to_date(a.sales(spark, d), a.last_month(spark, d))


@query("""SELECT g.month, coalesce(n, 0) AS sales, CASE WHEN n >= 5 THEN round(m, 4) END AS median_price, CASE WHEN n >= 5 THEN round(q1, 4) END AS p25, CASE WHEN n >= 5 THEN round(q3, 4) END AS p75
 FROM (SELECT unnest(generate_series((SELECT min(month) FROM f)::TIMESTAMP, (SELECT last FROM ends)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) g LEFT JOIN (SELECT month, count(*) AS n, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f GROUP BY month) USING (month)""", (SALES, "f AS (SELECT sales.* FROM sales, ends WHERE town = 'NATION_3' AND storey_mid BETWEEN 1 AND 25 AND month <= last)"))
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.monthly_series(market.facets(a.sales(spark, d), town="NATION_3", storey_mid=(1, 25)), a.last_month(spark, d)))


@query("""SELECT lo + b * step AS low, coalesce(n, 0) AS sales FROM (SELECT lo, step, unnest(range(0, greatest(1, ceil((hi - lo) / step))::BIGINT)) AS b FROM e) LEFT JOIN (SELECT floor((least(greatest(price, lo), hi - 1e-9) - lo) / step)::BIGINT AS b, count(*) AS n FROM sales, e GROUP BY 1) USING (b)""",
       (SALES, "e0 AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS z FROM sales)", "e AS (SELECT s AS step, floor(a / s) * s AS lo, ceil(z / s) * s AS hi FROM (SELECT a, z, CASE WHEN z - a < 20000 THEN 500.0::DOUBLE ELSE 5000.0::DOUBLE END AS s FROM e0))"))
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return market.histogram(a.sales(spark, d), "price", 500.0, 5000.0, 20_000.0)


RANKING = f"rank0 AS (SELECT town, quantile_cont(psm, 0.5) FILTER (WHERE {_IN['12m']}) AS median_psm, quantile_cont(price, 0.5) FILTER (WHERE {_IN['12m']}) AS median_price, count(*) FILTER (WHERE {_IN['12m']}) AS sales, quantile_cont(price, 0.5) FILTER (WHERE {_IN['prev12m']}) AS old FROM sales, ends GROUP BY town), ranking AS (SELECT town, median_psm, median_price, sales, round_even((median_price / old - 1) * 100, 4) AS yoy_pct FROM rank0 WHERE sales >= 10)"


@query(f"SELECT town, {_r('median_psm', 'median_price')}, sales, yoy_pct FROM ranking", (SALES, RANKING))
def town_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.town_ranking(a.sales(spark, d), a.last_month(spark, d)))


REFERENCE_TYPE = "PROMO"


def ends_of(df: DataFrame, value: str, n: int, high: str, low: str, digits: int = 4) -> DataFrame:
    """The n greatest and the n smallest, ties by town."""
    sides = [df.orderBy(o, "town").limit(n).select(F.lit(side).alias("side"), "town", F.round(value, digits).alias(value)) for side, o in ((high, F.desc(value)), (low, F.asc(value)))]
    return sides[0].unionByName(sides[1])


def _ends_sql(value: str, n: int, high: str, low: str, where: str) -> str:
    return " UNION ALL ".join(f"""(SELECT '{side}' AS side, town, "{value}" FROM summary WHERE {where} ORDER BY "{value}" {order}, town LIMIT {n})""" for side, order in ((high, "DESC"), (low, "ASC")))


@query(_ends_sql("median_12m", 5, "dear", "cheap", f"""town <> 'ALL' AND flat_type = '{REFERENCE_TYPE}' AND "sales_12m" >= 50"""), (SALES, SUMMARY))
def top_towns(spark: SparkSession, d: str) -> DataFrame:
    """Dearest and cheapest towns of one type, so that like is compared with like; with 50 sales at least."""
    return ends_of(town_summary(spark, d).where((F.col("town") != "ALL") & (F.col("flat_type") == REFERENCE_TYPE) & (F.col("sales_12m") >= 50)), "median_12m", 5, "dear", "cheap")


@query(_ends_sql("yoy_pct", 3, "up", "down", """town <> 'ALL' AND flat_type = 'ALL' AND "sales_12m" >= 100 AND yoy_pct IS NOT NULL"""), (SALES, SUMMARY))
def movers(spark: SparkSession, d: str) -> DataFrame:
    return ends_of(town_summary(spark, d).where("town <> 'ALL' and flat_type = 'ALL' and sales_12m >= 100 and yoy_pct is not null"), "yoy_pct", 3, "up", "down")


_EV = {"before": f"month >= DATE '{EVENT}' - to_months(12) AND month < DATE '{EVENT}'", "after": f"month >= DATE '{EVENT}' AND month < DATE '{EVENT}' + to_months(12) AND month <= last", "earlier": f"month >= DATE '{EVENT}' - to_months(24) AND month < DATE '{EVENT}' - to_months(12)"}


@query(f"SELECT {', '.join(f'round(m_{n}, 4) AS median_{n}, n_{n} AS sales_{n}' for n in _EV)}, CASE WHEN n_before >= 20 AND n_after >= 20 THEN round_even((m_after / m_before - 1) * 100, 4) END AS change_pct, CASE WHEN n_before >= 20 AND n_earlier >= 20 THEN round_even((m_before / m_earlier - 1) * 100, 4) END AS trend_pct FROM (SELECT {', '.join(f'quantile_cont(price, 0.5) FILTER (WHERE {w}) AS m_{n}, count(*) FILTER (WHERE {w}) AS n_{n}' for n, w in _EV.items())} FROM sales, ends)")
def event_before_after(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.event_study(a.sales(spark, d), EVENT, a.last_month(spark, d)))


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The reference's SQL views run as Spark SQL over the sales view."""
    return spark.sql(text, sales=a.sales(spark, d), places=a.places(spark, d))


@query("SELECT month, town, flat_type, count(*) AS transactions, round(quantile_cont(price, 0.5), 4) AS median_price FROM sales GROUP BY ALL")
def v_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, "SELECT month, town, flat_type, count(*) AS transactions, round(percentile(price, 0.5), 4) AS median_price FROM {sales} GROUP BY month, town, flat_type")


@query(f"SELECT flat_type, CASE WHEN month < DATE '{EVENT}' THEN 'before' ELSE 'after' END AS period, count(*) AS sales, round(quantile_cont(psm, 0.5), 4) AS median_psm FROM sales GROUP BY 1, 2")
def before_after_sql(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, f"SELECT flat_type, CASE WHEN month < DATE '{EVENT}' THEN 'before' ELSE 'after' END AS period, count(*) AS sales, round(percentile(psm, 0.5), 4) AS median_psm FROM {{sales}} GROUP BY 1, 2")


WALKS = PLACES + ", near AS (SELECT block, min(metres) AS metres FROM apart GROUP BY block), walked AS (SELECT price, psm, month, CASE WHEN w <= 5 THEN '5' WHEN w <= 10 THEN '10' WHEN w <= 15 THEN '15' ELSE 'over' END AS band FROM (SELECT sales.*, greatest(1, ceil(metres * 1.3 / 80)) AS w FROM sales JOIN near USING (block))), banded AS (SELECT band, count(*) AS sales, quantile_cont(psm, 0.5) AS median_psm FROM walked WHERE month > (SELECT max(month) FROM sales) - INTERVAL 12 MONTH GROUP BY band)"


def walk_bands(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest(spatial.with_metres(a.blocks(spark, d)), spatial.with_metres(a.places(spark, d)), "block", "place", 2000.0)
    s = a.sales(spark, d)
    w = numbers.walk_minutes(F.col("metres"))
    newest = s.agg(F.add_months(F.max("month"), -12).alias("since"))
    band = F.when(w <= 5, "5").when(w <= 10, "10").when(w <= 15, "15").otherwise("over")
    rows = stored(s.join(F.broadcast(newest), F.col("month") > F.col("since")).join(near, "block").select(band.alias("band"), "psm"))
    medians = quantiles(counted(rows, ["band"], {"psm": F.col("psm")}), ["band"], {"psm": Span("psm", every_month())}, totals=False)
    return rows.groupBy("band").agg(F.count("*").alias("sales")).join(medians.select("band", F.get("q", F.lit(0)).alias("median_psm")), "band", "left")


@query("SELECT band, sales, round(median_psm, 4) AS median_psm FROM banded", (SALES, WALKS))
def v_price_by_walk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(walk_bands(spark, d))


@query("SELECT round(sum(median_psm * sales) / sum(sales), 4) AS weighted_psm FROM banded", (SALES, WALKS))
def weighted_band_average(spark: SparkSession, d: str) -> DataFrame:
    return walk_bands(spark, d).agg(F.round(F.sum(F.col("median_psm") * F.col("sales")) / F.sum("sales"), 4).alias("weighted_psm"))


@query("SELECT flat_type, list_sort(list(DISTINCT flat_model)) AS models, list_sort(list(DISTINCT year(month)::INT)) AS years, count(DISTINCT town) AS towns FROM sales GROUP BY flat_type")
def facet_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return market.facet_catalogue(a.sales(spark, d))


_T = [(180000, .01), (180000, .02), (640000, .03), (500000, .04), (1500000, .05), (None, .06)]


def _duty(p: str) -> str:
    out, low = [], 0
    for width, rate in _T:
        top = f"{p} - {low}" if width is None else f"least({p} - {low}, {width})"
        out.append(f"{rate}::DOUBLE * greatest(0, {top})")
        low += width or 0
    return " + ".join(out)


ASSESS = f"""aff0 AS (SELECT *, greatest(cash, 0) AS c, {_duty('price')} AS duty FROM buyers), aff1 AS (SELECT *, price - price * 0.75::DOUBLE + duty AS upfront FROM aff0),
aff2 AS (SELECT *, greatest(price * 0.75::DOUBLE - greatest(c - upfront, 0), 0) AS borrowed FROM aff1), aff3 AS (SELECT *, CASE WHEN borrowed <= 0 THEN 0 ELSE borrowed * (0.026::DOUBLE / 12) / (1 - power(1 + 0.026::DOUBLE / 12, -300)) END AS monthly FROM aff2),
assessed AS (SELECT *, monthly / income AS ratio FROM aff3)"""
BUYERS = "buyers AS (SELECT o_orderkey AS buyer, o_totalprice * 4 AS price, 4000.0::DOUBLE + o_custkey % 97 * 100 AS income, (o_orderkey % 41 * 9000)::DOUBLE AS cash FROM orders)"


def buyers(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "orders").select(F.col("o_orderkey").alias("buyer"), (F.col("o_totalprice") * 4).alias("price"), (F.lit(4000.0) + F.col("o_custkey") % 97 * 100).alias("income"), (F.col("o_orderkey") % 41 * 9000).cast("double").alias("cash"))


@query("SELECT buyer, round_even(duty, 0) AS stamp_duty, round_even(upfront, 0) AS upfront_needed, round_even(greatest(upfront - c, 0), 0) AS upfront_shortfall, round_even(borrowed, 0) AS loan, round_even(monthly, 0) AS monthly_repayment, round_even(ratio, 4) AS repayment_ratio, CASE WHEN ratio <= 0.25 THEN 'comfortable' WHEN ratio <= 0.3 THEN 'stretch' ELSE 'over' END AS status FROM assessed", (BUYERS, ASSESS))
def purchase_assessment(spark: SparkSession, d: str) -> DataFrame:
    return affordability.assess(buyers(spark, d), F.col("price"), F.col("income"), F.col("cash")).select("buyer", "stamp_duty", "upfront_needed", "upfront_shortfall", "loan", "monthly_repayment", "repayment_ratio", "status")


@query(f"SELECT buyer, round({_duty('price')}, 4) AS duty FROM buyers", (BUYERS,))
def stamp_duty(spark: SparkSession, d: str) -> DataFrame:
    return buyers(spark, d).select("buyer", F.round(numbers.stamp_duty(F.col("price")), 4).alias("duty"))


@query(f"""SELECT buyer, (floor(lo / 1000) * 1000)::BIGINT AS max_price FROM steps WHERE i = 60""", (BUYERS, f"""RECURSIVE steps AS (SELECT buyer, cash, income * 0.3::DOUBLE * (1 - power(1 + 0.026::DOUBLE / 12, -300)) / (0.026::DOUBLE / 12) AS most, 0.0::DOUBLE AS lo, 5000000.0::DOUBLE AS hi, 0 AS i FROM buyers
 UNION ALL SELECT buyer, cash, most, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, i + 1 FROM (SELECT *, cash >= up AND greatest(mid * 0.75::DOUBLE - (cash - up), 0) <= most AS ok FROM (SELECT *, mid * (1 - 0.75::DOUBLE) + {_duty('mid')} AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM steps WHERE i < 60))))"""))
def max_price(spark: SparkSession, d: str) -> DataFrame:
    return buyers(spark, d).select("buyer", numbers.max_price(F.col("income"), F.col("cash"))["max_price"].alias("max_price"))


ORACLES["max_price"] = ORACLES["max_price"].replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE steps", ", steps")
TOWN_PRICES = f"prices AS (SELECT town, flat_type, quantile_cont(price, 0.5) * 10 AS price, count(*) AS transactions FROM sales, ends WHERE {_IN['12m']} GROUP BY town, flat_type)"


def town_prices(spark: SparkSession, d: str, by: tuple = ("town", "flat_type")) -> DataFrame:
    last = F.lit(a.last_month(spark, d)).cast("date")
    s = a.sales(spark, d).where((F.col("month") > F.add_months(last, -12)) & (F.col("month") <= last))
    return s.groupBy(*by).agg((numbers.median(F.col("price")) * 10).alias("median_price"), F.count("*").alias("transactions"))


@query("SELECT town, flat_type, round_even(ratio, 4) AS repayment_ratio, round_even(borrowed, 0) AS loan, CASE WHEN ratio <= 0.25 THEN 'comfortable' WHEN ratio <= 0.3 THEN 'stretch' ELSE 'over' END AS status FROM assessed", (SALES, TOWN_PRICES, "buyers AS (SELECT *, 9000.0::DOUBLE AS income, 0.0::DOUBLE AS cash FROM prices)", ASSESS))
def town_affordability(spark: SparkSession, d: str) -> DataFrame:
    years = a.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.lit(9000.0).alias("income"))
    return affordability.town_affordability(town_prices(spark, d), years).select("town", "flat_type", "repayment_ratio", "loan", "status")


@query("""SELECT household, town, rank, within_reach FROM (SELECT household, town, row_number() OVER (PARTITION BY household ORDER BY round_even(ratio, 4), town) AS rank, round_even(monthly, 0) <= income * 0.3::DOUBLE AND round_even(greatest(upfront - c, 0), 0) = 0 AS within_reach FROM assessed)""",
       (SALES, f"prices AS (SELECT town, quantile_cont(price, 0.5) * 10 AS price, count(*) AS transactions FROM sales, ends WHERE {_IN['12m']} GROUP BY town)", "buyers AS (SELECT c_custkey AS household, town, price, 3000.0::DOUBLE + abs(c_acctbal) AS income, abs(c_acctbal) * 20 AS cash FROM customer, prices WHERE transactions >= 20)", ASSESS))
def rank_towns(spark: SparkSession, d: str) -> DataFrame:
    homes = a.table(spark, d, "customer").select(F.col("c_custkey").alias("household"), (F.lit(3000.0) + F.abs("c_acctbal")).alias("income"), (F.abs("c_acctbal") * 20).alias("savings"))
    return affordability.rank_towns(town_prices(spark, d, ("town",)), homes).select("household", "town", F.col("rank").cast("long").alias("rank"), "within_reach")


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spatial.with_metres(a.blocks(spark, d)), spatial.with_metres(a.places(spark, d))


@query("SELECT block, arg_min(place, metres) AS place, round(min(metres), 3) AS metres FROM apart GROUP BY block", (PLACES,))
def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    b, p = _points(spark, d)
    return rounded(spatial.nearest(b, p, "block", "place", 1000.0), 3)


@query("SELECT block, count(*) FILTER (WHERE metres <= 1500) AS n FROM apart GROUP BY block", (PLACES,))
def count_within(spark: SparkSession, d: str) -> DataFrame:
    b, p = _points(spark, d)
    return spatial.count_within(b, p, 1500.0, "block", "place")


@query("SELECT block, place, rank, round(metres, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY metres, place) AS rank FROM apart WHERE metres <= 4000) WHERE rank <= 6", (PLACES,))
def within_top_n(spark: SparkSession, d: str) -> DataFrame:
    b, p = _points(spark, d)
    return rounded(spatial.top_within(b, p, 4000.0, 6, "block", "place"), 3)


@query("SELECT block, kind, arg_min(place, metres) AS place, round(min(metres), 3) AS metres FROM apart GROUP BY block, kind", (PLACES,))
def nearest_by_kind(spark: SparkSession, d: str) -> DataFrame:
    b, p = _points(spark, d)
    near = spatial.nearest_of_kinds(b, p, "block", "place", "kind")
    return near.select("block", F.col("kind").cast("int").alias("kind"), "place", F.round("metres", 3).alias("metres"))


@query("""SELECT target, rank, sale_id, round(distance, 6) AS distance FROM (SELECT t.sale_id AS target, s.sale_id, d AS distance, row_number() OVER (PARTITION BY t.sale_id ORDER BY d, s.month DESC, s.sale_id) AS rank FROM t JOIN recent s USING (town, flat_type), LATERAL (SELECT sqrt(((t.area - s.area) / 10) ** 2 + ((t.storey_mid - s.storey_mid) / 6) ** 2 + ((t.lease_year - s.lease_year) / 8) ** 2 + (datediff('month', s.month, last) / 12) ** 2) + CASE WHEN t.flat_model <> s.flat_model THEN 0.25 ELSE 0 END AS d)) WHERE rank <= 5""",
       (SALES, "recent AS (SELECT sales.*, last FROM sales, ends WHERE month > last - to_months(24) AND month <= last)", "t AS (SELECT * EXCLUDE (last) FROM recent WHERE month = last)"))
def comparable_sales(spark: SparkSession, d: str) -> DataFrame:
    last = a.last_month(spark, d)
    s = stored(a.sales(spark, d).where((F.col("month") > F.add_months(F.lit(last), -24)) & (F.col("month") <= F.lit(last))).select("sale_id", "month", "town", "flat_type", "flat_model", "area", "storey_mid", "lease_year", "price"))
    t = s.where(F.col("month") == F.lit(last)).select(F.col("sale_id").alias("target"), "town", "flat_type", F.col("area").alias("t_area"), F.col("storey_mid").alias("t_storey"), F.col("lease_year").alias("t_lease"), F.col("flat_model").alias("t_model"))
    return rounded(comparables.find_comparables(t, s, last).select("target", "rank", "sale_id", "distance"), 6)


_XY = "(103.65::DOUBLE + (block * 104729 % 10009) / 10009.0::DOUBLE * 0.35::DOUBLE - 103.8198::DOUBLE) * 111289.00473113023::DOUBLE AS x, (1.25::DOUBLE + (block * 7919 % 10007) / 10007.0::DOUBLE * 0.2::DOUBLE - 1.3521::DOUBLE) * 110574.0::DOUBLE AS y"


@query("""SELECT target, rank, sale_id, round(distance, 6) AS distance FROM (SELECT t.sale_id AS target, s.sale_id, sqrt(d ** 2 + (sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2) / 600) ** 2) AS distance, row_number() OVER (PARTITION BY t.sale_id ORDER BY sqrt(d ** 2 + (sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2) / 600) ** 2), s.month DESC, s.sale_id) AS rank FROM t JOIN recent s USING (town, flat_type), LATERAL (SELECT sqrt(((t.area - s.area) / 10) ** 2 + ((t.storey_mid - s.storey_mid) / 6) ** 2 + ((t.lease_year - s.lease_year) / 8) ** 2 + (datediff('month', s.month, last) / 12) ** 2) + CASE WHEN t.flat_model <> s.flat_model THEN 0.25 ELSE 0 END AS d)) WHERE rank <= 5""",
       (SALES, f"recent AS (SELECT sales.*, {_XY}, last FROM sales, ends WHERE month > last - to_months(24) AND month <= last)", "t AS (SELECT * EXCLUDE (last) FROM recent WHERE month = last)"))
def comparable_sales_near(spark: SparkSession, d: str) -> DataFrame:
    """Comparable sales for which the metres between the two blocks count too."""
    last = a.last_month(spark, d)
    places = spatial.with_metres(a.blocks(spark, d)).select("block", "x_m", "y_m")
    s = a.sales(spark, d).where((F.col("month") > F.add_months(F.lit(last), -24)) & (F.col("month") <= F.lit(last))).join(places, "block")
    s = stored(s.select("sale_id", "month", "town", "flat_type", "flat_model", "area", "storey_mid", "lease_year", "price", "x_m", "y_m"))
    named = {"sale_id": "target", "area": "t_area", "storey_mid": "t_storey", "lease_year": "t_lease", "flat_model": "t_model", "x_m": "t_x", "y_m": "t_y"}
    t = s.where(F.col("month") == F.lit(last)).select("town", "flat_type", *[F.col(c).alias(n) for c, n in named.items()])
    return rounded(comparables.find_comparables(t, s, last).select("target", "rank", "sale_id", "distance"), 6)


@query("""SELECT town, flat_type, sales, area, area_p5, area_p95, area_min, area_max, storey_median, lease_year, model, storey FROM (SELECT town, flat_type, count(*) AS sales, quantile_cont(area, 0.5) AS area, round(quantile_cont(area, 0.05), 4) AS area_p5, round(quantile_cont(area, 0.95), 4) AS area_p95, min(area) AS area_min, max(area) AS area_max, quantile_cont(storey_mid, 0.5) AS storey_median, quantile_cont(lease_year, 0.5)::DOUBLE AS lease_year FROM sales GROUP BY ALL)
 JOIN (SELECT town, flat_type, flat_model AS model FROM (SELECT town, flat_type, flat_model, row_number() OVER (PARTITION BY town, flat_type ORDER BY count(*) DESC, flat_model) AS r FROM sales GROUP BY town, flat_type, flat_model) WHERE r = 1) USING (town, flat_type)
 JOIN (SELECT town, flat_type, storey FROM (SELECT town, flat_type, storey_mid AS storey, row_number() OVER (PARTITION BY town, flat_type ORDER BY abs(storey_mid - m), storey_mid) AS r FROM (SELECT DISTINCT town, flat_type, storey_mid FROM sales) JOIN (SELECT town, flat_type, quantile_cont(storey_mid, 0.5) AS m FROM sales GROUP BY ALL) USING (town, flat_type)) WHERE r = 1) USING (town, flat_type)""")
def typical_flat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(comparables.typical_flats(a.sales(spark, d)))


ELIGIBLE = "elig AS (SELECT town, flat_type, count(*) FILTER (WHERE transactions >= 5) AS observed, sum(transactions) FILTER (WHERE r <= 12)::BIGINT AS recent_sales, count(*) FILTER (WHERE r <= 12 AND transactions < 5) AS thin_months FROM (SELECT *, row_number() OVER (PARTITION BY town, flat_type ORDER BY month DESC) AS r FROM monthly0) GROUP BY ALL HAVING observed >= 36 AND recent_sales >= 60 AND thin_months <= 2)"
FEATURES = ELIGIBLE + """, feat0 AS (SELECT town, flat_type, month, transactions, CASE WHEN transactions >= 5 THEN ln(median_price) END AS y_observed FROM monthly0 SEMI JOIN elig USING (town, flat_type)),
feat1 AS (SELECT *, last_value(y_observed IGNORE NULLS) OVER (PARTITION BY town, flat_type ORDER BY month) AS y FROM feat0), feat2 AS (SELECT *, row_number() OVER (PARTITION BY town, flat_type ORDER BY month) AS t FROM feat1 WHERE y IS NOT NULL),
feat AS (SELECT *, CASE WHEN count(y) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(y) OVER (w ROWS 2 PRECEDING) END AS level, CASE WHEN count(y) OVER (w ROWS 5 PRECEDING) = 6 THEN avg(y) OVER (w ROWS 5 PRECEDING) END AS mean_6m, CASE WHEN count(y) OVER (w ROWS 11 PRECEDING) = 12 THEN avg(y) OVER (w ROWS 11 PRECEDING) END AS mean_12m, CASE WHEN count(transactions) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(transactions) OVER (w ROWS 2 PRECEDING) END AS sales_3m, CASE WHEN count(y) OVER (w ROWS 23 PRECEDING) = 24 THEN regr_slope(y, t) OVER (w ROWS 23 PRECEDING) END AS slope, CASE WHEN count(y) OVER (w ROWS 23 PRECEDING) = 24 THEN avg(y) OVER (w ROWS 23 PRECEDING) END AS mean24, y - lag(y, 12) OVER w AS ret_12, y - lag(y, 6) OVER w AS ret_6, y - lag(y, 3) OVER w AS ret_3, y - lag(y, 2) OVER w AS ret_2, y - lag(y, 1) OVER w AS ret_1 FROM feat2 WINDOW w AS (PARTITION BY town, flat_type ORDER BY month))"""


@query("SELECT * FROM elig", (SALES, MONTHLY, ELIGIBLE))
def eligible_series(spark: SparkSession, d: str) -> DataFrame:
    return forecast.eligible_series(prices(spark, d))


_NAMES = ("y", "level", "slope", "dev_1", "ret_1", "ret_2", "ret_3", "ret_6", "ret_12", "ma3_vs_ma6", "ma3_vs_ma12", "volume", "volume_change", "national_ret_3", "national_ret_12")


@query(f"""SELECT town, flat_type, month, {', '.join(f'floor({c} * 1e6 + 0.50001) / 1e6 AS {c}' for c in _NAMES)} FROM (SELECT f.*, y - level AS dev_1, level - mean_6m AS ma3_vs_ma6, level - mean_12m AS ma3_vs_ma12, ln(1 + sales_3m) AS volume, ln(1 + sales_3m) - lag(ln(1 + sales_3m), 12) OVER (PARTITION BY town, flat_type ORDER BY month) AS volume_change, national_ret_3, national_ret_12
 FROM feat f LEFT JOIN (SELECT month, ret_3 AS national_ret_3, ret_12 AS national_ret_12 FROM feat WHERE town = 'ALL' AND flat_type = 'ALL') USING (month))""", (SALES, MONTHLY, FEATURES))
def series_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.series_features(prices(spark, d)).select("town", "flat_type", "month", *_NAMES), 6)


@query("SELECT town, flat_type, month, floor(slope * 1e6 + 0.50001) / 1e6 AS slope, floor((mean24 + slope * 11.5) * 1e6 + 0.50001) / 1e6 AS fit FROM feat WHERE slope IS NOT NULL", (SALES, MONTHLY, FEATURES))
def trend_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.series_features(prices(spark, d)).where("slope is not null").select("town", "flat_type", "month", "slope", "fit"), 6)


FOLDS = FEATURES + """, tests AS (SELECT f.town, f.flat_type, f.month AS origin_month, h AS horizon, f.sales_3m, g.y_observed AS y_target, f.y AS last_value, f.level AS mean_3m, coalesce(f.mean24 + f.slope * 11.5 + f.slope * h, f.level) AS trend_24m FROM feat f, ends, unnest(range(1, 7)) u(h) JOIN feat g ON g.town = f.town AND g.flat_type = f.flat_type AND g.month = f.month + to_months(h::INT)
 WHERE f.ret_12 IS NOT NULL AND f.level IS NOT NULL AND g.y_observed IS NOT NULL AND datediff('month', f.month, last) IN (6, 9, 12, 15, 18, 21)),
errs AS (SELECT *, exp(p) AS predicted, exp(y_target) AS actual, abs(exp(p) / exp(y_target) - 1) * 100 AS ape, y_target - p AS log_error FROM (UNPIVOT tests ON last_value, mean_3m, trend_24m INTO NAME method VALUE p))"""


def backtest(spark: SparkSession, d: str) -> DataFrame:
    return forecast.errors(forecast.backtest_rows(forecast.feature_rows(forecast.series_features(prices(spark, d))), a.last_month(spark, d)))


@query("SELECT method, town, flat_type, origin_month, horizon, round(predicted, 3) AS predicted, round(actual, 3) AS actual FROM errs", (SALES, MONTHLY, FOLDS))
def backtest_closed_form(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest(spark, d).select("method", "town", "flat_type", "origin_month", "horizon", "predicted", "actual"), 3)


@query("SELECT method, CASE WHEN grouping(horizon) = 1 THEN 0 ELSE horizon END AS horizon, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, round(avg(ape), 4) AS mape, round(quantile_cont(ape, 0.5), 4) AS median_ape, round(avg((ape <= 5)::INT) * 100, 4) AS within_5pct, round(avg((ape <= 10)::INT) * 100, 4) AS within_10pct FROM errs GROUP BY GROUPING SETS ((method), (method, horizon))", (SALES, MONTHLY, FOLDS))
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.scorecard(backtest(spark, d)))


_TIER = "CASE WHEN sales_3m < 10 THEN 'low' WHEN sales_3m < 30 THEN 'mid' WHEN sales_3m >= 30 THEN 'high' END AS tier"
TIERS = f"""tiered AS (SELECT method, horizon, log_error, {_TIER} FROM errs),
cells AS (SELECT method, horizon, tier, count(*) AS n, quantile_cont(log_error, 0.1) AS a, quantile_cont(log_error, 0.9) AS b FROM tiered GROUP BY ALL),
wholes AS (SELECT method, horizon, unnest(['low', 'mid', 'high']) AS tier, count(*) AS pn, quantile_cont(log_error, 0.1) AS pa, quantile_cont(log_error, 0.9) AS pb FROM tiered GROUP BY method, horizon),
ranges AS (SELECT method, horizon, tier, CASE WHEN n >= 30 THEN n ELSE pn END AS n, CASE WHEN n >= 30 THEN a ELSE pa END AS q10, CASE WHEN n >= 30 THEN b ELSE pb END AS q90, NOT coalesce(n >= 30, false) AS pooled FROM wholes LEFT JOIN cells USING (method, horizon, tier)),
overall AS (SELECT method, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(ape) AS mape FROM errs GROUP BY method), best AS (SELECT method FROM overall ORDER BY mape, method LIMIT 1)"""
PUBLISHED = f"""now0 AS (SELECT town, flat_type, month AS origin_month, h AS horizon, (month + to_months(h::INT))::DATE AS target_month, {_TIER}, level, y AS last_value, level AS mean_3m, coalesce(mean24 + slope * 11.5 + slope * h, level) AS trend_24m FROM feat, ends, unnest(range(1, 7)) u(h) WHERE month = last AND ret_12 IS NOT NULL AND level IS NOT NULL),
now1 AS (SELECT n.*, CASE best.method WHEN 'last_value' THEN last_value WHEN 'mean_3m' THEN mean_3m ELSE trend_24m END AS p, best.method, q10, q90 FROM now0 n, best LEFT JOIN ranges r ON r.method = best.method AND r.horizon = n.horizon AND r.tier = n.tier),
published AS (SELECT town, flat_type, horizon, target_month, tier, method, round_even(exp(level) / 1000, 0) * 1000 AS recent, round_even(exp(p) / 1000, 0) * 1000 AS forecast, round_even(exp(p + q10) / 1000, 0) * 1000 AS lower, round_even(exp(p + q90) / 1000, 0) * 1000 AS upper FROM now1)"""


@query("SELECT method, horizon, tier, n, floor(q10 * 1e6 + 0.50001) / 1e6 AS q10, floor(q90 * 1e6 + 0.50001) / 1e6 AS q90, pooled FROM ranges", (SALES, MONTHLY, FOLDS, TIERS))
def intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.intervals(backtest(spark, d)), 6)


@query("SELECT method, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round_even((mape / (SELECT mape FROM overall WHERE method = 'mean_3m') - 1) * 100, 2) AS mape_vs_baseline_pct, method = (SELECT method FROM best) AS selected FROM overall", (SALES, MONTHLY, FOLDS, TIERS))
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.compared(forecast.scorecard(backtest(spark, d))).select("method", "n", "mae", "rmse", "mape", "mape_vs_baseline_pct", "selected"))


def outlook(spark: SparkSession, d: str, monthly_prices: DataFrame | None = None) -> DataFrame:
    monthly_prices = prices(spark, d) if monthly_prices is None else monthly_prices
    rows, last = stored(forecast.feature_rows(forecast.series_features(monthly_prices))), a.last_month(spark, d)
    return forecast.published(rows, forecast.errors(forecast.backtest_rows(rows, last)), last)


@query("SELECT town, flat_type, horizon, target_month, tier, method, recent, forecast, lower, upper FROM published", (SALES, MONTHLY, FOLDS, TIERS, PUBLISHED))
def forecast_published(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outlook(spark, d).select("town", "flat_type", "horizon", "target_month", "tier", "method", "recent", "forecast", "lower", "upper"))


@query("""SELECT town, flat_type, horizon, round_even((forecast / recent - 1) * 100, 2) AS change_pct, CASE WHEN abs((forecast / recent - 1) * 100) < 1.5 THEN 'stable' WHEN forecast > recent THEN 'up' ELSE 'down' END AS direction, "lower" < recent AND recent < "upper" AS uncertain,
 CASE WHEN abs((forecast / recent - 1) * 100) < 1.5 THEN 'hardly any change' ELSE CASE WHEN abs((forecast / recent - 1) * 100) < 4 THEN 'a slight ' ELSE 'a ' END || CASE WHEN forecast > recent THEN 'increase' ELSE 'decrease' END || format(' of {:.1f}% until ', abs((forecast / recent - 1) * 100)) || strftime(target_month, '%b %Y') END
 || format('; expected between {:,} and {:,}', "lower"::BIGINT, "upper"::BIGINT) || CASE WHEN "lower" < recent AND recent < "upper" AND abs((forecast / recent - 1) * 100) >= 1.5 THEN ', so prices could also go the other way' ELSE '' END AS reading FROM published""", (SALES, MONTHLY, FOLDS, TIERS, PUBLISHED))
def forecast_reading(spark: SparkSession, d: str) -> DataFrame:
    """What each published forecast says in words."""
    return rounded(outlook(spark, d).select("town", "flat_type", "horizon", "change_pct", "direction", "uncertain", "reading"))


#: Trees of the registered boosted forecasts; published settings are 300. The README has times.
FORECAST_TREES = 20
ALL_METHODS = (*forecast.METHODS, "boosted")


def _with_boosted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feature rows, boosted predictions, errors of all four methods)."""
    rows, last = stored(forecast.feature_rows(forecast.series_features(prices(spark, d)))), a.last_month(spark, d)
    predictions = stored(forecast.boosted(rows, last, trees=FORECAST_TREES))
    return rows, predictions, forecast.errors(forecast.with_boosted(forecast.backtest_rows(rows, last), predictions), ALL_METHODS)


@query("SELECT method, horizon, count(*) AS n, count(DISTINCT origin_month) AS origins, count(DISTINCT town || flat_type) AS series, round(sum(exp(y_target)), 2) AS actual FROM tests, (SELECT unnest(['last_value', 'mean_3m', 'trend_24m', 'boosted']) AS method) GROUP BY ALL", (SALES, MONTHLY, FOLDS))
def backtest_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every method, fitted ones too, is judged on the same forecasts of every fold."""
    long = _with_boosted(spark, d)[2].where("predicted > 0")
    return long.groupBy("method", "horizon").agg(F.count("*").alias("n"), F.count_distinct("origin_month").alias("origins"), F.count_distinct(F.concat("town", "flat_type")).alias("series"), F.round(F.sum("actual"), 2).alias("actual"))


@query()
def all_methods_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The closed forms and the boosted trees in one backtest, one of which is selected."""
    return forecast.compared(forecast.scorecard(_with_boosted(spark, d)[2]))


@query()
def forecast_selected(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts by whichever of the four methods has the lowest backtest error."""
    rows, predictions, long = _with_boosted(spark, d)
    return forecast.published(rows, long, a.last_month(spark, d), ALL_METHODS, predictions)


@query()
def forecast_gbt(spark: SparkSession, d: str) -> DataFrame:
    rows, last = forecast.feature_rows(forecast.series_features(prices(spark, d))), a.last_month(spark, d)
    return forecast.boosted(rows, last, trees=FORECAST_TREES)


@query(f"""SELECT count(*) AS n, round(avg(abs(p - price)), 4) AS mae, round(avg(abs(p / price - 1) * 100), 4) AS mape FROM (SELECT s.price, coalesce(x, y, z) * s.area AS p FROM (SELECT sales.* FROM sales, ends WHERE month > last - to_months(6) AND month <= last) s LEFT JOIN (SELECT town, flat_type, quantile_cont(psm, 0.5) AS x FROM tr GROUP BY ALL) USING (town, flat_type) LEFT JOIN (SELECT flat_type, quantile_cont(psm, 0.5) AS y FROM tr GROUP BY ALL) USING (flat_type), (SELECT quantile_cont(psm, 0.5) AS z FROM tr))""", (SALES, "tr AS (SELECT sales.* FROM sales, ends WHERE month > last - to_months(18) AND month <= last - to_months(6))"))
def rule_of_thumb(spark: SparkSession, d: str) -> DataFrame:
    last, s = F.lit(a.last_month(spark, d)), a.sales(spark, d)
    train = s.where((F.col("month") > F.add_months(last, -18)) & (F.col("month") <= F.add_months(last, -6)))
    test = s.where((F.col("month") > F.add_months(last, -6)) & (F.col("month") <= last))
    return rounded(pricing.score(pricing.rule_of_thumb(train, test)).select("n", "mae", "mape"))


@query(f"SELECT town, round(p.price, 4) AS median_price, sales_12m, round(r.median_psm, 4) AS median_psm FROM (SELECT town, quantile_cont(price, 0.5) * 10 AS price, count(*) AS sales_12m FROM sales, ends WHERE {_IN['12m']} GROUP BY town) p JOIN ranking r USING (town) WHERE town IN ('NATION_3', 'NATION_7', 'NATION_11')", (SALES, RANKING))
def compare_towns(spark: SparkSession, d: str) -> DataFrame:
    p = town_prices(spark, d, ("town",)).where(F.col("town").isin("NATION_3", "NATION_7", "NATION_11"))
    r = market.town_ranking(a.sales(spark, d), a.last_month(spark, d)).select("town", "median_psm")
    return rounded(p.select("town", "median_price", F.col("transactions").alias("sales_12m")).join(r, "town"))
