"""Market tables: cube medians, pooled windows, period changes, summary windows, index, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import ALL, Market
from marketloom.functions.numbers import change_pct
from marketloom.operators.distribution import Span, counted, every_month, only, quantiles, this_and_next
from marketloom.sources.scratch import stored

KEYS = ["town", "flat_type"]


def rollup(df: DataFrame, *aggs: Column, fixed: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Aggregates for every combination of the keys, with ``ALL`` where a key is rolled up. Rows with a null key are left out."""
    fixed = ["month"] if fixed is None else fixed
    df = df.where(" and ".join(f"{k} is not null" for k in [*fixed, *keys]))
    sets = [[*fixed, *(k for i, k in enumerate(keys) if not m >> i & 1)] for m in range(1 << len(keys))]
    out = df.groupingSets(sets, *fixed, *keys).agg(*aggs, *[F.grouping(k).alias(f"_{k}") for k in keys])
    return out.withColumns({k: F.when(F.col(f"_{k}") == 1, F.lit(ALL)).otherwise(F.col(k)) for k in keys}).drop(*[f"_{k}" for k in keys])


def series_keys(sales: DataFrame) -> DataFrame:
    """(town, flat_type) of every series, with those that are rolled up; from the distinct pairs, not from the rows."""
    return rollup(sales.select(*KEYS).distinct(), F.count("*").alias("n"), fixed=[]).select(*KEYS)


def of_span(name: str, at: int = 0) -> Column:
    """The quantile of a span in a group of rows of ``distribution.quantiles``."""
    return F.max(F.when(F.col("span") == name, F.get("q", F.lit(at))))


def total_of(name: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("span") == name, F.col("total"))), F.lit(0)).cast("long")


def pooled_median(sales: DataFrame, months: int = 3) -> DataFrame:
    """(month, town, flat_type, pooled_median, pooled_count) of the prices of the month and the months before it, pooled."""
    counts = counted(stored(sales.select("month", *KEYS, "price")), KEYS, {"price": F.col("price")})
    pooled = quantiles(counts, KEYS, {"pooled": Span("price", this_and_next(months))})
    return pooled.select(F.col("label").alias("month"), *KEYS, F.get("q", F.lit(0)).alias("pooled_median"), F.col("total").alias("pooled_count"))


def month_grid(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 month")))


def market_prices(sales: DataFrame, last_month) -> DataFrame:
    """(month, town, flat_type, transactions, median_price) of every series on a gap-free month grid: what forecasts read."""
    last = F.lit(last_month).cast("date")
    sales = sales.where(F.col("month") <= last)
    medians = quantiles(counted(sales, KEYS, {"price": F.col("price")}), KEYS, {"price": Span("price", every_month())})
    medians = medians.select(F.col("label").alias("month"), *KEYS, F.get("q", F.lit(0)).alias("median_price"))
    cells = stored(sales.groupBy("month", *KEYS).agg(F.count("*").alias("transactions")))  # what totals, series and months are made of
    stats = rollup(cells, F.sum("transactions").alias("transactions"))
    return month_rows(cells, last).join(stats, ["month", *KEYS], "left").join(medians, ["month", *KEYS], "left").fillna(0, ["transactions"])


def month_rows(sales: DataFrame, last: Column) -> DataFrame:
    """(town, flat_type, month): every series in every month from the first sale to the last month."""
    span = sales.agg(F.min("month").alias("first"))
    return series_keys(sales.where("month is not null")).join(F.broadcast(span)).select(*KEYS, month_grid(F.col("first"), last).alias("month"))


def market_monthly(sales: DataFrame, last_month, months: int = 3) -> DataFrame:
    """Statistics of every series on a gap-free month grid, with pooled medians, changes and rolling means."""
    last = F.lit(last_month).cast("date")
    sales = sales.where(F.col("month") <= last)
    counts = counted(sales, KEYS, {c: F.col(c) for c in ("price", "psm", "area")})
    spans = {"price": Span("price", every_month(), (0.25, 0.5, 0.75)), "psm": Span("psm", every_month()), "area": Span("area", every_month()), "pooled": Span("price", this_and_next(months))}
    medians = quantiles(counts, KEYS, spans).groupBy(F.col("label").alias("month"), *KEYS).agg(
        of_span("price", 0).alias("p25_price"), of_span("price", 1).alias("median_price"), of_span("price", 2).alias("p75_price"), of_span("psm").alias("median_psm"), of_span("area").alias("median_area"),
        of_span("pooled").alias("pooled_median"), total_of("pooled").alias("pooled_count"),
    )
    stats = rollup(sales, F.count("*").alias("transactions"), F.avg("price").alias("mean_price"))
    full = month_rows(sales, last).join(stats, ["month", *KEYS], "left").join(medians, ["month", *KEYS], "left").fillna(0, ["transactions", "pooled_count"])
    w = Window.partitionBy(*KEYS).orderBy("month")
    price, pool = F.col("median_price"), F.col("pooled_median")

    def rolling(n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(price).over(frame) >= max(2, n // 2), F.avg(price).over(frame))

    return full.withColumns({
        "mom_pct": change_pct(price, F.lag(price).over(w), 4), "yoy_pct": change_pct(price, F.lag(price, 12).over(w), 4), "yoy_3m_pct": change_pct(pool, F.lag(pool, 12).over(w), 4),
        "rolling_avg_3m": rolling(3), "rolling_avg_6m": rolling(6),
    })


def summary_windows(last: Column, month: Column) -> dict[str, Column]:
    """name -> whether a month lies in the window; windows end at the last complete month or years before it."""

    def inside(back: int, n: int) -> Column:
        return (month > F.add_months(last, -back - n)) & (month <= F.add_months(last, -back))

    return {"12m": inside(0, 12), "prev12m": inside(12, 12), "5y_ago": inside(60, 12), "3m": inside(0, 3), "prev3m": inside(3, 3), "3m_year_ago": inside(12, 3)}


def town_summary(sales: DataFrame, last_month, m: Market = Market()) -> DataFrame:
    """Median and count of six windows for every series, the median per area of two, and the changes between windows that
    enough sales back. The windows are merged from one table of counts."""
    last = F.lit(last_month).cast("date")
    windows = summary_windows(last, F.col("month"))
    any_ = F.lit(False)
    for w in windows.values():
        any_ = any_ | w
    recent = stored(sales.where(any_).select("month", *KEYS, "price", "psm"))
    spans = {n: Span("price", only(w)) for n, w in windows.items()} | {f"psm_{n}": Span("psm", only(windows[n])) for n in ("12m", "3m")}
    medians = quantiles(counted(recent, KEYS, {c: F.col(c) for c in ("price", "psm")}), KEYS, spans).groupBy(*KEYS).agg(*[of_span(n).alias(f"median_{n}") for n in spans])
    out = rollup(recent, *[F.count_if(w).alias(f"sales_{n}") for n, w in windows.items()], fixed=[]).join(medians, KEYS, "left")

    def pct(a: str, b: str) -> Column:
        return F.when((F.col(f"sales_{a}") >= m.min_sales) & (F.col(f"sales_{b}") >= m.min_sales), change_pct(F.col(f"median_{a}"), F.col(f"median_{b}"), 4))

    return out.withColumns({"yoy_pct": pct("12m", "prev12m"), "yoy_3m_pct": pct("3m", "3m_year_ago"), "momentum_pct": pct("3m", "prev3m"), "five_year_pct": pct("12m", "5y_ago"), "as_of_month": last})


def market_index(sales: DataFrame, last_month, months: int = 3) -> DataFrame:
    """(month, market_index_psm, index_transactions): the median of the months before each month, so that it uses only the past.

    Goes one month past the end; the first month, which has no past, takes the next one's value.
    """
    last = F.lit(last_month).cast("date")
    sales = stored(sales.where((F.col("month") <= last) & F.col("psm").isNotNull()).select("month", "psm"))
    after = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda i: F.add_months("month", i))
    index = quantiles(counted(sales, [], {"psm": F.col("psm")}), [], {"psm": Span("psm", after)})
    index = index.select(F.col("label").alias("month"), F.get("q", F.lit(0)).alias("x"), F.col("total").alias("index_transactions"))
    grid = sales.agg(F.min("month").alias("first")).select(month_grid(F.col("first"), F.add_months(last, 1)).alias("month"))
    # one row for each month
    after = Window.orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    full = grid.join(index, "month", "left").fillna(0, ["index_transactions"])
    return full.select("month", F.first("x", True).over(after).alias("market_index_psm"), "index_transactions")


def facets(df: DataFrame, **chosen) -> DataFrame:
    """Rows that match every facet: a value, a (low, high) range, or ALL for no filter."""
    for name, value in chosen.items():
        if isinstance(value, tuple):
            df = df.where(F.col(name).between(*value))
        elif value != ALL:
            df = df.where(F.col(name) == value)
    return df


def validate_facet(df: DataFrame, name: str, value: str) -> str:
    """The value, if the column has it or it is ALL; else an error."""
    if value != ALL and df.where(F.col(name) == value).isEmpty():
        raise ValueError(f"unknown {name}: {value}")
    return value


def facet_catalogue(sales: DataFrame) -> DataFrame:
    """One row per flat type: its models, years and number of towns."""
    return sales.groupBy("flat_type").agg(F.sort_array(F.collect_set("flat_model")).alias("models"), F.sort_array(F.collect_set(F.year("month"))).alias("years"), F.count_distinct("town").alias("towns"))


def kpis(sales: DataFrame, last_month, m: Market = Market()) -> DataFrame:
    """One row: medians of the last three months, the three before and a year ago, counts, and changes that enough sales back."""
    windows = summary_windows(F.lit(last_month).cast("date"), F.col("month"))
    three = ("3m", "prev3m", "3m_year_ago")
    sales = stored(sales.select("month", "price", "psm"))
    spans = {n: Span("price", only(windows[n])) for n in three} | {"psm": Span("psm", only(windows["3m"]))}
    medians = quantiles(counted(sales, [], {c: F.col(c) for c in ("price", "psm")}), [], spans).agg(*[of_span(n).alias(f"median_{n}") for n in spans])
    one = medians.join(sales.agg(*[F.count_if(windows[n]).alias(f"sales_{n}") for n in (*three, "12m", "prev12m")]))  # a row each
    gated = lambda n: F.when((F.col("sales_3m") >= m.min_sales) & (F.col(f"sales_{n}") >= m.min_sales), change_pct(F.col("median_3m"), F.col(f"median_{n}"), 4))
    return one.withColumns({"quarter_pct": gated("prev3m"), "year_pct": gated("3m_year_ago"), "volume_pct": change_pct(F.col("sales_12m"), F.col("sales_prev12m"), 4)})


def year_to_date(sales: DataFrame, last_month) -> DataFrame:
    last = F.lit(last_month).cast("date")
    same = F.month("month") <= F.month(last)
    return sales.agg(F.count_if((F.year("month") == F.year(last)) & same).alias("this_year"), F.count_if((F.year("month") == F.year(last) - 1) & same).alias("last_year"))


def monthly_series(sales: DataFrame, last_month, m: Market = Market()) -> DataFrame:
    """Medians and quartiles on a full month grid; months with too few sales are blank."""
    last = F.lit(last_month).cast("date")
    sales = sales.where(F.col("month") <= last)
    sales = stored(sales.select("month", "price"))
    stats = quantiles(counted(sales, [], {"price": F.col("price")}), [], {"price": Span("price", every_month(), (0.25, 0.5, 0.75))})
    stats = stats.select(F.col("label").alias("month"), *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "median_price", "p75"))])
    stats = sales.groupBy("month").agg(F.count("*").alias("sales")).join(stats, "month", "left")
    grid = sales.agg(F.min("month").alias("first")).select(month_grid(F.col("first"), last).alias("month"))
    full = grid.join(stats, "month", "left").fillna(0, ["sales"])
    return full.withColumns({c: F.when(F.col("sales") >= m.min_sales, F.col(c)) for c in ("median_price", "p25", "p75")})


def histogram(sales: DataFrame, value: str, narrow: float, wide: float, switch: float) -> DataFrame:
    """(low, count): values clipped to the 1st and 99th percentile's steps; empty bins are kept."""
    sales = stored(sales.select(value))
    counts = counted(sales, [], {value: F.col(value)})
    ends = quantiles(counts, [], {"all": Span(value, every_month(), (0.01, 0.99))}).agg(of_span("all", 0).alias("a"), of_span("all", 1).alias("b"))
    ends = ends.withColumn("step", F.when(F.col("b") - F.col("a") < switch, F.lit(narrow)).otherwise(F.lit(wide)))
    ends = ends.select("step", (F.floor(F.col("a") / F.col("step")) * F.col("step")).alias("lo"), (F.ceil(F.col("b") / F.col("step")) * F.col("step")).alias("hi"))
    bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / F.col("step")) - 1).cast("long"))))
    x = F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi") - 1e-9)
    hits = sales.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(F.floor((x - F.col("lo")) / F.col("step")).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(hits, "bin", "left").select((F.col("lo") + F.col("bin") * F.col("step")).alias("low"), F.coalesce("n", F.lit(0)).alias("sales"))


def town_ranking(sales: DataFrame, last_month, least: int = 10) -> DataFrame:
    """Towns with enough sales in the last year, dearest per area first."""
    w = summary_windows(F.lit(last_month).cast("date"), F.col("month"))
    now, old = w["12m"], w["prev12m"]
    spans = {"median_psm": Span("psm", only(now)), "median_price": Span("price", only(now)), "old_price": Span("price", only(old))}
    sales = stored(sales.where(now | old).select("month", "town", "price", "psm"))
    counts = counted(sales, ["town"], {c: F.col(c) for c in ("price", "psm")})
    medians = quantiles(counts, ["town"], spans, totals=False).groupBy("town").agg(*[of_span(n).alias(n) for n in spans])
    out = sales.groupBy("town").agg(F.count_if(now).alias("sales")).join(medians, "town", "left")
    return out.where(F.col("sales") >= least).select("town", "median_psm", "median_price", "sales", change_pct(F.col("median_price"), F.col("old_price"), 4).alias("yoy_pct")).orderBy(F.desc("median_psm"), "town")


def event_study(sales: DataFrame, event, last_month, least: int = 20) -> DataFrame:
    """One row: medians and counts of the 12 months before, after and two years around an event, changes if both sides have enough."""
    e, last, m = F.lit(event).cast("date"), F.lit(last_month).cast("date"), F.col("month")
    after = (m >= e) & (m < F.add_months(e, 12)) & (m <= last)
    before = (m >= F.add_months(e, -12)) & (m < e)
    earlier = (m >= F.add_months(e, -24)) & (m < F.add_months(e, -12))
    spans = {n: w for n, w in (("before", before), ("after", after), ("earlier", earlier))}
    sales = stored(sales.where(before | after | earlier).select("month", "price"))
    counts = counted(sales, [], {"price": F.col("price")})
    medians = quantiles(counts, [], {n: Span("price", only(w)) for n, w in spans.items()}).agg(*[of_span(n).alias(f"median_{n}") for n in spans])
    one = medians.join(sales.agg(*[F.count_if(w).alias(f"sales_{n}") for n, w in spans.items()]))  # a row each
    enough = lambda a, b: (F.col(f"sales_{a}") >= least) & (F.col(f"sales_{b}") >= least)
    return one.withColumns({"change_pct": F.when(enough("before", "after"), change_pct(F.col("median_after"), F.col("median_before"), 4)), "trend_pct": F.when(enough("before", "earlier"), change_pct(F.col("median_before"), F.col("median_earlier"), 4))})
