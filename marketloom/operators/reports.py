"""Reports put together from the market's tables: long rows of (section, item, measure, value), for many inputs at once where they take any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import ALL, Loan
from marketloom.functions import numbers
from marketloom.operators import affordability, market


def measures(df: DataFrame, section: str, item: Column) -> DataFrame:
    """(section, item, measure, value) of all numeric columns that hold a value."""
    numeric = [c for c, t in df.dtypes if t in ("double", "bigint", "int")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numeric]))
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), each.alias("m")).select("section", "item", "m.*").where("value is not null")


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def market_report(sales: DataFrame, last_month, event, town: str = ALL, year_from: int | None = None, histogram: tuple[float, float, float] = (25_000.0, 50_000.0, 800_000.0), **facets) -> DataFrame:
    """KPIs, monthly series, price distribution, ranking of towns and an event's before and after, for chosen facets.

    The ranking compares all towns under the other facets; KPIs and event look back beyond the first year shown.
    """
    sales = sales.where(F.col("month") <= F.lit(last_month))
    base = market.facets(sales, **facets)
    own = market.facets(base, town=town)
    shown = own if year_from is None else own.where(F.year("month") >= year_from)
    recent = shown.where(market.summary_windows(F.lit(last_month).cast("date"), F.col("month"))["12m"])
    study = market.event_study(own, event, last_month).where("sales_before >= 20 and sales_after >= 20")
    return together(
        measures(market.kpis(own, last_month), "kpis", F.lit("")), measures(market.monthly_series(shown, last_month), "series", F.date_format("month", "yyyy-MM")),
        measures(market.histogram(recent, "price", *histogram).withColumn("low_", F.col("low").cast("long")).select("low_", "sales").withColumnRenamed("sales", "count").select(F.col("low_").cast("string").alias("low"), "count"), "distribution", F.col("low")),
        measures(market.town_ranking(base, last_month), "ranking", F.col("town")), measures(study, "event", F.lit(str(event))),
    )


def overview_report(sales: DataFrame, summary: DataFrame, last_month, reference: str, ranked: int = 50, moving: int = 100) -> DataFrame:
    """National KPIs, sales this year and last, the dearest and cheapest five and the most rising and falling three towns of one type."""
    towns = summary.where((F.col("town") != ALL) & (F.col("flat_type") == reference)).select("town", "median_12m", "median_psm_12m", "sales_12m", "yoy_pct", "five_year_pct")

    def best(df: DataFrame, section: str, order: Column, n: int) -> DataFrame:
        return measures(df.orderBy(order, "town").limit(n), section, F.col("town"))

    priced, known = towns.where(F.col("sales_12m") >= ranked), towns.where((F.col("sales_12m") >= moving) & F.col("yoy_pct").isNotNull())
    return together(
        measures(market.kpis(sales, last_month), "kpis", F.lit("")), measures(market.year_to_date(sales, last_month), "year_to_date", F.lit("")), best(priced, "dearest", F.desc("median_12m"), 5),
        best(priced, "cheapest", F.asc("median_12m"), 5), best(known, "rising", F.desc("yoy_pct"), 3), best(known, "falling", F.asc("yoy_pct"), 3),
    )


def affordability_report(households: DataFrame, summary: DataFrame, benchmark: DataFrame, loan: Loan = Loan(), least: int = 20) -> DataFrame:
    """What each household (household, town, flat_type, income, savings, own_price, own_limit) pays for its choice and could pay.

    The price is the household's own if above 0, else the town's median, for ALL the whole market's (``price_source``).
    Adds the assessment, the highest price, the share of income at the benchmark's latest income and the towns within reach.
    """
    prices = summary.select("town", "flat_type", "median_12m")
    h = households.join(F.broadcast(prices), ["town", "flat_type"], "left")
    own = F.when(F.col("own_price") > 0, F.col("own_price"))
    h = h.withColumns({"price": F.coalesce(own, "median_12m"), "price_source": F.when(own.isNotNull(), "own").when(F.col("median_12m").isNotNull(), "median").otherwise("none")}).drop("median_12m")
    out = affordability.assess(h, F.col("price"), F.col("income"), F.col("savings"), loan)
    out = out.withColumn("budget", numbers.max_price(F.col("income"), F.col("savings"), loan, F.col("own_limit")))
    latest = benchmark.agg(F.max_by("income", "year").alias("_benchmark"))
    out = out.join(F.broadcast(latest)).withColumn("income_vs_benchmark_pct", F.bround((F.col("income") - F.col("_benchmark")) * 100 / F.col("_benchmark"), 1)).drop("_benchmark")
    towns = summary.where((F.col("town") != ALL) & (F.col("sales_12m") >= least)).select("flat_type", F.col("median_12m").alias("_price"))
    cap = F.when(F.col("own_limit") > 0, F.least(F.col("income") * loan.repayment_limit, F.col("own_limit"))).otherwise(F.col("income") * loan.repayment_limit)
    # towns are few; those of the household's type are assessed for it
    each = affordability.assess(households.select("household", "flat_type", "income", "savings", "own_limit").join(F.broadcast(towns), "flat_type"), F.col("_price"), F.col("income"), F.col("savings"), loan)
    reach = each.groupBy("household").agg(F.count_if((F.col("monthly_repayment") <= cap) & (F.col("upfront_shortfall") == 0)).alias("within_reach"))
    return out.join(reach, "household", "left").withColumn("within_reach", F.coalesce("within_reach", F.lit(0)))


def forecast_report(wanted: DataFrame, published: DataFrame, monthly: DataFrame, last_month, months: int = 48, thin: int = 5) -> DataFrame:
    """Rows of history and forecast for each wanted (town, flat_type): part, month, price, lower, upper.

    History blanks months with fewer than ``thin`` sales. A series without a forecast has one row that says so, with the
    types of the town that have one.
    """
    keys = ["town", "flat_type"]
    past = monthly.where(F.col("month") > F.add_months(F.lit(last_month).cast("date"), -months)).join(published.select(*keys).distinct(), keys, "left_semi")
    nothing = F.lit(None).cast("double")
    history = past.select(*keys, F.lit("history").alias("part"), "month", F.when(F.col("transactions") >= thin, F.col("median_price")).alias("price"), nothing.alias("lower"), nothing.alias("upper"), F.lit(None).cast("string").alias("note"))
    ahead = published.select(*keys, F.lit("forecast").alias("part"), F.col("target_month").alias("month"), F.col("forecast").alias("price"), "lower", "upper", F.when(F.col("horizon") == 6, F.col("reading")).alias("note"))
    have = published.groupBy("town").agg(F.array_join(F.array_sort(F.collect_set("flat_type")), ", ").alias("types"))
    none = wanted.join(published.select(*keys).distinct(), keys, "left_anti").join(have, "town", "left")
    missing = none.select(*keys, F.lit("unavailable").alias("part"), F.lit(None).cast("date").alias("month"), nothing.alias("price"), nothing.alias("lower"), nothing.alias("upper"), F.coalesce("types", F.lit("")).alias("note"))
    return history.unionByName(ahead).join(wanted, keys, "left_semi").unionByName(missing)


def comparison(groups: DataFrame, cards: DataFrame, most: int = 3) -> DataFrame:
    """What sets the towns of each group apart (group, town; at most ``most`` towns): the cheapest and the gap to the dearest, the
    fastest growth of five years, the easiest to repay and the nearest to a train. A verdict needs two towns with the figure.

    cards: town, median_price, five_year_pct, repayment_ratio, train_minutes.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not sizes.isEmpty():
        raise ValueError(f"compare at most {most} towns")
    c = groups.join(cards.where("median_price is not null"), "town")

    def pick(figure: str, greatest: bool, apart: bool = False) -> Column:
        order = F.struct(F.col(figure) if not greatest else -F.col(figure), "town")
        found = F.min_by("town", F.when(F.col(figure).isNotNull(), order))
        enough = F.count(figure) >= 2
        return F.when(enough & (F.min(figure) < F.max(figure)) if apart else enough, found)

    return c.groupBy("group").agg(
        F.count("*").alias("towns"), pick("median_price", False).alias("cheapest"), F.when(F.count("*") >= 2, F.max("median_price") - F.min("median_price")).alias("gap"),
        pick("five_year_pct", True).alias("fastest"), F.when(F.count("repayment_ratio") == F.count("*"), pick("repayment_ratio", False)).alias("easiest"),
        F.when(F.count("train_minutes") == F.count("*"), pick("train_minutes", False, True)).alias("nearest_train"),
    )


def method_ranking(score: DataFrame) -> DataFrame:
    """(horizon, rank, method, mape, n): the methods of each horizon (0: all of them) by their mean error, ties by name."""
    place = F.row_number().over(Window.partitionBy("horizon").orderBy("mape", "method"))
    return score.select("horizon", place.alias("rank"), "method", "mape", "n")


def comparison_outlook(groups: DataFrame, published: DataFrame, monthly: DataFrame, last_month, months: int = 60, least: int = 5, flat_type: str = ALL) -> DataFrame:
    """The outlook and the last ``months`` medians of each town of each group (group, town), for one type.

    outlook: the farthest published forecast with its direction, null without one; series: an array of (month, price), in order, the
    price null in months with fewer than ``least`` sales. Towns without any sale have an empty series.
    """
    mine = published.where(F.col("flat_type") == flat_type)
    far = mine.groupBy("town").agg(F.max_by(F.struct("target_month", "recent", "forecast", "change_pct", "direction", "uncertain"), "horizon").alias("o"))
    past = monthly.where((F.col("flat_type") == flat_type) & (F.col("month") > F.add_months(F.lit(last_month).cast("date"), -months)))
    one = F.struct("month", F.when(F.col("transactions") >= least, F.col("median_price")).alias("price"))
    series = past.groupBy("town").agg(F.sort_array(F.collect_list(one)).alias("series"))  # at most as many as months
    out = groups.join(far, "town", "left").join(series, "town", "left")
    return out.select("group", "town", "o.*", F.coalesce("series", F.array().cast(series.schema["series"].dataType)).alias("series"))


def block_prefill(wanted: DataFrame, sales: DataFrame, last_month, keys: list[str], lease_term: int = 99) -> DataFrame:
    """What is known of each wanted (block keys, flat_type): the lease left next month by the block's newest sale (1 at least), the
    median area and commonest model of the type's sales there (nulls if none), and their number.

    sales: lease_year instead of the years left at the sale; of sales in one month the greatest year counts.
    """
    last = F.lit(last_month).cast("date")
    blocks = wanted.select(*keys).distinct()
    newest = sales.join(blocks, keys, "left_semi").groupBy(*keys).agg(F.max_by("lease_year", F.struct("month", "lease_year")).alias("lease_year"))
    after = F.add_months(last, 1)
    left = lease_term - (F.year(after) + (F.month(after) - 1) / 12 - F.col("lease_year"))
    same = sales.join(wanted.select(*keys, "flat_type").distinct(), [*keys, "flat_type"], "left_semi").groupBy(*keys, "flat_type").agg(F.bround(numbers.median(F.col("area"))).alias("area"), F.mode("flat_model", True).alias("flat_model"), F.count("*").alias("sales_of_type"))
    out = wanted.join(newest, keys, "left").join(same, [*keys, "flat_type"], "left")
    return out.withColumns({"lease_left": F.greatest(F.lit(1.0), F.bround(left)), "sales_of_type": F.coalesce("sales_of_type", F.lit(0))}).drop("lease_year")


def typical_with_fallback(own: DataFrame, national: DataFrame, wanted: DataFrame) -> DataFrame:
    """The typical flat of each wanted (town, flat_type): the town's, else the type's in the whole market (``scope``)."""
    columns = [c for c in own.columns if c not in ("town", "flat_type")]
    a = own.select("town", "flat_type", F.struct(*columns).alias("a"))
    b = national.select("flat_type", F.struct(*columns).alias("b"))
    out = wanted.join(a, ["town", "flat_type"], "left").join(b, "flat_type", "left").withColumns({"scope": F.when(F.col("a").isNotNull(), "town").when(F.col("b").isNotNull(), "national").otherwise("none"), "t": F.coalesce("a", "b")})
    return out.select("town", "flat_type", "scope", "t.*")


def models_by_frequency(sales: DataFrame, by: list[str]) -> DataFrame:
    """(by, models): every model, the commonest first, ties by name."""
    n = sales.groupBy(*by, "flat_model").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "flat_model"))), lambda m: m["flat_model"]).alias("models"))


def storeys_in_order(sales: DataFrame) -> DataFrame:
    """Every storey with its place in the order."""
    return sales.select("storey_mid").distinct().withColumn("place", F.row_number().over(Window.orderBy("storey_mid")))


def forecast_types(published: DataFrame) -> DataFrame:
    """(town, flat_types) that have a forecast."""
    return published.groupBy("town").agg(F.array_sort(F.collect_set("flat_type")).alias("flat_types"))
