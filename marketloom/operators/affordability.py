"""Purchase affordability of many prices and households at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import Loan
from marketloom.functions import numbers
from marketloom.sources.scratch import stored

#: So many rows of households and towns at most are ranked in one task, but for those of one household.
MOST_ROWS = 2_000_000


def assess(df: DataFrame, price: Column, income: Column, savings: Column, loan: Loan = Loan()) -> DataFrame:
    """Add the cost breakdown of buying at ``price``; null where price or income is not positive."""
    ok = (price > 0) & (income > 0)
    cash = F.greatest(savings, F.lit(0.0))
    duty = numbers.stamp_duty(price, loan)
    upfront = price - price * loan.loan_to_value + duty
    borrowed = F.greatest(price * loan.loan_to_value - F.greatest(cash - upfront, F.lit(0.0)), F.lit(0.0))
    monthly = numbers.repayment(borrowed, loan)
    ratio = monthly / income
    made = {
        "stamp_duty": F.bround(duty), "min_downpayment": F.bround(price * (1 - loan.loan_to_value)), "downpayment": F.bround(price - borrowed), "upfront_needed": F.bround(upfront),
        "upfront_shortfall": F.bround(F.greatest(upfront - cash, F.lit(0.0))), "loan": F.bround(borrowed), "monthly_repayment": F.bround(monthly), "repayment_ratio": F.bround(ratio, 4),
        "price_to_income": F.bround(price / (income * 12), 4), "status": F.when(ratio <= loan.comfortable, "comfortable").when(ratio <= loan.repayment_limit, "stretch").otherwise("over"),
    }
    return df.withColumns({k: F.when(ok, v) for k, v in made.items()})


def town_affordability(prices: DataFrame, benchmark: DataFrame, loan: Loan = Loan()) -> DataFrame:
    """Every price row at the benchmark's latest income (year, income) with no savings."""
    latest = benchmark.agg(F.max_by("income", "year").alias("income"))
    return assess(prices.join(F.broadcast(latest)), F.col("median_price"), F.col("income"), F.lit(0.0), loan)


def rank_towns(prices: DataFrame, households: DataFrame, loan: Loan = Loan(), least: int = 20) -> DataFrame:
    """Towns by repayment ratio for each household (household, income, savings).

    prices: one row per town; their number is that of towns, which is checked before they are sent to every task.
    """
    towns = stored(prices.where(F.col("transactions") >= least))
    n = towns.limit(10_001).count()
    if n > 10_000:
        raise ValueError("rank_towns takes one row per town")
    # a household is few bytes, but meets every town: they are dealt by their number, as the ranking needs them
    parts = max(households.sparkSession.sparkContext.defaultParallelism, math.ceil(households.count() * n / MOST_ROWS))
    each = assess(households.repartition(parts, "household").join(F.broadcast(towns)), F.col("median_price"), F.col("income"), F.col("savings"), loan)
    within = (F.col("monthly_repayment") <= F.col("income") * loan.repayment_limit) & (F.col("upfront_shortfall") == 0)
    order = Window.partitionBy("household").orderBy("repayment_ratio", "town")
    return each.withColumns({"within_reach": within, "rank": F.row_number().over(order)})
