"""Comparable sales and typical flats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import Comparables
from marketloom.functions.numbers import median
from marketloom.operators.neighbours import nearest_k
from marketloom.sources.scratch import stored, written


def find_comparables(targets: DataFrame, sales: DataFrame, last_month, c: Comparables = Comparables()) -> DataFrame:
    """The most similar recent sales of each target (target, town, flat_type, t_area, t_storey, t_lease, t_model).

    Only sales of the same town and type of the last two years count. Ties go to the newer sale, then to the smaller id. With
    t_x, t_y of the targets and x_m, y_m of the sales, metres apart count too, where both are known. Targets and sales without
    area, storey or lease year have no distance and play no part. Of sales that differ in month and id only, the newest come
    first for every target, so that few of them are kept; the rest is searched in cells of area, storey, lease and place,
    whichever spread most.
    """
    last, origin = F.lit(last_month).cast("date"), "t_x" in targets.columns and "x_m" in sales.columns
    same = ["town", "flat_type", "area", "storey_mid", "lease_year", "flat_model", *(["x_m", "y_m"] if origin else [])]
    recent = sales.where((F.col("month") > F.add_months(last, -c.months)) & (F.col("month") <= last)).select(*same, "month", "sale_id", "price")
    if origin:  # a place that is no number is unknown
        unknown = F.lit(None).cast("double")
        recent, targets = (df.withColumns({c: F.nanvl(F.col(c).cast("double"), unknown) for c in cols}) for df, cols in ((recent, ("x_m", "y_m")), (targets, ("t_x", "t_y"))))
    first = Window.partitionBy(*same).orderBy(F.desc("month"), "sale_id")
    age = F.months_between(last, F.col("month")) / c.recency
    scaled = {"_a": F.col("area") / c.area, "_s": F.col("storey_mid") / c.storey, "_l": F.col("lease_year") / c.lease, "_age": age} | ({"_x": F.col("x_m") / c.metres, "_y": F.col("y_m") / c.metres} if origin else {})
    kept = written(recent.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= c.top).withColumns(scaled).drop("_n"))
    asked = targets.withColumns({"t_a": F.col("t_area") / c.area, "t_s": F.col("t_storey") / c.storey, "t_l": F.col("t_lease") / c.lease} | ({"t_px": F.col("t_x") / c.metres, "t_py": F.col("t_y") / c.metres} if origin else {}))
    asked = asked.select("target", "town", "flat_type", "t_a", "t_s", "t_l", "t_area", "t_storey", "t_lease", "t_model", *(["t_x", "t_y", "t_px", "t_py"] if origin else []))
    # differences first, then their scale: equal differences have equal distances, to the last bit
    parts = [(F.col("t_area") - F.col("area")) / c.area, (F.col("t_storey") - F.col("storey_mid")) / c.storey, (F.col("t_lease") - F.col("lease_year")) / c.lease, F.col("_age")]
    d = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])) + F.when(F.col("t_model") != F.col("flat_model"), F.lit(0.25)).otherwise(F.lit(0.0))
    if origin:
        apart = F.coalesce(F.sqrt((F.col("t_x") - F.col("x_m")) ** 2 + (F.col("t_y") - F.col("y_m")) ** 2), F.lit(0.0))
        d = F.sqrt(d * d + (apart / c.metres) ** 2)
    flat, order = [("t_a", "_a"), ("t_s", "_s"), ("t_l", "_l")], [F.desc("month"), "sale_id"]
    near = lambda t, s, coords: nearest_k(t, s, "target", coords, d, order, k=c.top, by=["town", "flat_type"], least_side=0.25, enough=4 * c.top)
    if origin:
        asked = stored(asked)
        t_placed, placed = "t_x is not null and t_y is not null", "x_m is not null and y_m is not null"
        found = near(asked.where(t_placed), kept.where(placed), [*flat, ("t_px", "_x"), ("t_py", "_y")])
        # where metres don't count
        found = found.unionByName(near(asked.where(t_placed), kept.where(f"not ({placed})"), flat)).unionByName(near(asked.where(f"not ({t_placed})"), kept, flat))
        best = Window.partitionBy("target", "town", "flat_type").orderBy("distance", *order)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= c.top)
    else:
        found = near(asked, kept, flat)
    return found.select("target", "rank", "sale_id", "month", "price", "distance", F.bround(100 * F.exp(-F.col("distance") / 2)).alias("similarity"))


def typical_flats(sales: DataFrame) -> DataFrame:
    """One row per town and type: medians, 5th and 95th percentiles, range, the commonest model (ties to the first name), the storey nearest the median's."""
    by = ["town", "flat_type"]
    stats = sales.groupBy(*by).agg(
        F.count("*").alias("sales"), median(F.col("area")).alias("area"), F.percentile("area", F.lit(0.05)).alias("area_p5"), F.percentile("area", F.lit(0.95)).alias("area_p95"), F.min("area").alias("area_min"), F.max("area").alias("area_max"),
        median(F.col("storey_mid")).alias("storey_median"), median(F.col("lease_year").cast("double")).alias("lease_year"), F.mode("flat_model", True).alias("model"),
    )
    bands = sales.groupBy(*by, "storey_mid").agg(F.count("*").alias("_n"))
    near = bands.join(stats.select(*by, "storey_median"), by).groupBy(*by).agg(F.min_by("storey_mid", F.struct(F.abs(F.col("storey_mid") - F.col("storey_median")), "storey_mid")).alias("storey"))
    return stats.join(near, by)
