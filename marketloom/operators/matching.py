"""Matching addresses to building outlines by block and by what the street's code should look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions.numbers import median, to_metres
from marketloom.functions.parsing import street_key

MAX_SPREAD_M = 6_000.0


def match_addresses(addresses: DataFrame, buildings: DataFrame, max_spread: float = MAX_SPREAD_M) -> DataFrame:
    """The addresses (town, block, street_name, ...) with street_code, latitude, longitude and location_source.

    A street takes one code, whatever its towns: the one that covers most of its addresses; of equal ones the one whose
    third letter is hinted. If several remain, the one whose buildings lie nearest to the centre of the street's town
    (its commonest, of equal ones the first by name), then the greater code. A town's centre is the median of all
    buildings on streets whose code is certain. A street whose buildings lie too far from it loses its code. Positions:
    the building, else the street's median, else the town's centre, else none.
    """
    keyed = addresses.select("town", "block", "street_name", street_key(F.col("street_name")).alias("k")).select("town", "block", "street_name", "k.*")
    codes = buildings.where("street_code is not null and latitude is not null").groupBy("block", "street_code").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    hits = keyed.join(codes.withColumn("prefix", F.substring("street_code", 1, 2)), ["block", "prefix"])
    streets = keyed.groupBy("street_name").agg(F.count("*").alias("addresses"), F.mode("town", True).alias("home"))
    options = hits.groupBy("street_name", "street_code").agg(F.count("*").alias("n"), F.max(F.array_contains("hints", F.substring("street_code", 3, 1)).cast("int")).alias("hint"), median(F.col("latitude")).alias("la"), median(F.col("longitude")).alias("lo"))
    options = options.join(streets, "street_name").withColumn("merit", F.struct((F.col("n") / F.col("addresses")).alias("coverage"), "hint"))
    # options with the street's best merit; a street with one of them is certain
    every = Window.partitionBy("street_name")
    tied = options.withColumn("best", F.max("merit").over(every)).where("merit = best").withColumn("ties", F.count("*").over(every))
    certain = tied.where("ties = 1").select("street_name", "street_code", "home")
    centres = hits.join(certain, ["street_name", "street_code"]).groupBy(F.col("home").alias("town")).agg(median(F.col("latitude")).alias("cla"), median(F.col("longitude")).alias("clo"))
    (x, y), (cx, cy) = to_metres(F.col("la"), F.col("lo")), to_metres(F.col("cla"), F.col("clo"))
    away = F.coalesce(F.sqrt((x - cx) ** 2 + (y - cy) ** 2), F.lit(0.0))
    placed = tied.join(centres.withColumnRenamed("town", "home"), "home", "left").withColumn("away", away)
    first = Window.partitionBy("street_name").orderBy("away", F.desc("street_code"))
    chosen = placed.withColumn("r", F.row_number().over(first)).where((F.col("r") == 1) & (F.col("away") <= max_spread)).select("street_name", "street_code", F.col("la").alias("sla"), F.col("lo").alias("slo"))
    out = addresses.join(chosen, "street_name", "left").join(codes, ["block", "street_code"], "left").join(centres, "town", "left")
    source = F.when(F.col("latitude").isNotNull(), "building").when(F.col("sla").isNotNull(), "street").when(F.col("cla").isNotNull(), "town").otherwise("none")
    return out.select(*addresses.columns, "street_code", F.coalesce("latitude", "sla", "cla").alias("latitude"), F.coalesce("longitude", "slo", "clo").alias("longitude"), source.alias("location_source"))


def clean_places(places: DataFrame, cell: float = 0.002) -> DataFrame:
    """Places that have a position. Of malls with the same letters and digits in one grid cell one stays, the first by
    name and position; places of other categories all stay, since exits and stops may share a name."""
    found = places.where("latitude is not null and longitude is not null")
    key = [F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""), F.bround(F.col("latitude") / cell), F.bround(F.col("longitude") / cell)]
    once = found.where("category = 'mall'").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("name", "latitude", "longitude"))).where("_r = 1").drop("_r")
    return found.where(~F.coalesce(F.col("category") == "mall", F.lit(False))).unionByName(once)
