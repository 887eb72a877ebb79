"""A town map from planning areas: projection, ring measures, grouping into towns, colour classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.numbers import ring_area_centroid, ring_path

#: The town of all central areas, and areas whose town has another name.
CENTRAL, ALIASES = "CENTRAL AREA", {"KALLANG": "KALLANG/WHAMPOA"}


def project(rings: DataFrame, ring: str = "ring", width: float = 1000.0) -> DataFrame:
    """Rings of [lon, lat] scaled to a box ``width`` wide, y downwards, and ``view_height``; the scale comes from all rings.

    A degree of longitude is as wide as the cosine of the middle latitude says.
    """
    pts = rings.select(F.explode(ring).alias("p"))
    box = pts.agg(F.min(F.col("p")[0]).alias("x0"), F.max(F.col("p")[0]).alias("x1"), F.min(F.col("p")[1]).alias("y0"), F.max(F.col("p")[1]).alias("y1"))
    narrow = F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    box = box.withColumns({"kx": narrow, "scale": F.lit(width) / ((F.col("x1") - F.col("x0")) * narrow)})
    moved = F.transform(ring, lambda p: F.array((p[0] - F.col("x0")) * F.col("kx") * F.col("scale"), (F.col("y1") - p[1]) * F.col("scale")))
    out = rings.join(F.broadcast(box)).withColumns({ring: moved, "view_height": (F.col("y1") - F.col("y0")) * F.col("scale")})
    return out.drop("x0", "x1", "y0", "y1", "kx", "scale")


def town_map(rings: DataFrame, towns: DataFrame, least_area: float = 12.0) -> DataFrame:
    """One row per shape: kind, name, region, area, area-weighted label point, planning areas, whether several were merged, path.

    rings: planning_area, region, central_area, ring (projected and simplified). An area is drawn as the central town if
    flagged and that is a town, else as the town of its alias or name; else it is context by its own name.
    """
    alias = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    listed = towns.select(F.upper("town").alias("name")).distinct()
    central = listed.where(F.col("name") == CENTRAL).select(F.lit(True).alias("has_central"))
    m = rings.withColumn("m", ring_area_centroid(F.col("ring"))).where((F.col("m.area") >= least_area) & (F.size("ring") >= 4))
    m = m.join(F.broadcast(central), how="left").withColumn("name", F.when(F.col("central_area") & F.col("has_central"), F.lit(CENTRAL)).otherwise(F.coalesce(F.try_element_at(alias, "planning_area"), "planning_area")))
    m = m.join(listed.withColumn("is_town", F.lit(True)), "name", "left").withColumns({"kind": F.when(F.col("is_town"), "town").otherwise("context"), "name": F.when(F.col("is_town"), F.col("name")).otherwise(F.col("planning_area"))})
    a = F.col("m.area")
    out = m.groupBy("kind", "name").agg(
        F.min("region").alias("region"), F.sum(a).alias("area"), (F.sum(F.col("m.x") * a) / F.sum(a)).alias("label_x"), (F.sum(F.col("m.y") * a) / F.sum(a)).alias("label_y"), F.sort_array(F.collect_set("planning_area")).alias("planning_areas"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-a, ring_path(F.col("ring")).alias("path")))), lambda s: s["path"]), "").alias("svg_path"),
    )
    return out.withColumn("merged", F.size("planning_areas") > 1)


def towns_not_drawn(shapes: DataFrame, towns: DataFrame) -> DataFrame:
    return towns.select(F.upper("town").alias("name")).distinct().join(shapes.where("kind = 'town'").select("name"), "name", "left_anti")


def shape_table(shapes: DataFrame) -> DataFrame:
    """Shapes as a table without arrays; context has only its name and path."""
    town = F.col("kind") == "town"
    only = lambda c, n: F.when(town, F.bround(c, n))
    return shapes.select("kind", "name", F.when(town, F.col("region")).alias("region"), "svg_path", only("label_x", 1).alias("label_x"), only("label_y", 1).alias("label_y"), only("area", 1).alias("area"), (town & F.col("merged")).alias("merged"), F.array_join("planning_areas", ", ").alias("planning_areas"))


def shapes_from_table(table: DataFrame) -> DataFrame:
    """The inverse of ``shape_table``, but for what it rounds and leaves out."""
    return table.withColumn("planning_areas", F.split("planning_areas", ", "))


def colour_breaks(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """One row: the sorted values at floor(q n), counted from 0, for q = 1/5, 2/5, ...; none if there are fewer values than classes.

    One value a town is meant; more than 10,000 are an error, since they are sorted in one place.
    """
    values = df.where(F.col(value).isNotNull()).select(value)
    if values.limit(10_001).count() > 10_000:
        raise ValueError("colour_breaks takes one row per town")
    x = values.agg(F.sort_array(F.collect_list(value)).alias("x"))
    at = F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda i: F.get("x", F.floor(i * F.size("x") / classes).cast("int")))
    return x.select(F.when(F.size("x") >= classes, at).otherwise(F.array().cast(df.select(F.array(value)).dtypes[0][1])).alias("breaks"))


def shade(value: Column, breaks: Column, middle: int = 2) -> Column:
    """Class of a value: how many of the breaks it has reached; the middle one without breaks, null for no value."""
    return F.when(value.isNotNull(), F.when(F.size(breaks) == 0, F.lit(middle)).otherwise(F.size(F.filter(breaks, lambda b: b <= value))))
