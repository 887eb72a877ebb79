"""The test tables as a market: a sale per line item, customers as blocks, suppliers as places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.numbers import to_metres


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, by orders in as many partitions as the session has cores if the files have fewer splits: a small file is read by one task."""
    df, cores = table(spark, sf_dir, "lineitem"), spark.sparkContext.defaultParallelism
    return df.repartition(cores, "l_orderkey") if df.rdd.getNumPartitions() < cores else df


def _place(key: str) -> tuple:
    k = F.col(key)
    return (1.25 + (k * 7919 % 10007) / 10007 * 0.2), (103.65 + (k * 104729 % 10009) / 10009 * 0.35)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = lines_of_orders(spark, sf_dir).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    month = F.trunc("l_shipdate", "MM")
    return joined.select(
        month.alias("month"), F.col("n_name").alias("town"), F.col("p_type").alias("flat_type"), F.col("p_brand").alias("flat_model"), F.col("l_quantity").alias("area"), F.col("p_size").cast("double").alias("storey_mid"),
        (1960 + F.col("l_partkey") % 35).alias("lease_year"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("psm"), F.col("o_custkey").alias("block"), F.col("c_mktsegment").alias("street"),
        ((F.year(month) - 1995) * 12 + F.month(month) - 1).cast("double").alias("months_since_start"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("sale_id"),
    )


def last_month(spark: SparkSession, sf_dir: str):
    """The last complete month: the one before the latest shipment's."""
    return table(spark, sf_dir, "lineitem").agg(F.add_months(F.trunc(F.max("l_shipdate"), "MM"), -1).alias("m")).first()["m"]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    la, lo = _place("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("block"), la.alias("latitude"), lo.alias("longitude"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    la, lo = _place("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 6).cast("int").alias("kind"), la.alias("latitude"), lo.alias("longitude"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as text records, with every kind of damage injected by the part's and order's number."""
    t = lambda n: table(spark, sf_dir, n)
    j = lines_of_orders(spark, sf_dir).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    k = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 100
    s = F.col("p_size")
    lease = F.when(k == 1, "120 years").when(k % 3 == 0, "").otherwise(F.concat((1960 + F.col("l_partkey") % 35 + 99 - F.year("l_shipdate")).cast("string"), F.lit(" years 0"), (F.col("l_orderkey") % 10).cast("string"), F.lit(" months")))
    return j.select(
        F.when(k == 2, "2024/01").when(k == 3, "2030-01").otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("month"), F.when(k == 4, "  ").otherwise(F.lower("p_brand")).alias("town"), F.when(k == 5, "").otherwise(F.col("p_type")).alias("flat_type"),
        F.col("l_partkey").cast("string").alias("block"), F.lit("TEST ST").alias("street_name"), F.when(k == 6, "HIGH").otherwise(F.concat(s.cast("string"), F.lit(" TO "), (s + 2).cast("string"))).alias("storey_range"),
        F.when(k == 7, "0").when(k == 8, "900").otherwise((F.col("l_quantity").cast("int") + 20).cast("string")).alias("floor_area_sqm"), F.col("p_brand").alias("flat_model"), (1960 + F.col("l_partkey") % 35).cast("string").alias("lease_commence_date"),
        lease.alias("remaining_lease"), F.when(k == 9, "0").when(k == 10, "n/a").otherwise(F.col("l_extendedprice").cast("int").cast("string")).alias("resale_price"),
    )


#: Category and kind of a supplier as a place, by its key modulo 8.
PLACE_TYPES = (("train", "MRT"), ("bus", None), ("school", "Primary"), ("mall", None), ("hawker", None), ("park", None), ("train", "LRT"), ("school", "Secondary"))


def typed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places of several categories, named by every third one's neighbour, so that names repeat."""
    la, lo = _place("s_suppkey")
    types = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).cast("string").alias("kind")) for c, k in PLACE_TYPES])
    t = F.get(types, (F.col("s_suppkey") % 8).cast("int"))
    name = F.concat(F.lit("Place "), F.floor(F.col("s_suppkey") / 24).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), t["category"].alias("category"), t["kind"].alias("kind"), name.alias("name"), la.alias("latitude"), lo.alias("longitude"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as straight lines between two points, in metres."""
    def at(k):
        la, lo = 1.25 + (k * 7919 % 10007) / 10007 * 0.2, 103.65 + (k * 104729 % 10009) / 10009 * 0.35
        return F.array(*to_metres(la, lo))

    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("name"), F.array(at(k * 37 + 5), at(k * 101 + 11)).alias("points"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as addresses: 37 streets that run through several towns, block numbers that repeat in every street."""
    c = F.col("c_custkey")
    street = F.concat(F.substring("c_mktsegment", 1, 4), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in STREET_WORDS]), (c % 7 + 1).cast("int")), F.lit(" ST"))
    return table(spark, sf_dir, "customer").select((c % 5).cast("string").alias("town"), (F.floor(c / 5) % 400).cast("string").alias("block"), street.alias("street_name"))


STREET_WORDS = ("NTH", "STH", "AVE", "RISE", "BT", "UPP", "LOOP")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as building outlines: every block number under several codes."""
    k = F.col("p_partkey")
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("BU", "MA", "AU", "FU", "HO")]), (k % 5 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("N", "S", "A", "R", "U", "L", "X")]), (k % 7 + 1).cast("int")), (k % 2).cast("string"))
    return table(spark, sf_dir, "part").select((F.floor(k / 5) % 400).cast("string").alias("block"), code.alias("street_code"), (1.25 + k % 5 * 0.03 + (k * 7919 % 10007) / 10007 * 0.02).alias("latitude"), (103.65 + k % 5 * 0.05 + (k * 104729 % 10009) / 10009 * 0.02).alias("longitude"))
