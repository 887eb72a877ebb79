"""Exact quantiles of many overlapping groups, read off tables of value counts.

Rows are counted by cell (month and keys) and bin, an interval of values; these counts are merged over months into windows and
over keys into totals. The running totals of a group's bins (a bounded number) tell in which bin a rank lies. Then only
values inside such bins are counted, and the rank is read off. So no row is copied by month or total, and a group of any
size is counted by all tasks; none is ever sorted or held whole.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import ALL
from marketloom.sources.scratch import stored

#: Bins between a number and its double.
BINS = 8
#: Bins that hold more values than this are divided again before their values are merged.
MOST_VALUES = 1_000_000
#: A list of wanted bins up to so many rows is sent to every executor; a longer one is shuffled.
MOST_WANTED = 400_000


@dataclass(frozen=True)
class Span:
    """Quantiles of a measure: ``labels`` maps the column ``month`` to an array of the (date) groups that the month belongs to."""

    measure: str
    labels: Column
    probs: tuple[float, ...] = (0.5,)


def every_month() -> Column:
    return F.array(F.col("month"))


def this_and_next(n: int) -> Column:
    """A month belongs to its own window and to those of the following months: windows of n months, named by their last."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.add_months("month", i))


def only(inside: Column) -> Column:
    """One group of the months for which the condition holds."""
    none = F.lit(None).cast("date")
    return F.when(inside, F.array(none)).otherwise(F.array().cast("array<date>"))


def bin_of(x: Column, bins: int) -> Column:
    """A whole number that never falls as x grows, and rises by ``bins`` from a number to its double; the same for x and -x but for the sign."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    place = F.floor(bins * (power + 1099 + size / F.pow(F.lit(2.0), power)))
    return F.when(x > 0, place).when(x < 0, -place).otherwise(F.lit(0)).cast("long")


def counted(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(measure, month, keys, value, n = 1): a row for each value of each row. Rows with a null key or month and values that are
    null or NaN are left out. Rows without a column ``month``, the first day of one, are all of one month."""
    kept = (rows if "month" in rows.columns else rows.withColumn("month", F.lit("1970-01-01").cast("date"))).where(" and ".join(f"{k} is not null" for k in ["month", *keys]))
    if len(measures) == 1:
        [(m, x)] = measures.items()
        long = kept.select(F.lit(m).alias("measure"), "month", *keys, x.cast("double").alias("value"))
    else:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), x.cast("double").alias("value")) for m, x in measures.items()])).alias("_m")
        long = kept.select("month", *keys, each).select("_m.measure", "month", *keys, "_m.value")
    long = long.where("value is not null and not isnan(value)")
    return long.withColumn("n", F.lit(1).cast("long"))


def subsets(keys: list[str], totals: bool) -> list[list[str]]:
    return [list(s) for k in range(len(keys), -1, -1) for s in itertools.combinations(keys, k)] if totals else [list(keys)]


def labelled(counts: DataFrame, spans: dict[str, Span]) -> DataFrame:
    """A row of counts for each (span, label) that it belongs to."""
    none = F.array().cast("array<struct<span:string,label:date>>")
    named = lambda name: lambda d: F.struct(F.lit(name).alias("span"), d.alias("label"))
    each = [F.when(F.col("measure") == s.measure, F.transform(s.labels, named(name))).otherwise(none) for name, s in spans.items()]
    return counts.withColumn("_s", F.explode(F.concat(*each))).select("*", "_s.span", "_s.label").drop("_s")


def ranks(total: Column, s: Span) -> list[Column]:
    """The places (from 0) on either side of each quantile."""
    return [f((total - 1) * p).cast("long") for p in s.probs for f in (F.floor, F.ceil)]


def places(bins: DataFrame, group: list[str], spans: dict[str, Span]) -> DataFrame:
    """(group, bin, rank, within, total, size): the bins (group, bin, n) in which the ranks lie, and their place in them."""
    # sorted by a number first: comparing that settles most of a sort's steps
    whole = Window.partitionBy("_hash", *group)
    cum = bins.withColumn("_hash", F.xxhash64(*group)).withColumns({"_to": F.sum("n").over(whole.orderBy("bin")), "total": F.sum("n").over(whole)})
    inside = lambda r: (r >= F.col("_to") - F.col("n")) & (r < F.col("_to"))
    some, each = F.lit(False), F.array().cast("array<long>")
    for name, s in spans.items():
        mine, own = F.col("span") == name, ranks(F.col("total"), s)
        for r in own:
            some = some | (mine & inside(r))
        each = F.when(mine, F.array_distinct(F.array(*own))).otherwise(each)
    # most bins hold no rank and go before any list is made
    found = cum.where(some).withColumn("rank", F.explode(each)).where(inside(F.col("rank")))
    return found.select(*group, "bin", "rank", (F.col("rank") - F.col("_to") + F.col("n")).alias("within"), "total", F.col("n").alias("size"))


def wanted_cells(cells: DataFrame, wanted: DataFrame, keys: list[str], totals: bool, finer: int = 1) -> DataFrame:
    """(measure, month, keys, bin, gids): the bins of cells whose values are wanted, each with all that want it, for totals too.
    The cells' bins are divided into ``finer`` of the wanted ones."""
    place = ["measure", "month", *keys]
    met = cells.select(*place, F.col("bin").alias("_bin"))
    wanted = wanted.withColumn("_bin", (F.signum("bin") * F.floor(F.abs("bin") / finer)).cast("long"))
    if totals and keys:
        each = [F.struct(*[(F.col(k) if k in s else F.lit(ALL)).alias(f"_{k}") for k in keys]) for s in subsets(keys, True)]
        met = met.withColumn("_k", F.explode(F.array(*each))).select("*", "_k.*").drop("_k")
        met = met.join(wanted.withColumnsRenamed({k: f"_{k}" for k in keys}), ["measure", "month", "_bin", *[f"_{k}" for k in keys]])
    else:
        met = met.join(wanted, [*place, "_bin"])
    return met.groupBy(*place, "bin").agg(F.collect_list("gid").alias("gids"))


def values_inside(counts: DataFrame, wanted: DataFrame, keys: list[str], totals: bool, bins: int, cells: DataFrame | None = None, finer: int = 1) -> DataFrame:
    """(gid, value, n): the counts that lie in the wanted bins (gid, measure, month, keys, bin), for every rank that wants them.
    A count is looked up once, by its own cell (see ``wanted_cells``), whatever totals it belongs to."""
    place = ["measure", "month", *keys, "bin"]
    binned = counts.withColumn("bin", bin_of(F.col("value"), bins))
    level = stored(wanted_cells(binned.select(*place).distinct() if cells is None else cells, wanted, keys, totals, finer))
    small = level.count() <= MOST_WANTED
    return binned.join(F.broadcast(level) if small else level, place).select(F.explode("gids").alias("gid"), "value", "n")


def at_place(parts: DataFrame, ranks_: DataFrame, small: bool, by: str) -> DataFrame:
    """The row of parts (gid, by, n) in which the place ``within`` of each gid lies, with what ranks_ knows of it; _before: n of the rows before it."""
    cum = parts.withColumn("_to", F.sum("n").over(Window.partitionBy("gid").orderBy(by)))
    facts = ranks_.select("gid", "within", "rank", "total")
    met = cum.join(F.broadcast(facts) if small else facts, "gid")
    return met.where((F.col("within") < F.col("_to")) & (F.col("within") >= F.col("_to") - F.col("n"))).withColumn("_before", F.col("_to") - F.col("n"))


def quantiles(counts: DataFrame, keys: list[str], spans: dict[str, Span], *, totals: bool = True, bins: int = BINS) -> DataFrame:
    """(span, label, keys, total, q: the span's quantiles in order) of every group that has values.

    counts: (measure, month, keys, value, n), see ``counted``; they are read twice, and may be merged before. With ``totals`` every
    combination of keys is also rolled up, named ``ALL``. Quantiles are exact, with linear interpolation.
    """
    group = ["span", "label", *keys]
    cells = stored(counts.groupBy("measure", "month", *keys, bin_of(F.col("value"), bins).alias("bin")).agg(F.sum("n").alias("n")))
    dealt = labelled(cells, spans)
    if totals and keys:
        merged = dealt.groupingSets([["span", "label", "bin", *s] for s in subsets(keys, True)], "span", "label", "bin", *keys).agg(F.sum("n").alias("n"))
        merged = merged.withColumns({k: F.coalesce(k, F.lit(ALL)) for k in keys})  # keys are never null in counts
    else:
        merged = dealt.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    found = stored(places(merged, group, spans).withColumn("gid", F.monotonically_increasing_id()))
    ends = cells.agg(F.min("month").alias("_a"), F.max("month").alias("_z"))
    measures = F.explode(F.array(*[F.lit(m) for m in sorted({s.measure for s in spans.values()})])).alias("measure")
    months = labelled(ends.where("_a is not null").select(measures, F.explode(F.sequence("_a", "_z", F.expr("interval 1 month"))).alias("month")), spans).select("measure", "month", F.col("span").alias("_span"), F.col("label").alias("_label"))

    def dated(ranks_: DataFrame) -> DataFrame:
        """A row for each month of the group's window, by which counts meet it."""
        met = ranks_.join(months, (ranks_["span"] == months["_span"]) & ranks_["label"].eqNullSafe(months["_label"]))
        return stored(met.select("gid", "measure", "month", *keys, "bin"))

    wanted = dated(found)
    n, largest = found.agg(F.count("*"), F.max("size")).first()
    small = n <= MOST_WANTED
    first = bins
    while (largest or 0) > MOST_VALUES and bins < BINS * 256**5:
        finer = bins * 256
        parts = values_inside(counts, wanted, keys, totals, bins, cells, bins // first).groupBy("gid", bin_of(F.col("value"), finer).alias("bin")).agg(F.sum("n").alias("n"))
        here = at_place(parts, found, small, "bin").select("gid", "bin", (F.col("within") - F.col("_before")).alias("within"), F.col("n").alias("size"))
        found, bins = stored(found.drop("bin", "within", "size").join(here, "gid")), finer
        wanted, largest = dated(found), found.agg(F.max("size")).first()[0]
    merged = values_inside(counts, wanted, keys, totals, bins, cells, bins // first).groupBy("gid", "value").agg(F.sum("n").alias("n"))
    read = at_place(merged, found, small, "value").select("gid", "value")
    at = found.join(read, "gid").groupBy(*group, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    out = F.array().cast("array<double>")
    for name, s in spans.items():
        each = []
        for p in s.probs:
            place = (F.col("total") - 1) * p
            low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
            a, b = F.col("_at")[low], F.col("_at")[high]
            each.append(F.when(low == high, a).otherwise((high - place) * a + (place - low) * b))
        out = F.when(F.col("span") == name, F.array(*each)).otherwise(out)
    return at.select(*group, "total", out.alias("q"))
