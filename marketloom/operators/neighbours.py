"""Nearest-k joins of any number of coordinates on a grid that follows the density of the points.

Space is divided by halves, level by level. Every left row begins at the finest level at which its own cell holds enough
right rows, so that a dense place is searched in small cells and an empty one in large ones. The k-th of its cell says how
far the k nearest can be. The row then meets the cells within this bound, at a level whose cells are no smaller than half
of it, and of their rows only those within the bound are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.sources.scratch import stored

#: So many left rows at most, but for those of one box, meet their candidates in one task.
MOST_ROWS = 50_000


#: Of more coordinates those that spread most are searched: a search in n of them meets up to 5^n cells.
MOST_COORDS = 3
#: So many (group, level) pairs at most are sent to all tasks.
MOST_LEVELS = 20_000


def nearest_k(left: DataFrame, right: DataFrame, left_id: str, coords: list[tuple[str, str]], distance: Column, order: list, *, k: int = 1, by: list[str] = (), least_side: float, enough: int = 2) -> DataFrame:
    """The k nearest right rows of every left row (with equal ``by``), all columns of right, ``distance`` and ``rank``.

    coords: pairs of a left and a right column; ``distance``, a column of both sides, must be no less than the difference of
    any of them. Ties go by ``order``, right columns. Rows with a null or NaN coordinate play no part; (left_id, by)
    names a left row; one with fewer
    than k right rows gets all of them. right, which is read several times, should hold each place once, or few rows of it, as
    the k first of a place. Cells are divided down to a side of about ``least_side``, 40 times at most.
    """
    by, key, names = list(by), [left_id, *by], [c for c in right.columns if c not in by]
    given = lambda df, cols: df.where(" and ".join([f"{c} is not null" for c in by] + [f"{c} is not null and not isnan(cast({c} as double))" for c in cols]))
    left, right = given(left, [a for a, _ in coords]), given(right, [b for _, b in coords])
    if len(coords) > MOST_COORDS:
        spread = right.groupBy(*by).agg(*[F.stddev(b).alias(b) for _, b in coords]).agg(*[F.avg(b).alias(b) for _, b in coords]).first()
        coords = sorted(coords, key=lambda c: -(spread[c[1]] or 0.0))[:MOST_COORDS]
    cells = [f"_c{i}" for i in range(len(coords))]
    ends = [df.agg(*[f(c).cast("double") for c in cols for f in (F.min, F.max)]).first() for df, cols in ((left, [a for a, _ in coords]), (right, [b for _, b in coords]))]
    if None in [*ends[0], *ends[1]]:
        return left.select(*key).where("false").crossJoin(right.select(*names).where("false")).select(*key, F.lit(0).alias("rank"), F.lit(0.0).alias("distance"), *names)
    span = max(1e-9, max(max(a, b) - min(c, d) for a, b, c, d in ((ends[0][2 * i + 1], ends[1][2 * i + 1], ends[0][2 * i], ends[1][2 * i]) for i in range(len(coords))))) * 1.0001
    levels = min(40, max(0, math.ceil(math.log2(span / least_side))))
    finest = span / 2**levels
    cell = lambda x: F.floor(x / finest).cast("long")
    placed = [df.withColumns({n: cell(F.col(c[side])) for n, c in zip(cells, coords)}) for side, df in enumerate((left, right))]
    at = lambda n: F.expr(f"shiftright({n}, {levels} - _level)")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))

    # how many right rows a cell has, at each level; a left row's first level is the finest whose own cell has enough
    full = placed[1].groupBy(*by, *cells).agg(F.count("*").alias("n")).withColumn("_level", every).groupBy(*by, "_level", *[at(n).alias(n) for n in cells]).agg(F.sum("n").alias("n")).where(F.col("n") >= max(enough, k)).drop("n")
    own = placed[0].select(*key, *cells).withColumn("_level", every).select(*key, "_level", *[at(n).alias(n) for n in cells])
    first = own.join(full, [*by, "_level", *cells], "left_semi").groupBy(*key).agg(F.max("_level").alias("_level"))
    open_ = stored(placed[0].join(first, key, "left").withColumn("_level", F.coalesce("_level", F.lit(0))))

    def met(asked: DataFrame, used: DataFrame) -> DataFrame:
        """The rows of asked, each with the right rows of its cell, and their distance; used: the (by, _level) among them."""
        used = stored(used.distinct())
        used = F.broadcast(used) if used.count() <= MOST_LEVELS else used
        dealt = (placed[1].join(used, by) if by else placed[1].crossJoin(used)).select(*by, "_level", *[at(n).alias(n) for n in cells], *names)
        return asked.join(dealt, [*by, "_level", *cells]).withColumn("distance", distance)

    best = Window.partitionBy(*key).orderBy("distance", *order)
    near = met(open_.withColumns({n: at(n) for n in cells}), open_.select(*by, "_level")).select(*key, "distance")
    bound = near.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("distance"))).where(F.col("_n") == k).select(*key, F.col("distance").alias("_bound"))
    # without a bound, because fewer than k rows were met, all cells of level 0 are near
    wide = F.when(F.col("_bound") > 0, F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(2 * span / F.col("_bound")) - 1e-6).cast("int")))).otherwise(F.lit(levels))
    open_ = stored(open_.drop("_level", *cells).join(bound, key, "left").withColumn("_level", F.when(F.col("_bound").isNull(), F.lit(0)).otherwise(wide)))
    asked, reach = open_, F.col("_bound") * (1 + 1e-9) + span * 1e-9
    for i, (n, (a, _)) in enumerate(zip(cells, coords)):
        low, high = ends[1][2 * i], ends[1][2 * i + 1]
        edge = [F.coalesce(F.greatest(F.col(a) - reach, F.lit(low)), F.lit(low)), F.coalesce(F.least(F.col(a) + reach, F.lit(high)), F.lit(high))]
        asked = asked.withColumns({"_low": cell(edge[0]), "_high": cell(edge[1])}).withColumn(n, F.explode(F.sequence(at("_low"), at("_high")))).drop("_low", "_high")
    within = met(asked, open_.select(*by, "_level")).where(F.col("_bound").isNull() | (F.col("distance") <= F.col("_bound")))
    return within.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*key, "rank", "distance", *names)


def nearest_in_plane(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, k: Column | int = 1, kind: str | None = None, station: list[str] = (), radius: Column | None = None, least_side: float = 1.0) -> DataFrame:
    """(left_id, kind, rank, right_id, metres): the k nearest right points (of each kind) of every left point, ties to the smaller right id.

    Left points are put into boxes that follow the density of both sides, and the search is made once for a box. A cell around it
    with k points says how far the k-th can be, which leaves the cells around that one; of their points a box keeps those that may
    be among the k nearest somewhere in it. Only these are compared with the box's own rows.

    Both sides have x_m and y_m; rows with a null or NaN there play no part. If left has ``kind``, its rows meet their own kind only.
    station: columns of right of which each combination counts once, by its nearest point. k and radius may depend on ``kind``;
    beyond the radius only the nearest point is sure to be found.
    """
    also, box = [kind] if kind else [], ["_level", "_bx", "_by"]
    own = [kind] if kind and kind in left.columns else []
    k = F.lit(k) if isinstance(k, int) else k
    known = lambda df, *cols: df.where(" and ".join([f"{c} is not null" for c in cols] + [f"{c} is not null and not isnan(cast({c} as double))" for c in ("x_m", "y_m")]))
    l, r = known(left.select(left_id, *own, "x_m", "y_m"), *own), known(right.select(right_id, *also, *station, "x_m", "y_m"), *also)
    first = Window.partitionBy(*also, *station, "x_m", "y_m").orderBy(right_id)
    r = r.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= (F.lit(1) if station else k)).select(right_id, *also, *station, F.col("x_m").alias("_x"), F.col("y_m").alias("_y"))
    # points and boxes are few bytes, but one meets many others: they are dealt to all cores, not by what they weigh
    cores = left.sparkSession.sparkContext.defaultParallelism
    r = stored(r.repartition(cores, "_x", "_y"))
    ends = [df.agg(*[f(c).cast("double") for c in cols for f in (F.min, F.max)]).first() for df, cols in ((l, ("x_m", "y_m")), (r, ("_x", "_y")))]
    if None in [*ends[0], *ends[1]]:
        return l.select(left_id, *own).where("false").crossJoin(r.drop(*own).where("false")).select(left_id, *also, F.lit(0).alias("rank"), right_id, F.lit(0.0).alias("metres"))
    span = max(1e-9, *[max(ends[0][i + 1], ends[1][i + 1]) - min(ends[0][i], ends[1][i]) for i in (0, 2)]) * 1.0001
    levels = min(40, max(0, math.ceil(math.log2(span / least_side))))
    finest = span / 2**levels
    cell = lambda x, n: F.floor(F.col(x) / finest).cast("long").alias(n)
    up = lambda n, by: F.expr(f"shiftright({n}, {by})")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")

    # a box is one level below the finest cell that holds many left rows or some right ones
    counts = l.select(cell("x_m", "_cx"), cell("y_m", "_cy"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(r.select(cell("_x", "_cx"), cell("_y", "_cy"), F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("_cx", "_cy").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    high = counts.select("*", every).withColumns({"_bx": up("_cx", f"{levels} - _level"), "_by": up("_cy", f"{levels} - _level")})
    full = high.groupBy(*box).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 32 or b >= 16").select(*box)
    fit = high.where("a > 0").select("_cx", "_cy", *box).join(full, box, "left_semi").groupBy("_cx", "_cy").agg(F.max("_level").alias("_level"))
    put = l.select("*", cell("x_m", "_cx"), cell("y_m", "_cy")).join(fit, ["_cx", "_cy"], "left").withColumn("_level", F.least(F.lit(levels), F.coalesce("_level", F.lit(-1)) + 1))
    put = stored(put.select(left_id, *own, "x_m", "y_m", "_level", up("_cx", f"{levels} - _level").alias("_bx"), up("_cy", f"{levels} - _level").alias("_by")))

    # the finest cell around a box that holds enough right points; at level 0 all of them are near
    parts = max(cores, math.ceil(put.count() / MOST_ROWS))
    boxes = put.select(*box, *own).distinct()
    boxes = boxes if own or not kind else boxes.crossJoin(F.broadcast(r.select(kind).distinct()))
    dealt = r.select("*", cell("_x", "_cx"), cell("_y", "_cy"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_up"))
    dealt = dealt.select(*also, "_up", up("_cx", f"{levels} - _up").alias("_ax"), up("_cy", f"{levels} - _up").alias("_ay"), right_id, *station, "_x", "_y")
    held = F.count_distinct(F.struct(*station)) if station else F.count("*")
    enough = dealt.groupBy(*also, "_up", "_ax", "_ay").agg(held.alias("n")).where(F.col("n") >= k).drop("n")
    above = boxes.withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("_level")))).withColumns({"_ax": up("_bx", "_level - _up"), "_ay": up("_by", "_level - _up")})
    reached = above.join(enough, [*also, "_up", "_ax", "_ay"], "left_semi").groupBy(*box, *also).agg(F.max("_up").alias("_up"))
    asked = boxes.join(reached, [*box, *also], "left").repartition(parts, *box).withColumn("_up", F.coalesce("_up", F.lit(0))).withColumns({"_ax": up("_bx", "_level - _up"), "_ay": up("_by", "_level - _up")})

    # least and greatest distance of a point from a box
    side = F.lit(finest) * F.pow(F.lit(2.0), levels - F.col("_level"))
    gap = lambda c, b: F.greatest(F.col(b) * side - F.col(c), F.col(c) - (F.col(b) + 1) * side, F.lit(0.0))
    far = lambda c, b: F.greatest(F.col(c) - F.col(b) * side, (F.col(b) + 1) * side - F.col(c))
    length = lambda a, b: F.sqrt(a * a + b * b)
    least, most = length(gap("_x", "_bx"), gap("_y", "_by")), length(far("_x", "_bx"), far("_y", "_by"))
    of, slack = [*box, *also], span * 1e-9

    def counted(some: DataFrame) -> DataFrame:
        """``_nth``: how many points (stations) are met up to this one, in the order of their greatest distance."""
        if station:
            some = some.withColumn("_one", (F.row_number().over(Window.partitionBy(*of, *station).orderBy("_most")) == 1).cast("int"))
        return some.withColumn("_nth", F.sum("_one" if station else F.lit(1)).over(Window.partitionBy(*of).orderBy("_most").rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # the cell's own points say how far the k-th can be, if there are so many; then the cells and points within this bound are met
    inside = counted(asked.join(dealt, [*also, "_up", "_ax", "_ay"]).withColumn("_most", most))
    asked = asked.join(inside.where(F.col("_nth") >= k).groupBy(*of).agg(F.min("_most").alias("_bound")), of, "left").repartition(parts, *box)
    steps = F.sequence(F.lit(-2), F.lit(2))
    asked = asked.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_ax": F.col("_ax") + F.col("_dx"), "_ay": F.col("_ay") + F.col("_dy")})
    wide = F.lit(finest) * F.pow(F.lit(2.0), levels - F.col("_up"))
    apart = lambda c, b: F.greatest(F.col(c) * wide - (F.col(b) + 1) * side, F.col(b) * side - (F.col(c) + 1) * wide, F.lit(0.0))
    within = lambda d: F.col("_bound").isNull() | (d <= F.col("_bound") + slack)
    asked = asked.where(within(length(apart("_ax", "_bx"), apart("_ay", "_by"))))
    some = asked.join(dealt, [*also, "_up", "_ax", "_ay"]).withColumns({"_least": least, "_most": most}).where(within(F.col("_least")))
    # again among all of these, for a closer bound
    whole = Window.partitionBy(*of)
    some = counted(some).withColumns({"_kth": F.min(F.when(F.col("_nth") >= k, F.col("_most"))).over(whole), "_next": F.min("_most").over(whole)})
    kept = some.where(F.col("_kth").isNull() | (F.col("_least") <= F.col("_kth") + slack))
    if radius is not None:
        kept = kept.where((F.col("_least") <= radius + slack) | (F.col("_least") <= F.col("_next") + slack))
    kept = kept.select(*box, *also, right_id, *station, "_x", "_y")

    dx, dy = F.col("x_m") - F.col("_x"), F.col("y_m") - F.col("_y")
    pairs = put.repartition(parts, *box).join(kept.repartition(parts, *box).hint("shuffle_hash"), [*box, *own]).select(*box, left_id, *also, right_id, *station, length(dx, dy).alias("metres"))
    by = [*box, left_id, *also]  # with the box, as the rows lie
    if station:
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *station).orderBy("metres", right_id))).where("_n = 1")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("metres", right_id))).where(F.col("rank") <= k)
    return ranked.select(left_id, *also, "rank", right_id, "metres")
