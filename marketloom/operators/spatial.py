"""Distance joins on projected points: grid cells turn them into equi-joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.config import Walk
from marketloom.functions.numbers import to_metres
from marketloom.operators.neighbours import nearest_in_plane
from marketloom.sources.scratch import at_once, stored


def with_metres(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    x, y = to_metres(F.col(latitude), F.col(longitude))
    return df.withColumns({"x_m": x, "y_m": y})


def within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, by: str | None = None) -> DataFrame:
    """(left_id, right_id, metres) of all pairs at most ``radius`` apart, with equal ``by`` if given; both sides have x_m and y_m.

    The right side is dealt to the nine cells around each of its points, so that the join is on the cell.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    also = [by] if by else []
    r = right.where("x_m is not null and y_m is not null").select(F.col(right_id), *also, F.col("x_m").alias("_x"), F.col("y_m").alias("_y"), F.explode(F.transform(near, lambda d: cell("x_m") + d)).alias("_cx"), cell("y_m").alias("_cy0"))
    r = r.withColumn("_cy", F.explode(F.transform(near, lambda d: F.col("_cy0") + d))).drop("_cy0")
    pts = left.where("x_m is not null and y_m is not null").select(F.col(left_id), *also, "x_m", "y_m", cell("x_m").alias("_cx"), cell("y_m").alias("_cy"))
    d = F.sqrt((F.col("x_m") - F.col("_x")) ** 2 + (F.col("y_m") - F.col("_y")) ** 2)
    return pts.join(r, ["_cx", "_cy", *also]).withColumn("metres", d).where(F.col("metres") <= radius).select(left_id, *also, right_id, "metres")


def count_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, name: str = "n") -> DataFrame:
    """(left_id, name): how many right points lie within the radius.

    Space is cut into boxes of a sixteenth of the radius. Cells of right points that are wholly within the radius of a box are added up by
    their counts, once for all rows of the box; only points that are within it for a part of the box are compared with its rows.
    """
    side, box = radius / 16, ["_bx", "_by"]
    known = lambda df: df.where("x_m is not null and y_m is not null and not isnan(x_m) and not isnan(y_m)")
    cell = lambda c: F.floor(F.col(c) / side)
    put = known(left).select(left_id, "x_m", "y_m", cell("x_m").alias("_bx"), cell("y_m").alias("_by"))
    pts = stored(known(right).select(F.col("x_m").alias("_x"), F.col("y_m").alias("_y"), cell("x_m").alias("_cx"), cell("y_m").alias("_cy")))
    boxes = stored(put.select(*box).distinct())
    # steps between cells, by whether all, some or no points of the two lie within the radius of each other
    square = lambda dx, dy: dx * dx + dy * dy
    at = [(dx, dy) for dx in range(-17, 18) for dy in range(-17, 18) if square(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0)) <= 257]
    inner = [s for s in at if square(abs(s[0]) + 1, abs(s[1]) + 1) <= 255]
    moved = lambda df, steps: df.withColumn("_s", F.explode(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in steps]))).withColumns({"_bx": F.col("_cx") + F.col("_s")[0], "_by": F.col("_cy") + F.col("_s")[1]}).drop("_s")
    sums = moved(pts.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")), inner).groupBy(*box).agg(F.sum("_n").alias("_n"))
    gap = lambda c, b: F.greatest(F.col(b) * side - F.col(c), F.col(c) - (F.col(b) + 1) * side, F.lit(0.0))
    far = lambda c, b: F.greatest(F.col(c) - F.col(b) * side, (F.col(b) + 1) * side - F.col(c))
    edge = moved(pts, [s for s in at if s not in set(inner)]).join(boxes, box).select(*box, "_x", "_y", square(far("_x", "_bx"), far("_y", "_by")).alias("_most"), square(gap("_x", "_bx"), gap("_y", "_by")).alias("_least"))
    inside = F.col("_most") <= radius**2 * (1 - 1e-9)
    more = edge.where(inside).groupBy(*box).agg(F.count("*").alias("_n"))
    each = edge.where(~inside & (F.col("_least") <= radius**2 * (1 + 1e-9))).select(*box, "_x", "_y")
    d = F.sqrt((F.col("x_m") - F.col("_x")) ** 2 + (F.col("y_m") - F.col("_y")) ** 2)
    met = put.join(each, box).where(d <= radius).groupBy(*box, left_id).agg(F.count("*").alias("_n")).select(left_id, "_n")
    whole = put.join(sums.unionByName(more).groupBy(*box).agg(F.sum("_n").alias("_n")), box).select(left_id, "_n")
    hits = whole.unionByName(met).groupBy(left_id).agg(F.sum("_n").alias(name))
    return left.select(left_id).join(hits, left_id, "left").fillna(0, [name])


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float = 1000.0, by: str | None = None) -> DataFrame:
    """(left_id, right_id, metres) of the nearest right point (with ``by``: of the same kind), however far, ties to the smaller right id.

    ``by`` may be a column of right alone: then the nearest of every kind. Cells follow the density of the points, down to a thousandth of ``radius``, a usual distance. Only left points for which the right side has none (of their kind) are left out.
    """
    also = [by] if by else []
    return nearest_in_plane(left, right, left_id, right_id, kind=by, least_side=radius / 1000).select(left_id, *also, right_id, "metres")


def nearest_of_kinds(left: DataFrame, places: DataFrame, left_id: str, place_id: str, kind: str, radius: float = 1000.0) -> DataFrame:
    """(left_id, kind, place id, metres): the nearest place of each kind; all kinds in one search. Kinds are few (1,000 at most)."""
    kinds = [r[0] for r in places.select(kind).where(F.col(kind).isNotNull()).distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError(f"too many values of {kind}")
    return nearest(left.drop(kind), places, left_id, place_id, radius, by=kind)


def top_within(left: DataFrame, right: DataFrame, radius: float, k: int, left_id: str, right_id: str, by: str | None = None) -> DataFrame:
    """The k nearest within the radius (of each ``by``), by rank: of the k nearest at any distance those that lie within."""
    also = [by] if by else []
    return nearest_in_plane(left, right, left_id, right_id, k=k, kind=by, radius=F.lit(radius), least_side=radius / 1000).where(F.col("metres") <= radius).select(left_id, *also, "rank", right_id, "metres")


def line_points(lines: DataFrame, line_id: str, step: float = 25.0) -> DataFrame:
    """(line_id, x_m, y_m): points of lines (arrays of [x, y] in metres) at most ``step`` apart."""
    segs = lines.select(line_id, F.explode(F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("p"), F.slice("points", F.lit(2), F.size("points") - 1).alias("q"))).alias("s"))
    p, q = F.col("s").getField("p"), F.col("s").getField("q")
    length = F.sqrt((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)
    dense = segs.withColumn("n", F.greatest(F.lit(1), F.floor(length / step)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("i") / F.col("n")
    return dense.select(line_id, (p[0] + (q[0] - p[0]) * t).alias("x_m"), (p[1] + (q[1] - p[1]) * t).alias("y_m")).distinct()


def nearest_line(left: DataFrame, lines: DataFrame, left_id: str, line_id: str, step: float = 25.0) -> DataFrame:
    """(left_id, line_id, metres): the line with the nearest point, however far."""
    return nearest(left, line_points(lines, line_id, step), left_id, line_id)


def lines_within(left: DataFrame, lines: DataFrame, radius: float, left_id: str, line_id: str, step: float = 25.0) -> DataFrame:
    """(left_id, line_id, metres) of lines that pass within the radius."""
    return within(left, line_points(lines, line_id, step), radius, left_id, line_id).groupBy(left_id, line_id).agg(F.min("metres").alias("metres"))


def block_features(blocks: DataFrame, places: DataFrame, lines: DataFrame | None, block_id: str, groups: dict[str, Column], counts: dict[str, tuple[str, float]], walk: Walk = Walk()) -> DataFrame:
    """One row per block: for each group (name -> which places belong to it) the metres to, name and kind of its nearest place,
    for each count (column -> group, radius) the number within, metres to and name of the nearest line, km to the city.

    places: place, kind, name, x_m, y_m; lines: line, name, points. Groups without a place, and lines if there are none,
    give null columns, so that a missing source stops nothing.
    """
    dealt = places.withColumn("group", F.explode(F.array_compact(F.array(*[F.when(inside, F.lit(g)) for g, inside in groups.items()]))))
    # the searches look at their sides' density first, in many short jobs: they are made side by side
    jobs = [lambda: nearest_of_kinds(blocks, dealt, block_id, "place", "group")]
    jobs += [lambda c=c, g=g, radius=radius: count_within(blocks, dealt.where(F.col("group") == g), radius, block_id, "place", c) for c, (g, radius) in counts.items()]
    jobs += [lambda: nearest_line(blocks, lines, block_id, "line")] if lines is not None else []
    near, *made = at_once(jobs)
    # the nearest place's own columns are joined once, long, before the groups become columns
    near = near.join(places.select("place", "name", "kind"), "place")
    one = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    wide = near.groupBy(block_id).agg(*[x for g in groups for x in (F.bround(one(g, "metres")).alias(f"{g}_m"), one(g, "name").alias(f"{g}_name"), one(g, "kind").alias(f"{g}_kind"))])
    cx, cy = to_metres(F.lit(walk.city[0]), F.lit(walk.city[1]))
    out = blocks.withColumn("city_km", F.bround(F.sqrt((F.col("x_m") - cx) ** 2 + (F.col("y_m") - cy) ** 2) / 1000, 2)).join(wide, block_id, "left")
    for (column, (g, _)), n in zip(counts.items(), made):
        out = out.join(n, block_id, "left").withColumn(column, F.when(F.col(f"{g}_m").isNotNull(), F.col(column)))
    if lines is None:
        return out.withColumns({"line_m": F.lit(None).cast("double"), "line_name": F.lit(None).cast("string")})
    line = made[-1].join(lines.select("line", F.col("name").alias("line_name")), "line")
    return out.join(line.select(block_id, F.bround("metres").alias("line_m"), "line_name"), block_id, "left")


def simplify_lines(lines: DataFrame, tolerance: float, points: str = "points", closed: bool = False) -> DataFrame:
    """Douglas-Peucker on every row's array of [x, y]; closed rings are cut at the vertex farthest from the first, and end where they begin."""
    def keep(xy, tol):
        mark, stack = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
        mark[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            p, q, mid = xy[a], xy[b], xy[a + 1 : b]
            d, length = q - p, float(np.hypot(*(q - p)))
            far = np.hypot(*(mid - p).T) if length == 0 else np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / length
            i = int(far.argmax())
            if far[i] > tol:
                mark[a + 1 + i] = True
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        return xy[mark]

    @F.pandas_udf("array<array<double>>")
    def simple(col: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            xy = np.array([list(p) for p in line], float)
            if not closed:
                return keep(xy, tolerance).tolist()
            if len(xy) < 5:
                return xy.tolist()
            xy = xy[:-1] if (xy[0] == xy[-1]).all() else xy
            far = int(np.hypot(*(xy - xy[0]).T).argmax())
            return np.concatenate([keep(xy[: far + 1], tolerance)[:-1], keep(np.concatenate([xy[far:], xy[:1]]), tolerance)]).tolist()

        return col.map(one)

    return lines.withColumn(points, simple(F.col(points)))
