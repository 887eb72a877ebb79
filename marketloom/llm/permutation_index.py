"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. Vectors are dealt into shards; within a shard each pivot
has an inverted file of (vector, rank of the pivot). A query reads the files of its own nearest pivots, ranks the
shard's vectors by the footrule distance between the orders, and the best part is measured exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.stored import Tables

PAIRS = "asked long, query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the rows that take part: id and vector are not null, all components finite, not all of them 0."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"))


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the ``depth`` nearest pivots of each row of x, nearest first; ties by the pivot's number."""
    d = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :depth]


def search_shard(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, qids: np.ndarray, q: np.ndarray, pivots: np.ndarray, depth: int, share: float, least: int, k: int):
    """(query row, query id, id, distance) of the k nearest that the index finds in one shard; its rows come by id.

    Equal vectors are one entry of the index, with all their ids, so that a common vector takes no other's place.
    """
    same = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, entry = np.unique(same, return_index=True, return_inverse=True)
    by_id = np.argsort(first)  # entries by their smallest id
    place = np.empty_like(by_id)
    place[by_id] = np.arange(len(by_id))
    entry, x = place[entry], x[first[by_id]]
    rows = np.argsort(entry, kind="stable")
    ends = np.cumsum(np.bincount(entry))
    n, out = len(x), []
    rank = orders(x, pivots, depth)
    pivot = rank.ravel()
    by = np.argsort(pivot, kind="stable")
    starts = np.searchsorted(pivot[by], np.arange(len(pivots) + 1))
    who, at = by // depth, (by % depth).astype(np.int32)
    want = min(n, max(least, int(np.ceil(share * n))))
    for i, own in enumerate(orders(q, pivots, depth)):
        # a pivot that is missing from an order counts as one behind its last
        gain = np.zeros(n, np.int32)
        for r, p in enumerate(own):
            a, b = starts[p], starts[p + 1]
            gain[who[a:b]] += (depth - r) + (depth - at[a:b]) - np.abs(r - at[a:b])
        near = np.arange(n)
        if want < n:
            least_gain = np.partition(gain, n - want)[n - want]
            near = np.flatnonzero(gain > least_gain)
            near = np.concatenate((near, np.flatnonzero(gain == least_gain)[: want - len(near)]))  # ties to the smaller id
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        best = []
        # one entry more than rows are wanted, since the query's own id may stand in one
        for t in np.lexsort((near, d))[: k + 1]:
            e = near[t]
            score = float(np.sqrt(((x[e] - q[i]) ** 2).sum()))
            listed = ids[rows[ends[e - 1] if e else 0 : ends[e]]]
            best += [(score, int(v)) for v in listed[listed != qids[i]][:k]]
        out += [(int(asked[i]), int(qids[i]), v, score) for score, v in sorted(best)[:k]]
    return out


def search(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, n_pivots: int = 256,
    depth: int = 48, share: float = 0.3, least: int = 256, shard_rows: int = 8192, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among the other rows, by Euclidean distance, ties to the smaller id.

    The pivots are the ``n_pivots`` different vectors with the lowest hash (a bounded sample); every row is indexed. Of each
    shard (about ``shard_rows`` rows) a query measures the ``share`` with the best footrule, ``least`` at least.
    Shards and blocks of ``block_rows`` queries meet in tasks of their own, so that a task's size is bounded.
    Vectors that are null, zero, of another length than the first pivot's, or hold null or non-finite components take
    no part. Rows that repeat an id or a vector are all candidates, but for rows with the query's own id; query rows
    that repeat an id are each asked, with ranks of their own.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "permutation")
    rows, asked = tables.keep(valid_vectors(vectors, id_col, vector_col)), tables.keep(valid_vectors(queries, id_col, vector_col))
    # narrow hashes are sorted; the vectors of the chosen ones follow, one of each
    hashed = rows.withColumn("h", F.xxhash64("v", F.lit(4)))
    chosen = hashed.select("h").distinct().orderBy("h").limit(n_pivots)
    picked = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min_by("v", "row").alias("v")).orderBy("h").collect()
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(picked[0]["v"])
    pivots = np.array([p["v"] for p in picked if len(p["v"]) == width], np.float64)
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    depth = min(depth, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asked": [], "query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values(["id", "row"]), right.sort_values(["id", "row"])
        found = search_shard(left["id"].to_numpy(), np.vstack(left["v"].to_numpy()), right["row"].to_numpy(), right["id"].to_numpy(), np.vstack(right["v"].to_numpy()), shared.value, depth, share, least, k)
        return pd.DataFrame(found, columns=["asked", "query_id", "vec_id", "score"])

    def number(n: int, seed: int):
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")

    left = rows.withColumn("shard", number(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", number(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, PAIRS)
    # Spark keeps k rows a query on the map side of this window, so that the shuffle does not grow with the shards
    nearest = Window.partitionBy("asked").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
