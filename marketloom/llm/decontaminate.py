"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of k words (a seed) are candidates. Their seeds are joined; tiles are
the longest common runs that do not overlap in either text, marked greedily, longest first, as the running Karp-Rabin
matcher does; reordered passages yield several tiles. An item leaks if its tiles cover enough of it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.stored import stored
from marketloom.llm.text import WordHashes, shingles, small_batches, words

#: A Bloom filter of this fixed size lets only possible seeds of the documents into the shuffle (2 MB).
FILTER_BITS = 24


def seeds(table: WordHashes, text: str | None, k: int) -> tuple[list[str], np.ndarray]:
    """Words, and the Karp-Rabin hash of each run of k of them; none in a shorter text."""
    w = words(text)
    return w, shingles(table.of(w), k) if len(w) >= k else np.zeros(0, np.uint64)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def tiles(hits: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of (place in the document, place in the item) of shared seeds: (document place, item place, words), longest first.

    Ties go to the earlier item place, then to the earlier document place. A run that earlier tiles have cut is
    tiled again by what is left of it, if that still has k words.
    """
    order = np.lexsort((hits[:, 1], hits[:, 0] - hits[:, 1]))
    hits = np.unique(hits[order], axis=0)
    diagonal = hits[:, 0] - hits[:, 1]
    hits = hits[np.lexsort((hits[:, 1], diagonal))]
    diagonal = hits[:, 0] - hits[:, 1]
    cut = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(hits[:, 1]) != 1)) + 1
    runs = [(len(part) + k - 1, int(part[0, 1]), int(part[0, 0])) for part in np.split(hits, cut)]
    taken_d, taken_i, out = set(), set(), []
    by_length: dict[int, list[tuple[int, int]]] = {}
    for n, i, d in runs:
        by_length.setdefault(n, []).append((i, d))
    while by_length:
        n = max(by_length)
        for i, d in sorted(by_length.pop(n)):
            free = [j for j in range(n) if i + j not in taken_i and d + j not in taken_d]
            if len(free) == n:
                out.append((d, i, n))
                taken_i.update(range(i, i + n))
                taken_d.update(range(d, d + n))
                continue
            for _, group in groupby(enumerate(free), lambda x: x[1] - x[0]):
                part = [j for _, j in group]
                if len(part) >= k:
                    by_length.setdefault(len(part), []).append((i + part[0], d + part[0]))
    return out


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, coverage: float = 0.8,
) -> DataFrame:
    """(doc id, item id, item_words, covered, n_tiles, longest, coverage, tiles) of every item that leaks into a document.

    covered counts the item's words in tiles of at least k words. Items of fewer than k words, null or empty texts and
    rows without id leak nowhere. Rows that repeat a document's or an item's id are all looked at, the tiles of each two
    texts on their own places; the pair with the greatest coverage counts. Coverage of exactly ``coverage`` leaks.
    """
    spark = documents.sparkSession
    small_batches(spark)

    def places(w: list[str], h: np.ndarray, at: np.ndarray) -> list[tuple[int, str, np.ndarray]]:
        """(hash, its words, places) of each different seed among the given places."""
        order = at[np.argsort(h[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(h[order])) + 1
        return [(int(h[part[0]]) - 2**63, " ".join(w[part[0] : part[0] + k]), part.astype(np.int32)) for part in np.split(order, cuts)] if len(order) else []

    def of_items(batches):
        table = WordHashes()
        for pdf in batches:
            out = []
            for row, i, t in zip(pdf["irow"], pdf["item"], pdf["text"]):
                w, h = seeds(table, t, k)
                out += [(row, i, len(w), x, gram, p) for x, gram, p in places(w, h, np.arange(len(h)))]
            yield pd.DataFrame(out, columns=["irow", "item", "item_words", "h", "gram", "places"])

    items = benchmark.select(F.monotonically_increasing_id().alias("irow"), F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    items = stored(items.mapInPandas(of_items, "irow long, item long, item_words int, h long, gram string, places array<int>"))

    def bits(batches):
        found = [np.zeros(0, np.int64)]
        for pdf in batches:
            found += _slots((pdf["h"].to_numpy() + np.int64(-(2**63))).view(np.uint64))
        yield pd.DataFrame({"slot": np.unique(np.concatenate(found))})

    filled = np.zeros(1 << FILTER_BITS, bool)  # at most 2 ** FILTER_BITS slots, whatever the benchmark's size
    filled[items.select("h").mapInPandas(bits, "slot int").distinct().toPandas()["slot"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(filled))

    def of_documents(batches):
        table, filter_ = WordHashes(), np.unpackbits(shared.value).astype(bool)
        for pdf in batches:
            out = []
            for row, i, t in zip(pdf["row"], pdf["doc"], pdf["text"]):
                w, h = seeds(table, t, k)
                if len(h):
                    a, b = _slots(h)
                    out += [(row, i, x, gram, p) for x, gram, p in places(w, h, np.flatnonzero(filter_[a] & filter_[b]))]
            yield pd.DataFrame(out, columns=["row", "doc", "h", "gram", "ats"])

    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    found = docs.mapInPandas(of_documents, "row long, doc long, h long, gram string, ats array<int>")
    hits = found.join(items, ["h", "gram"]).select("row", "doc", "irow", "item", "item_words", "ats", "places")
    # a seed covers k words of the item, so that too few different ones can't reach the coverage
    able = F.sum(F.size("places")) * k >= F.first("item_words") * coverage
    grouped = hits.groupBy("row", "doc", "irow", "item").agg(able.alias("able"), F.first("item_words").alias("item_words"), F.collect_list(F.struct("ats", "places")).alias("hits")).where("able")

    def tile_rows(batches):
        for pdf in batches:
            out = []
            for doc, item, n, found_ in zip(pdf["doc"], pdf["item"], pdf["item_words"], pdf["hits"]):
                each = [np.stack(np.meshgrid(h["ats"], h["places"], indexing="ij"), axis=-1).reshape(-1, 2) for h in found_]
                got = tiles(np.concatenate(each).astype(np.int64), k)
                covered = sum(t[2] for t in got)
                out.append((doc, item, n, covered, len(got), max(t[2] for t in got), covered / n, [{"at": d, "place": i, "words": m} for d, i, m in got]))
            yield pd.DataFrame(out, columns=["doc", "item", "item_words", "covered", "n_tiles", "longest", "coverage", "tiles"])

    tiled = grouped.select("doc", "item", "item_words", "hits").mapInPandas(tile_rows, "doc long, item long, item_words int, covered int, n_tiles int, longest int, coverage double, tiles array<struct<at: int, place: int, words: int>>")
    leaks = tiled.where(F.col("coverage") >= coverage)
    best = leaks.groupBy("doc", "item").agg(F.max_by(F.struct("item_words", "covered", "n_tiles", "longest", "coverage", "tiles"), F.struct("coverage", "covered", -F.col("n_tiles"), "tiles")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.*")
