"""Cross-entropy difference of documents between a target and a background word n-gram model.

Both models share one vocabulary (every word of the corpus), the same order and the same smoothing, and the background's
counts are scaled to the target's total, so that they differ in nothing but what they have seen. Words are counted alone
and behind every word that precedes them.

The count tables grow with the corpus and never leave Spark. Documents are dealt into blocks of a few megabytes. A block
counts its own different words and pairs and sends them, cut by ranges of their hashes, to be added up; what comes back
are the whole corpus's counts of just these words and pairs, in the same order. A document's own counts are taken out of
the model that it belongs to before it is scored, else every document would look like its own side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.stored import Tables
from marketloom.llm.text import STEP, mixed, small_batches, words

ADDED = 0.1
#: Weight of the word alone, in tokens, beside what was counted behind a context.
PRIOR = 200.0
BLOCK_BYTES = 16_000_000
#: Ranges of hashes that are added up apart: so many, or twice the blocks if these are more.
PARTS = 1024
LOSSES = (("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("difference", T.DoubleType()))


class Words(dict):
    """word -> its number in a block, in the order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def _deal(documents: DataFrame, target: Column, text_col: str, kept: list[str]) -> DataFrame:
    """One row for each block, that is consecutive rows of one task with BLOCK_BYTES of text together: (block, rows: the kept
    columns, own: 1 for a target, sizes: tokens of each text, words: their hashes, ascending, at: the word of every token)."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(target, F.lit(False)).cast("int").alias("own"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("own", "sizes", "words", "at"))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table, size, ids, pieces, owns = TaskContext.get().partitionId() << 32, Words(), 0, [], [], []

        def block() -> pa.RecordBatch:
            word, place = np.unique(table.hashes(), return_inverse=True)
            at = place[np.concatenate([np.zeros(0, np.int32), *ids])].astype(np.int32)
            each = pa.concat_arrays(pieces)
            binary = [np.concatenate(owns).astype(np.int8), np.fromiter(map(len, ids), np.int64, len(ids)), word, at]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each), *(pa.array([x.tobytes()], pa.binary()) for x in binary)], names=schema.names)

        for batch in batches:
            start, own = 0, batch.column("own").to_numpy()
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids.append(table.of(text))
                size += len(text.encode()) if text else 0
                if size >= BLOCK_BYTES or i == len(own) - 1:
                    pieces.append(batch.column("row").slice(start, i + 1 - start))
                    owns.append(own[start : i + 1])
                    start = i + 1
                if size >= BLOCK_BYTES:
                    yield block()
                    number, table, size, ids, pieces, owns = number + 1, Words(), 0, [], [], []
        if ids:
            yield block()

    return rows.mapInArrow(deal, schema)


class Block:
    """The words and pairs of a block's texts, each numbered in the order of their hashes.

    word, pair: hashes; at: the word of every token; text: the text that it stands in; heads: the tokens that are counted
    as the first of a pair, which is numbered in of_pair.
    known: the only words that count as the first of a pair; None: all.
    """

    def __init__(self, sizes: bytes, words: bytes, at: bytes, known: np.ndarray | None):
        self.sizes, self.word, self.at = np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64), np.frombuffer(at, np.int32).astype(np.int64)
        v = len(self.word)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.last = np.cumsum(self.sizes)[self.sizes > 0] - 1
        after = np.append(self.at[1:], 0)
        after[self.last] = v
        codes, self.rank = np.unique(self.at * (v + 1) + after, return_inverse=True)
        self.first, second = np.divmod(codes, v + 1)
        counted = second < v
        if known is not None:
            counted &= np.isin(self.word, known)[self.first]
        numbers = np.full(len(codes), -1)
        self.pair, numbers[counted] = np.unique(mixed(self.word[self.first[counted]] * STEP + self.word[second[counted]]), return_inverse=True)
        of_pair = numbers[self.rank]
        self.heads = np.flatnonzero(of_pair >= 0)
        self.of_pair = of_pair[self.heads]

    def counts(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often (a row each) a word stands in background and target texts, and is followed by another; and the same of pairs."""
        side = own[self.text]
        sides, heads = [side == k for k in (0, 1)], [side[self.heads] == k for k in (0, 1)]
        n = [np.bincount(self.at[x], minlength=len(self.word)) for x in sides]
        n += [np.bincount(self.at[self.heads[x]], minlength=len(self.word)) for x in heads]
        return np.stack(n), np.stack([np.bincount(self.of_pair[x], minlength=len(self.pair)) for x in heads])

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each token's word, and its pair with the next word, occurs in its text."""
        order = np.argsort(self.text * max(1, len(self.first)) + self.rank)
        text, rank = self.text[order], self.rank[order]
        words, pairs = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for out, key in ((words, self.first[rank]), (pairs, rank)):
            starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(order) else order
            n = np.diff(np.append(starts, len(order)))
            out[order] = np.repeat(n, n)
        return words, pairs

    def losses(self, own: np.ndarray, n: np.ndarray, m: np.ndarray, tokens: np.ndarray, vocabulary: int) -> list[np.ndarray]:
        """Mean loss per token in nats of each text by the background and by the target model; own: the model that has counted it.

        n and m: the corpus's counts, as from counts(); tokens: their sums.
        """
        matched = tokens[1] / tokens[0] if tokens.all() else 1.0
        at, heads, side, out = self.at, self.heads, own[self.text], []
        mine_at, mine_pair = self.within()
        ends = np.full(len(self.sizes), -1)
        ends[self.text[self.last]] = at[self.last]
        # a text's last token is the first of no pair
        before, mine_pair, mine_before = at[heads], mine_pair[heads], (mine_at - (at == ends[self.text]))[heads]
        own_size = self.sizes[self.text]
        for k in (0, 1):
            mine, scale = side == k, matched if k == 0 else 1.0
            p = (scale * (n[k][at] - mine_at * mine) + ADDED) / (scale * (tokens[k] - own_size * mine) + ADDED * vocabulary)
            mine = mine[heads]
            p[heads + 1] = (scale * (m[k][self.of_pair] - mine_pair * mine) + PRIOR * p[heads + 1]) / (scale * (n[k + 2][before] - mine_before * mine) + PRIOR)
            out.append(np.bincount(self.text, weights=-np.log(p), minlength=len(self.sizes)) / np.maximum(1, self.sizes))
        return out

    def cuts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the hash ranges starts among the words and among the pairs."""
        return tuple(np.searchsorted((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)) for x in (self.word, self.pair))


def _most_frequent(blocks: DataFrame, n: int) -> np.ndarray:
    """The target's n most frequent words, ties to the smaller hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["sizes"], row["words"], row["at"], None)
                times = block.counts(np.frombuffer(row["own"], np.int8))[0][1]
                yield pa.RecordBatch.from_arrays([pa.array(block.word.view(np.int64)), pa.array(times)], names=["word", "n"])

    counted = blocks.select("own", "sizes", "words", "at").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    return np.sort(np.array([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()], np.int64))


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, all first bytes before all second ones."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, size: int, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).reshape(-1)


def _steps(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes, prepend=np.uint64(0))


def _block_counts(blocks: DataFrame, known: np.ndarray | None, parts: int) -> DataFrame:
    """(block, part, words, pairs, keys, counts): a block's different words and pairs with hashes in a range, and their counts."""
    types = {"block": pa.int64(), "part": pa.int64(), "words": pa.int64(), "pairs": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def rows_of(row: dict) -> pa.RecordBatch:
        block = Block(row["sizes"], row["words"], row["at"], known)
        n, m = block.counts(np.frombuffer(row["own"], np.int8))
        a, b = block.cuts(parts)
        out = []
        for i in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
            w, p = slice(a[i], a[i + 1]), slice(b[i], b[i + 1])
            out.append((row["block"], i, a[i + 1] - a[i], b[i + 1] - b[i], _packed(np.concatenate((_steps(block.word[w]), _steps(block.pair[p])))), _packed(np.concatenate((n[:, w].ravel(), m[:, p].ravel())))))
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types.values())], schema=pa.schema(types))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield rows_of(batch.slice(i, 1).to_pylist()[0])

    return blocks.select("block", "own", "sizes", "words", "at").mapInArrow(count, "block long, part long, words long, pairs long, keys binary, counts binary")


def _add_up(rows: pa.Table) -> pa.Table:
    """(block, part, words, pairs, counts, vocabulary, n0, n1): for each block the sums over all blocks, by hash; the last three once a range."""
    rows = rows.to_pylist()
    keys = [_unpacked(r["keys"], r["words"] + r["pairs"], np.uint64) for r in rows]
    counts = [_unpacked(r["counts"], 4 * r["words"] + 2 * r["pairs"]) for r in rows]
    found: dict[int, list] = {}
    whole = []
    for of_pairs in (False, True):
        hashes = [np.cumsum(k[r["words"] :] if of_pairs else k[: r["words"]], dtype=np.uint64) for k, r in zip(keys, rows)]
        each = [(c[4 * r["words"] :].reshape(2, -1) if of_pairs else c[: 4 * r["words"]].reshape(4, -1)) for c, r in zip(counts, rows)]
        different, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.stack([np.bincount(at, weights=x, minlength=len(different)).astype(np.int64) for x in np.concatenate(each, axis=1)])
        whole.append((different, sums))
        for r, places in zip(rows, np.split(at, np.cumsum([len(h) for h in hashes])[:-1])):
            pieces = found.setdefault(r["block"], [[], []])
            pieces[of_pairs].append(places)
    out, (different, sums) = [], whole[0]
    once = (len(different), int(sums[0].sum()), int(sums[1].sum()))
    for block, pieces in found.items():
        (w,), (p,) = pieces
        out.append((block, rows[0]["part"], len(w), len(p), _packed(np.concatenate((whole[0][1][:, w].ravel(), whole[1][1][:, p].ravel()))), *(once if not out else (0, 0, 0))))
    return pa.Table.from_arrays([pa.array([x[j] for x in out], pa.binary() if j == 4 else pa.int64()) for j in range(8)], names=["block", "part", "words", "pairs", "counts", "vocabulary", "n0", "n1"])


def score(documents: DataFrame, *, text_col: str = "text", target: Column, contexts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``n_tokens``, ``target_loss``, ``background_loss`` and ``difference`` (background minus target; above 0: like the target).

    ``target`` says which rows train the target model (null: background). ``keep`` lists the columns to return beside the
    losses (default: all); columns of the added names are replaced. A text
    without words (null, empty) has 0 tokens, null losses and difference 0. Repeated rows are counted and scored each.
    If no row, or every row, is a target, one model is empty and falls back to equal chances. Words are counted behind
    every word; ``contexts``: only behind so many of the target's most frequent ones, behind others they are drawn alone.
    Words and pairs are told apart by 64-bit hashes.
    The blocks and the counts are written to the shared folder before the result is returned.
    """
    spark = documents.sparkSession
    small_batches(spark)
    tables = Tables(spark, "lm")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in dict(LOSSES)]
    blocks = tables.keep(_deal(documents, target, text_col, kept))
    n_blocks = blocks.count()
    known = None if contexts is None else _most_frequent(blocks, contexts).view(np.uint64)
    parts = max(PARTS, 2 * n_blocks)
    counts = tables.keep(_block_counts(blocks, known, parts).groupBy("part").applyInArrow(_add_up, "block long, part long, words long, pairs long, counts binary, vocabulary long, n0 long, n1 long"))
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "n0", "n1"))).first()
    tokens, vocabulary = np.array([totals["n0"], totals["n1"]], float), totals["vocabulary"] + 1
    schema = T.StructType([T.StructField("row", blocks.schema["rows"].dataType.elementType), *(T.StructField(c, t) for c, t in LOSSES)])

    def score_block(rows: pa.Table, model: pa.Table) -> pa.Table:
        own = np.frombuffer(rows.column("own")[0].as_py(), np.int8)
        block = Block(*(rows.column(c)[0].as_py() for c in ("sizes", "words", "at")), known)
        n, m = np.zeros((4, len(block.word)), np.int64), np.zeros((2, len(block.pair)), np.int64)
        a, b = block.cuts(parts)
        for part, n_words, n_pairs, packed in zip(*(model.column(c).to_pylist() for c in ("part", "words", "pairs", "counts"))):
            got = _unpacked(packed, 4 * n_words + 2 * n_pairs)
            n[:, a[part] : a[part + 1]], m[:, b[part] : b[part + 1]] = got[: 4 * n_words].reshape(4, -1), got[4 * n_words :].reshape(2, -1)
        background, target_ = block.losses(own, n, m, tokens, vocabulary)
        none = block.sizes == 0
        found = [pa.array(block.sizes), pa.array(target_, mask=none), pa.array(background, mask=none), pa.array(np.where(none, 0.0, background - target_))]
        return pa.Table.from_arrays([rows.column("rows").combine_chunks().flatten(), *found], names=["row", *dict(LOSSES)])

    # a task for each block, so that what a task reads does not grow with the corpus
    tasks = max(1, n_blocks)
    left, right = blocks.repartition(tasks, "block"), counts.select("block", "part", "words", "pairs", "counts").repartition(tasks, "block")
    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score_block, schema)
    return scored.select(*(F.col("row")[c].alias(c) for c in kept), *dict(LOSSES))
