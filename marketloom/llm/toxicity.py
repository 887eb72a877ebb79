"""Toxicity by two class-conditional Kneser-Ney letter models.

Each class (toxic, ordinary) has counts of letter 5-grams inside words. Both back off to the same lower-order model,
whose continuation counts come from both classes together, so that an expression that neither class has seen often
is smoothed alike and does not speak for either. A document is compared by its length-normalised log-likelihoods,
over the whole text and over the words where the toxic model gains most; a logistic curve, fitted on other documents
than those counted, turns the differences into a score from 0 to 1.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.text import small_batches

DISCOUNT = 0.75
ORDER = 5
#: Probability of a letter of which nothing at all is known.
FLOOR = 1 / 256
ROLL = np.uint64(0x100000001B3)
CONTEXT = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """code point -> whether it is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the lower-cased text with one 0 before, between and after words; the positions of those zeros."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[raw], raw, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    codes = codes[keep]
    return codes, np.flatnonzero(codes == 0)


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position but the first: hash of its gram (up to ORDER codes, not past the word's start), and of the gram's context."""
    n = len(codes) - 1
    context = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for j in range(1, min(ORDER, n + 1)):
        before = np.zeros(n, np.uint64)
        before[j - 1 :] = codes[: n - j + 1] + np.uint64(1)
        context = np.where(inside, context * ROLL + before, context)
        inside &= before > 1
    context = context * CONTEXT
    gram = (context ^ (codes[1:] + np.uint64(7))) * ROLL
    gram ^= gram >> np.uint64(32)
    return gram * CONTEXT | np.uint64(1), context | np.uint64(1)


def _grams(text: str) -> list[str]:
    """The same grams as text; used when counting."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        s = f"\0{word}\0"
        out += [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]
    return out


def _keys(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each gram, as _hashed gives them in a text."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    parts = [g if g[0] == "\0" else "\0" + g for g in grams]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(x) for x in parts]) - 2
    g, c = _hashed(codes)
    return g[ends], c[ends]


class HashTable:
    """hash -> float, open addressing in two flat arrays; lookups of whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found)."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = there == keys
        out = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]], found[left[hit]] = self.values[slot[hit]], True
            go = ~hit & (there != 0)
            left, slot = left[go], slot[go]
        return out, found


@dataclass
class ToxicityModel:
    """grams, contexts: log P(toxic) - log P(ordinary) of a seen gram; of any other gram after that context."""

    grams: HashTable
    contexts: HashTable
    weights: np.ndarray

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Difference of the two log-likelihoods per letter: over the whole text, in its best word, in its second best word."""
        if not text:
            return 0.0, 0.0, 0.0
        codes, zeros = _codes(text)
        if len(codes) < 2:
            return 0.0, 0.0, 0.0
        gram, context = _hashed(codes)
        gain, found = self.grams.get(gram)
        miss = np.flatnonzero(~found)
        gain[miss] = self.contexts.get(context[miss])[0]
        starts = zeros[:-1]
        words = np.add.reduceat(gain, starts) / np.maximum(4, np.diff(zeros))
        top = np.sort(np.partition(words, max(0, len(words) - 2))[-2:])
        return float(gain.mean()), float(top[-1]), float(top[0]) if len(top) > 1 else 0.0

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights[:3], self.features(text)) + self.weights[3])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def build_tables(counts: dict[str, tuple[int, int]]) -> tuple[HashTable, HashTable]:
    """gram -> (count in ordinary texts, count in toxic texts) to the tables of log-likelihood differences."""
    seen: list[dict[str, list[int]]] = [{}, {}]
    for gram, pair in counts.items():
        for k in (0, 1):
            if pair[k]:
                a = seen[k].setdefault(gram[:-1], [0, 0])
                a[0] += pair[k]
                a[1] += 1
    shared: dict[str, int] = {}
    level = set(counts)
    while level:
        lower = Counter(g[1:] for g in level if len(g) > 1)
        for g, n in lower.items():
            shared[g] = shared.get(g, 0) + n
        level = set(lower)
    context: dict[str, list[int]] = {}
    for g, n in shared.items():
        a = context.setdefault(g[:-1], [0, 0])
        a[0] += n
        a[1] += 1

    @lru_cache(maxsize=None)
    def backoff(g: str) -> float:
        if not g:
            return FLOOR
        low, a = backoff(g[1:]), context.get(g[:-1])
        return low if a is None else (max(shared.get(g, 0) - DISCOUNT, 0) + DISCOUNT * a[1] * low) / a[0]

    values = []
    for gram, pair in counts.items():
        low, logs = backoff(gram[1:]), []
        for k in (0, 1):
            a = seen[k].get(gram[:-1])
            logs.append(np.log(low if a is None else (max(pair[k] - DISCOUNT, 0) + DISCOUNT * a[1] * low) / a[0]))
        values.append(logs[1] - logs[0])
    around = {g[:-1]: g for g in counts}
    cvalues = []
    for c, g in around.items():
        spare = [DISCOUNT * seen[k][c][1] / seen[k][c][0] if c in seen[k] else 1.0 for k in (0, 1)]
        cvalues.append(np.log(spare[1]) - np.log(spare[0]))
    return (
        HashTable(_keys(list(counts))[0], np.array(values, np.float32)),
        HashTable(_keys(list(around.values()))[1], np.array(cvalues, np.float32)),
    )


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; both classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w * [1e-2, 1e-2, 1e-2, 1e-4]
        h = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.diag([1e-2, 1e-2, 1e-2, 1e-4])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (1e-9 + np.abs(step).max()) * 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(df: DataFrame, label: int, n: int) -> DataFrame:
    """The n rows of a class with the lowest hash of their id."""
    order = F.xxhash64(F.col("id").cast("string"), F.lit(10))
    return df.where(F.col("label") == label).orderBy(order, "id").limit(n)


def fit(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs_per_class: int = 2500,
) -> ToxicityModel:
    """Fit both class models and the curve.

    Only labelled rows whose crc32(id as text) mod 3 is not 1 are used: those of remainder 0 are counted, those of
    remainder 2 place the curve. ``max_docs_per_class`` bounds each of the four samples (the rows with the lowest
    hashed id); taking as many of either class keeps the two models matched. Rows without id, text or label are no
    training rows, nor are those of an id with both labels; a label that is repeated counts once, and of documents that
    repeat an id the smallest text. So the order of rows plays no part. Without rows of both classes every text scores 0.
    """
    small_batches(documents.sparkSession)
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)").where(fold != 1)
    labelled = labelled.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    picked = None
    for part in (0, 2):
        for label in (0, 1):
            some = _sample(labelled.where(fold == part), label, max_docs_per_class).withColumn("part", F.lit(part))
            picked = some if picked is None else picked.unionByName(some)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), "id").groupBy("id", "label", "part").agg(F.min("text").alias("text"))

    def count(batches):
        seen: dict[str, list[int]] = {}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                for g in _grams(text):
                    a = seen.get(g)
                    if a is None:
                        a = seen[g] = [0, 0]
                    a[label] += 1
        yield pd.DataFrame({"gram": list(seen), "n0": [a[0] for a in seen.values()], "n1": [a[1] for a in seen.values()]})

    counted = rows.where("part = 0").mapInPandas(count, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counted.toPandas()  # letter 5-grams of a bounded sample
    counts = {g: (int(a), int(b)) for g, a, b in zip(found["gram"], found["n0"], found["n1"])}
    model = ToxicityModel(*build_tables(counts), weights=np.array([0.0, 0.0, 0.0, -30.0]))
    if not (found["n0"].sum() and found["n1"].sum()):
        return model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for pdf in batches:
            f = [shared.value.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], **{f"f{j}": [x[j] for x in f] for j in range(3)}})

    tuned = rows.where("part = 2").mapInPandas(features, "label int, f0 double, f1 double, f2 double").toPandas()
    if tuned["label"].nunique() < 2:
        tuned = rows.mapInPandas(features, "label int, f0 double, f1 double, f2 double").toPandas()
    tuned = tuned.sort_values(list(tuned))
    model.weights = _logistic(tuned[["f0", "f1", "f2"]].to_numpy(), tuned["label"].to_numpy())
    return model


def score(model: ToxicityModel, documents: DataFrame, text: Column) -> Column:
    """Column with the score of each text, from 0 to 1; a null or empty text has no evidence and gets the curve's value there."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score, na_action=None)

    return toxic(F.coalesce(text, F.lit("")))
