"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: source shares are raised to an exponent that is found by interval section, until the weights meet
a target entropy and a limit on repetitions. The weights times a token budget are then realised: every source's
documents lie in blocks; each epoch takes the blocks in another order, and the last, partial epoch stops at the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.stored import stored

MOST_BLOCKS = 4096


@dataclass(frozen=True)
class Mix:
    """exponent, entropy (share of the largest possible), most repetitions of a source, tokens in the sources."""

    exponent: float
    entropy: float
    repetition: float
    tokens: int


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def slim(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, n_tokens); a null source counts as the empty one."""
    return documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), token_count(F.col(text_col)).alias("n_tokens"))


def source_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def find_exponent(sources: DataFrame, *, budget: float, entropy: float | None, repetition: float | None, sections: int = 32, rounds: int = 5) -> Mix:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` (share of the logarithm of the number of
    sources), raised again as far as ``repetition`` (most times that a source's tokens may be used) demands.

    Each round cuts the interval into 32 sections (five bisections at once) in one aggregation over the sources.
    With a repetition limit under budget / tokens even the natural shares (exponent 1) break it; they are used then.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return Mix(1.0, 0.0, 0.0, 0)
    share = F.col("tokens") / F.lit(float(total["t"]))

    def measured(exponents: list[float]) -> dict[float, tuple[float, float]]:
        grid = sources.select(share.alias("s"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
        p = F.pow("s", F.col("a"))
        got = grid.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.log("s")).alias("l"), F.max(p / F.col("s")).alias("m")).collect()
        most = math.log(total["n"]) or 1.0
        return {r["a"]: ((math.log(r["z"]) - r["a"] * r["l"] / r["z"]) / most, r["m"] / r["z"] * budget / float(total["t"])) for r in got}

    def section(fits, low_fits: bool, low: float = 0.0, high: float = 1.0) -> float:
        """The end of the fitting part, which begins at ``low`` or ends at ``high``."""
        for _ in range(rounds):
            at = [low + (high - low) * i / sections for i in range(sections + 1)]
            found = measured(at)
            good = [fits(found[a]) for a in at]
            if low_fits:
                i = max((i for i, g in enumerate(good) if g), default=0)
                low, high = at[i], at[min(i + 1, sections)]
            else:
                i = min((i for i, g in enumerate(good) if g), default=sections)
                low, high = at[max(i - 1, 0)], at[i]
        return low if low_fits else high

    exponent = 1.0
    if entropy is not None and total["n"] > 1:
        exponent = section(lambda m: m[0] >= entropy, True)
    if repetition is not None and measured([exponent])[exponent][1] > repetition:
        exponent = section(lambda m: m[1] <= repetition, False, exponent, 1.0)
    e, m = measured([exponent])[exponent]
    return Mix(exponent, e, m, int(total["t"]))


def plan(rows: DataFrame, per_source: DataFrame, mix: Mix, *, budget: float, block_tokens: int, seed: int, most_broadcast: int) -> DataFrame:
    """(source, block, epoch, weight, place, left): what each epoch takes of each block of a source.

    place: the block's position in the epoch's order; left: null if the whole block is taken, else the tokens that
    the budget leaves for it. A source has at most 4096 blocks, whose size follows the source's. ``per_source`` has the
    tokens of each source; up to ``most_broadcast`` of them meet the documents by broadcast, without a shuffle by source.
    """
    total = per_source.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(mix.tokens or 1)), F.lit(mix.exponent))).alias("z")).first()["z"] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(mix.tokens or 1)), F.lit(mix.exponent)) / F.lit(total)
    sources = per_source.select("source", "tokens", weight.alias("weight"), n_blocks(F.col("tokens"), block_tokens).alias("blocks")).withColumn("quota", F.col("weight") * F.lit(float(budget)))
    sources = F.broadcast(sources) if per_source.count() <= most_broadcast else sources
    blocks = rows.join(sources, "source").groupBy("source", "tokens", "weight", "quota", block_of(F.col("id"), F.col("blocks"), seed).alias("block")).agg(F.sum("n_tokens").alias("size"))
    epochs = F.ceil(F.col("quota") / F.col("tokens") - 1e-9).cast("int")
    each = blocks.withColumn("epochs", epochs).where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "source", "block"), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumns({"place": F.row_number().over(order), "before": before})
    have = F.when(F.col("epoch") < F.col("epochs") - 1, F.col("tokens")).otherwise(F.col("quota") - F.col("tokens") * (F.col("epochs") - 1))
    each = each.withColumn("have", have).where(F.col("before") < F.col("have") + 1e-6)
    left = F.when(F.col("before") + F.col("size") > F.col("have") + 1e-6, F.floor(F.col("have") - F.col("before") + 1e-6))
    return each.select("source", "block", "epoch", "weight", "place", left.alias("left"))


def n_blocks(tokens: Column, block_tokens: int) -> Column:
    return F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(tokens / block_tokens))).cast("int")


def block_of(doc: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc), blocks).cast("int")


def mix_sources(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None,
    entropy: float | None = 0.9, repetition: float | None = 4.0, block_tokens: int = 50_000, seed: int = 2, most_broadcast: int = 200_000,
) -> DataFrame:
    """Each document as often as the mix uses it: its columns and epoch, weight (the source's), place (block in the
    epoch), n_tokens. Sort an epoch by place and hash to read the permutation.

    ``budget`` is the number of tokens to draw (default: as many as there are). The tokens drawn from a source fall
    short of weight times budget by less than the longest document of its last block. Documents that repeat an id
    stay together. A null source counts as the empty one, a null text as empty (it costs nothing). Sources without a
    token have weight 0 and are left out. Columns of ``documents`` called like the results are replaced.
    """
    spark = documents.sparkSession
    rows = stored(slim(documents, id_col, text_col, source_col))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    per_source = stored(source_tokens(rows))
    mix = find_exponent(per_source, budget=budget, entropy=entropy, repetition=repetition)
    taken = stored(plan(rows, per_source, mix, budget=budget, block_tokens=block_tokens, seed=seed, most_broadcast=most_broadcast))
    sized = per_source.select("source", n_blocks(F.col("tokens"), block_tokens).alias("blocks"))

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= most_broadcast else df

    # the one block of a source and epoch that is taken in part: its documents in hashed order, as far as the tokens go
    cut = rows.join(hinted(sized), "source").withColumn("block", block_of(F.col("id"), F.col("blocks"), seed)).join(hinted(taken.where("left is not null")), ["source", "block"])
    cut = cut.groupBy("source", "block", "epoch", "left", "id").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("epoch", "id"), "id")
    cut = cut.withColumn("used", F.sum("n").over(order)).where("used <= left").select("source", "epoch", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"))

    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    whole = whole.withColumns({"source": F.coalesce(F.col("row")[source_col], F.lit("")), "n_tokens": token_count(F.col("row")[text_col]), "id": F.coalesce(F.col("row")[id_col], F.lit(0)), "none": F.col("row")[id_col].isNull()})
    whole = whole.join(hinted(sized), "source").withColumn("block", block_of(F.col("row")[id_col], F.col("blocks"), seed))
    placed = whole.join(hinted(taken), ["source", "block"])
    part = placed.where("left is not null").join(cut, ["source", "epoch", "id", "none"], "left_semi")
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c not in ("epoch", "weight", "place", "n_tokens")]
    return placed.where("left is null").unionByName(part).select(*kept, "epoch", "weight", "place", "n_tokens")
