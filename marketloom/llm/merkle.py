"""Merkle manifest of a table: a tree for each group, one tree over the groups, a proof for every row.

A row's place in its group is written in digits of base ``fan``. Blocks of ``fan ** digits`` consecutive rows are rolled up:
the last digit is grouped away, its rows become the children of one struct, then the next digit, until a block is one nested
struct. Blocks roll up in the same way, with their digests alone, until each group is one block, and so do the groups. Then
the structs are transformed from the outside in: every node hands the siblings along its path to its children, and
the lists of leaves are exploded. A block and the siblings above it come together by one grouping; nothing is joined there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.jaccard_join import hinted
from marketloom.llm.stored import Tables

FAN, DIGITS = 3, 6
STEP = "struct<left:string,right:string>"
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    """sha256 of the text's UTF-8 bytes, as lowercase hex."""
    return F.sha2(x.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of the values one after another: each ``-`` if null, else its length in bytes, a colon and itself."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]))


def ranked(tables: Tables, df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add pos (place within the group by the order, from 0) and n (the group's size).

    Rows are dealt by ranges of (group, order), so that a large group lies in many partitions; a place is the place within
    the partition plus the group's rows in the partitions before, of which there is a row for each partition and group.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = tables.keep(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_g")
    parts = tables.keep(parts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_p")) - F.col("_n"), "n": F.sum("_n").over(whole)}))
    out = dealt.join(hinted(parts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_g", "_p", "_n", "_first", "_before")


def levels(n: Column, fan: int, digits: int) -> Column:
    """Levels of a block in a group of n: all, or those of the whole tree if that is one block."""
    out = F.lit(digits)
    for h in range(digits - 1, -1, -1):
        out = F.when(n <= fan**h, F.lit(h)).otherwise(out)
    return out


def rollup(nodes: DataFrame, fan: int, digits: int) -> DataFrame:
    """(g, block, blocks, node): blocks of nodes (g, pos, n, item: struct with ``digest``) as nested structs.

    A node is struct (digest, kids: struct (kid, left, right)): the digests of the kids' siblings before and behind them.
    In a group of a single block levels above its root keep the digest, and their kid has null siblings.
    """
    width = fan**digits
    out = nodes.select("g", F.floor(F.col("pos") / width).alias("block"), F.ceil(F.col("n") / width).alias("blocks"), levels(F.col("n"), fan, digits).alias("_h"), F.col("item").alias("node"), *[F.pmod(F.floor(F.col("pos") / fan**d), F.lit(fan)).cast("int").alias(f"d{d}") for d in range(digits)])
    out = out.repartition("g", "block")  # all levels of a block stay in its task
    for d in range(digits):
        over = ["g", "block", "blocks", "_h", *(f"d{i}" for i in range(d + 1, digits))]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{d}").alias("d"), "node")))
        out = out.groupBy(*over).agg(kids.alias("kids"))
        each, runs = F.col("kids.node.digest"), F.col("_h") > d
        beside = F.transform("kids", lambda k, i: F.struct(k["node"].alias("kid"), F.when(runs, F.array_join(F.slice(each, F.lit(1), i), "")).alias("left"), F.when(runs, F.array_join(F.slice(each, i + 2, fan), "")).alias("right")))
        top = F.when(runs, digest(F.array_join(each, ""))).otherwise(F.get(each, F.lit(0)))
        out = out.select(*over, F.struct(top.alias("digest"), beside.alias("kids")).alias("node"))
    return out.select("g", "block", "blocks", "node")


def unrolled(node: Column, above: Column, digits: int) -> Column:
    """Array of struct (item, path) of all leaves of a block: path has the siblings from the leaf up to the tree's root."""
    if digits == 0:
        return F.array(F.struct(node.alias("item"), above.alias("path")))

    def down(k: Column) -> Column:
        step = F.when(k["left"].isNotNull(), F.array(F.struct(k["left"].alias("left"), k["right"].alias("right")))).otherwise(F.array().cast(f"array<{STEP}>"))
        return unrolled(k["kid"], F.concat(step, above), digits - 1)

    return F.flatten(F.transform(node["kids"], down))


def leaves(blocks: DataFrame, above: DataFrame | None, roots: DataFrame, digits: int) -> DataFrame:
    """(g, item, path, top) of every leaf of the blocks.

    above: (g, block, path, top) of the blocks of larger groups; roots: (g, path, top) of all groups, for groups of one block.
    """
    types = {"blocks": "long", "node": blocks.schema["node"].dataType} | {c: roots.schema[c.removeprefix("root_")].dataType for c in ("path", "top", "root_path", "root_top")}

    def full(df: DataFrame) -> DataFrame:
        return df.select("g", "block", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    both = full(blocks).unionByName(full(roots.select("g", F.lit(0).cast("long").alias("block"), F.col("path").alias("root_path"), F.col("top").alias("root_top"))))
    both = both if above is None else both.unionByName(full(above))
    one = both.groupBy("g", "block").agg(*[F.first(c, True).alias(c) for c in types]).where("node is not null")
    path, top = (F.when(F.col("blocks") == 1, F.col(f"root_{c}")).otherwise(F.col(c)) for c in ("path", "top"))
    return one.select("g", "node", path.alias("path"), top.alias("top")).select("g", F.explode(unrolled(F.col("node"), F.col("path"), digits)).alias("e"), "top").select("g", "e.item", "e.path", "top")


class Tree:
    """Trees of groups ``g`` over nodes (g, pos, n, item), rolled up round by round until every group is one block."""

    def __init__(self, tables: Tables, nodes: DataFrame, fan: int = FAN, digits: int = DIGITS):
        self.digits, self.rounds = digits, []
        while True:
            self.rounds.append(tables.keep(rollup(nodes, fan, digits)))
            last = self.rounds[-1]
            tops = last.select("g", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.struct(F.col("node.digest").alias("digest"), F.col("block").alias("block")).alias("item"))
            nodes = tops.where("n > 1")
            if nodes.isEmpty():
                break

    def roots(self) -> DataFrame:
        """(g, digest) of every group."""
        rounds = [r.where("blocks = 1").select("g", "node.digest") for r in self.rounds]
        out = rounds[0]
        for r in rounds[1:]:
            out = out.unionByName(r)
        return out

    def paths(self, roots: DataFrame) -> DataFrame:
        """(g, item, path, top) of every leaf; roots: (g, path, top) of every group's root."""
        down = None
        for blocks in reversed(self.rounds):
            above = down and down.select("g", F.col("item.block").alias("block"), "path", "top")
            down = leaves(blocks, above, roots, self.digits)
        return down


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(documents: DataFrame, *, group_col: str = "source", order_col: str = "doc_id", columns: tuple[str, ...] = HASHED, tampered: dict[str, Column] | None = None, fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """One row for each row: order_col, group_col, leaf, subroot (of its group), root, path (siblings up to the root), proof_sha256,
    folded_root (of the tampered leaf and the true path) and verified (it equals root).

    ``tampered`` has the columns that are read otherwise when proofs are verified. Leaves of a group ascend by order_col
    (null first), then by their digest; equal rows are equal leaves, as often as they are there. A null group is a group
    and comes first. A lone leaf is its subroot, a lone subroot the root; the proof of a lone leaf is the digest of an
    empty text. An empty table gives no rows. Very long texts are hashed row by row; other columns play no part.
    """
    tables, tampered = Tables(documents.sparkSession, "merkle"), tampered or {}
    as_read, as_found = [F.col(f"`{c}`") for c in columns], [tampered.get(c, F.col(f"`{c}`")) for c in columns]
    rows = tables.keep(documents.select(F.col(f"`{order_col}`").alias("id"), F.col(f"`{group_col}`").alias("g"), leaf(*as_read).alias("digest"), leaf(*as_found).alias("found"), F.monotonically_increasing_id().alias("row")))
    placed = ranked(tables, rows, "g", ["id", "digest", "row"])
    tree = Tree(tables, placed.select("g", "pos", "n", F.struct("digest", "found", "id").alias("item")), fan, digits)
    groups = ranked(tables, tables.keep(tree.roots().withColumn("all", F.lit(0))), "all", ["g"])
    over = Tree(tables, groups.select(F.col("all").alias("g"), "pos", "n", F.struct("digest", F.col("g").alias("group")).alias("item")), fan, digits)
    root = over.roots().select("g", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("top"))
    subroots = tables.keep(over.paths(root).select(F.col("item.group").alias("g"), "path", F.struct(F.col("item.digest").alias("subroot"), F.col("top").alias("root")).alias("top")))
    out = tree.paths(subroots).select(F.col("item.id").alias(order_col), F.col("g").alias(group_col), F.col("item.digest").alias("leaf"), F.col("item.found").alias("found"), "top.subroot", "top.root", "path")
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = out.withColumns({"proof_sha256": proof, "folded_root": folded(F.col("found"), F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("found")
