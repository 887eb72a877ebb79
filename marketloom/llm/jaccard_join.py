"""N-gram Jaccard join: MinHash banding for candidates, verified on the full sets of word 5-grams.

Texts with equal sets of gram hashes form one copy class and take part once, as a node. Rows and bands are chosen for a
target recall. The buckets of a band are shuffled together and joined by leaders, so that the pairs of a group of copies
grow with the group and not with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.stored import Tables
from marketloom.llm.text import WordHashes, shingles, small_batches, words

#: An id list up to so many rows (8 bytes each) is sent to every executor; a longer one is shuffled.
MOST_IDS = 1_000_000
#: Buckets and components of up to so many classes are compared by rows of pairs, larger ones block by block.
SMALL = 16


def band_shape(similarity: float, recall: float, rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that catch a pair of exactly this similarity with this chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))), rows


def text_shingles(text: str | None, table: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a shorter text is one run, a text without words has none."""
    return np.unique(shingles(table.of(words(text)), k))


def signatures(documents: DataFrame, id_col: str, text_col: str, *, k: int, bands: int, rows: int, seed: int = 6) -> DataFrame:
    """(row, id, key: md5 of the text, digest of the shingle set or null, n: number of shingles, buckets: one hash per band)."""

    def sign(batches):
        rng, table = np.random.default_rng(seed), WordHashes()
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for pdf in batches:
            out = []
            for row, i, key, text in zip(pdf["row"], pdf["id"], pdf["key"], pdf["text"]):
                s = text_shingles(text, table, k)
                if not len(s):
                    out.append((row, i, key, None, 0, []))
                    continue
                low = np.full(bands * rows, 2**64 - 1, np.uint64)
                for at in range(0, len(s), 1024):
                    np.minimum(low, (s[at : at + 1024, None] * a + b).min(axis=0), out=low)
                buckets = [xxhash.xxh3_64_intdigest(x.tobytes(), band) - 2**63 for band, x in enumerate(low.reshape(bands, rows))]
                out.append((row, i, key, set_digest(s), len(s), buckets))
            yield pd.DataFrame(out, columns=["row", "id", "key", "digest", "n", "buckets"]).astype({"id": "Int64"})

    rows_ = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows_.mapInPandas(sign, "row long, id long, key string, digest string, n long, buckets array<long>")


def set_digest(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def hinted(ids: DataFrame) -> DataFrame:
    """The list, sent to every executor if it is short."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def shingle_sets(documents: DataFrame, wanted: DataFrame, text_col: str, k: int) -> DataFrame:
    """(node, set of shingles) of the wanted nodes (node, digest, key: that of one of its texts)."""

    def sets(batches):
        table, seen = WordHashes(), set()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                same = xxhash.xxh3_128_digest(text)
                if same not in seen:
                    seen.add(same)
                    s = text_shingles(text, table, k)
                    out.append((set_digest(s), s.view(np.int64)))
            yield pd.DataFrame(out, columns=["digest", "s"])

    texts = documents.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(hinted(wanted.select("key")), "key", "left_semi")
    return texts.select("text").mapInPandas(sets, "digest string, s array<long>").join(wanted.select("node", "digest"), "digest").select("node", "s").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact Jaccard similarity of the two sets to distinct pairs (a, b)."""

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, jaccard("x", "y").alias("similarity"))


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that is connected to each node of the links (a, b), for nodes other than it.

    Alternates large-star and small-star steps until nothing changes; each node keeps few neighbours, and a hub's are
    handled by aggregation and joins, never in one task's memory.
    """
    edges = tables.keep(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("class")).where("node <> class").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("class").alias("node"), F.col("node").alias("class")))
        low = both.groupBy("node").agg(F.least("node", F.min("class")).alias("m"))
        large = both.join(low, "node").where("class > node").select(F.col("class").alias("node"), F.col("m").alias("class")).distinct()
        low = large.groupBy("node").agg(F.min("class").alias("m"))
        ways = F.array(F.struct("node", F.col("m").alias("class")), F.struct(F.col("class").alias("node"), F.col("m").alias("class")))
        old, edges = edges, tables.keep(large.join(low, "node").select(F.explode(ways).alias("e")).select("e.*").where("node <> class").distinct())
        tables.drop(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "class").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state


def block_links(crowd: DataFrame, sets: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """Links (a, b, similarity) of large buckets, of which ``crowd`` has (most: the commonest component, node, c: its component).

    Members outside the commonest component, in blocks, meet all members, in blocks: each task gets two blocks of
    bounded size and returns only the similar pairs, so that the pairs themselves are never rows.
    """
    sizes = crowd.groupBy("most").agg(F.ceil(F.count("*") / block).cast("int").alias("rights"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("c") != F.col("most")) / block)).cast("int").alias("lefts"))
    rows = crowd.join(sizes, "most").join(sets, "node")

    def number(n: str, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = rows.where("c <> most").select("most", "node", "c", "s", number("lefts", 1).alias("x"), every("rights").alias("y"))
    right = rows.select(F.col("most").alias("group"), F.col("node").alias("rid"), F.col("c").alias("rc"), F.col("s").alias("rs"), number("rights", 2).alias("ry"), every("lefts").alias("rx"))

    def meet(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(l) and len(r):
            sizes_ = np.array([len(x) for x in r["rs"]])
            values, owners = np.concatenate(list(r["rs"])), np.repeat(np.arange(len(r)), sizes_)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            ids, cs = r["rid"].to_numpy(), r["rc"].to_numpy()
            for i, c, s in zip(l["node"], l["c"], l["s"]):
                a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                hit = np.flatnonzero(b > a)
                n = b[hit] - a[hit]
                at = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owners[at], minlength=len(r))
                j = both / (len(s) + sizes_ - both)
                out += [(min(i, int(ids[k])), max(i, int(ids[k])), float(j[k])) for k in np.flatnonzero((j >= similarity) & (ids != i) & (cs != c))]
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return left.groupBy("most", "x", "y").cogroup(right.groupBy("group", "rx", "ry")).applyInPandas(meet, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def block_degrees(members: DataFrame, sets: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """(node, n_links) within large components: members (node, class). Every two blocks of a component meet once in a task,
    which returns only the number of links of each node, so that the pairs are never rows."""
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "class").join(sets, "node").withColumn("at", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("at", o).alias("x"), F.greatest("at", o).alias("y"))))
    dealt = rows.withColumn("cell", cells).select("class", "cell.x", "cell.y", "at", "node", "s")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, at = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0]), pdf["at"].to_numpy()
        ids, each = pdf["node"].to_numpy(), pdf["s"].to_list()
        l, r = np.flatnonzero(at == x), np.flatnonzero(at == y)
        degrees = np.zeros(len(ids), np.int64)
        if len(l) and len(r):
            sizes_ = np.array([len(each[i]) for i in r])
            values, owners = np.concatenate([each[i] for i in r]), np.repeat(np.arange(len(r)), sizes_)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            for i in l:
                a, b = np.searchsorted(values, each[i], "left"), np.searchsorted(values, each[i], "right")
                n = b - a
                hits = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owners[hits], minlength=len(r))
                linked = (both / (len(each[i]) + sizes_ - both) >= similarity) & (ids[r] != ids[i])
                degrees[i] += linked.sum()
                if x != y:
                    degrees[r] += linked
        return pd.DataFrame({"node": ids, "n_links": degrees})

    found = dealt.groupBy("class", "x", "y").applyInPandas(meet, "node long, n_links long")
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def find_links(tables: Tables, documents: DataFrame, members: DataFrame, text_col: str, *, similarity: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, class) and (node, n_links) of linked copy classes. members: (node, n, digest, key, buckets), a row for each copy class.

    First every member of a bucket is compared with the bucket's leader, which joins a group of copies with as many
    pairs as it has members. Then the pairs of a bucket that are still in different components are compared, unless
    their sizes or their distances from the leader already tell them apart; so no two documents that share a bucket
    and are similar stay in different classes. Last, all pairs of each component are compared, for their number of links.
    """
    rows = members.select("node", "n", F.explode("buckets").alias("bucket"))
    order = F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(4))), "node")  # a node meets few leaders, and not always the same one
    led = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min_by("node", order).alias("lead")).where("members > 1")
    shared = tables.keep(rows.join(led, "bucket"))
    sets = tables.keep(shingle_sets(documents, members.select("node", "digest", "key").join(shared.select("node").distinct(), "node"), text_col, k))

    met = tables.keep(verified(shared.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), sets))
    classes = components(tables, met.where(F.col("similarity") >= similarity))

    # buckets whose members are in several components: members outside the commonest one are compared with all others
    known = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).withColumnsRenamed({"a": "node", "b": "lead"})
    apart = tables.keep(shared.where("members > 2").join(classes, "node", "left").withColumn("c", F.coalesce("class", "node")).drop("class"))
    several = apart.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.mode("c", True).alias("most")).where("lo <> hi")
    apart, old = tables.keep(apart.join(several.select("bucket", "most"), "bucket")), apart
    tables.drop(old, shared)
    small = apart.where(F.col("members") <= SMALL).join(known, ["node", "lead"], "left").withColumn("far", 1 - F.coalesce("similarity", F.lit(1.0)))
    other = small.where("c <> most").select("bucket", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("far").alias("fa"))
    rest = small.join(other, "bucket").where(
        (F.col("c") != F.col("ca")) & ((F.col("c") == F.col("most")) | (F.col("a") < F.col("node"))) & (F.abs(F.col("far") - F.col("fa")) <= 1 - similarity + 1e-9)
        & (F.least("n", "na") >= F.greatest("n", "na") * similarity)
    )
    rest = rest.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    crowd = apart.where(F.col("members") > SMALL).select("most", "node", "c").distinct()
    met, first = tables.keep(met.unionByName(verified(rest, sets)).unionByName(block_links(crowd, sets, similarity)).dropDuplicates(["a", "b"])), met
    tables.drop(first, apart)
    links = met.where(F.col("similarity") >= similarity)
    classes, old = components(tables, links), classes
    tables.drop(old)

    inside = classes.unionByName(classes.select(F.col("class").alias("node"), "class").distinct())
    inside = tables.keep(inside.join(inside.groupBy("class").agg(F.count("*").alias("size")), "class"))
    lists = inside.where((F.col("size") > 2) & (F.col("size") <= SMALL)).groupBy("class").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    couples = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    left = lists.select(F.explode(couples).alias("p")).select("p.a", "p.b").join(met, ["a", "b"], "left_anti")
    each = links.select("a", "b").unionByName(verified(left, sets).where(F.col("similarity") >= similarity).select("a", "b")).select(F.explode(F.array("a", "b")).alias("node"))
    few = each.join(inside.where(F.col("size") <= SMALL), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n_links"))
    degrees = tables.keep(few.unionByName(block_degrees(inside.where(F.col("size") > SMALL).select("node", "class"), sets, similarity)))
    tables.drop(met, inside, sets)
    return classes, degrees


def classify(documents: DataFrame, id_col: str, text_col: str, *, similarity: float, k: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(id, key, digest) of each row, and facts of each digest: copy_id, copies, class (a number), class_id, n_links."""
    spark = documents.sparkSession
    small_batches(spark)
    tables = Tables(spark, "jaccard")
    bands, rows = band_shape(similarity, recall)
    signed = tables.keep(signatures(documents, id_col, text_col, k=k, bands=bands, rows=rows))
    copies = tables.keep(signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("copy_id"), F.count("id").alias("copies")))
    members = tables.keep(signed.select(F.col("row").alias("node"), "n", "digest", "key", "buckets").join(copies.select("node"), "node", "left_semi"))
    slim, old = tables.keep(signed.select("id", "key", "digest")), signed
    tables.drop(old)
    classes, degrees = find_links(tables, documents, members, text_col, similarity=similarity, k=k)
    facts = copies.join(classes, "node", "left").join(degrees, "node", "left").withColumn("class", F.coalesce("class", "node"))
    lowest = facts.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    facts, old = tables.keep(facts.join(lowest, "class").select("digest", "copy_id", "copies", "class", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))), copies
    tables.drop(old, members, classes, degrees)
    return slim, facts


def jaccard_join(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 5, recall: float = 0.997) -> DataFrame:
    """One row per document: id, copy_id (smallest id with the same set of word k-grams), copies (rows with that set), class_id
    (smallest id connected by links of at least ``similarity``), n_links (verified links of its copy class).

    Rows are compared, not ids: rows that repeat an id with different texts belong to the classes of their texts. Texts
    without words link to nothing and are their own class; a text of fewer than k words is one gram. Rows without id
    can't be named in a link: they come back with null copy_id and class_id, 1 copy and 0 links, but connect others.
    """
    rows, facts = classify(documents, id_col, text_col, similarity=similarity, k=k, recall=recall)
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(facts, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 5, recall: float = 0.997) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id (rows without id last), then the
    smallest md5 of its text. Texts without words all stay. Of rows that agree in id and text, one stays."""
    rows, facts = classify(documents, id_col, text_col, similarity=similarity, k=k, recall=recall)
    one = rows.join(facts.select("digest", "class"), "digest").groupBy("class", "id", "key").agg(F.count("*").alias("times"))
    first = one.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    tables = Tables(documents.sparkSession, "kept")
    # rows that must go, and rows of which one stays
    marked = one.join(first, "class").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).where("not stays or times > 1")
    marked = tables.keep(marked.select(F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), F.col("key").alias("_key"), "stays"))
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")).withColumns({"_id": F.coalesce(F.col("row")[id_col].cast("long"), F.lit(0)), "_none": F.col("row")[id_col].isNull(), "_key": text_key(F.col("row")[text_col])})
    on = ["_id", "_none", "_key"]
    again = keyed.join(hinted(marked.where("stays").drop("stays")), on, "left_semi").dropDuplicates(on)
    return keyed.join(hinted(marked.drop("stays")), on, "left_anti").unionByName(again).select("row.*")
