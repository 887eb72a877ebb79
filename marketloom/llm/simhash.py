"""SimHash near-duplicates: 64-bit fingerprints of word 3-shingles, linked by pigeonring filtering.

The bits lie in a ring of segments. If two fingerprints differ in at most d bits, there is a segment from which every chain
of consecutive segments stays within its share of d: the first l of m segments differ in at most floor(l * d / m) bits.
So with d = 2 and three segments, one segment is equal and the next one differs in at most one bit; then one half of that
one is equal too. Rows meet by equal segment and half segment, about 32 bits, twice for each segment; the rest of the chain
prunes the pairs before the whole distance is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.jaccard_join import components
from marketloom.llm.stored import Tables
from marketloom.llm.text import small_batches

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BITS, SEGMENTS = 64, 3
#: Differing bits of a link. The keys hold for 2 bits over 3 segments.
MOST = 2
#: Buckets of up to so many fingerprints are compared pair by pair, larger ones by the values one bit away.
SMALL = 32


def shingle_hashes(data: bytes, k: int, seed: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of every run of k words in order, by parts of bounded size; fewer words are one run, none gives nothing."""
    at, kept, runs = 0, [], 0
    while at < len(data):
        end = at + chunk
        cut = SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        words = kept + data[at:end].lower().split()  # bytes: only A-Z change, and only ASCII white space divides
        at = end
        kept = words[1 - k :] if k > 1 else []
        if len(words) < k:
            kept = words
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, ends = [0, *ends[:-k].tolist()], (ends[k - 1 :] - 1).tolist()
        text = b" ".join(words)
        runs += len(starts)
        yield np.array([xxhash.xxh64_intdigest(text[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    if not runs and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), seed)], np.uint64)


def fingerprint(data: bytes, k: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half of the hashes have it; 0 without words."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(data, k, seed):
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, id_col: str, text_col: str, *, k: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp: the fingerprint as a signed number) of each row."""
    small_batches(documents.sparkSession)

    def sign(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), k, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(sign, "id long, fp long")


def _mask(start: int, n: int) -> int:
    """n bits of the ring from a place on, as a signed number."""
    x = sum(1 << (start + i) % BITS for i in range(n))
    return x - (1 << 64) if x >= 1 << 63 else x


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, length) of each segment, as equal as can be."""
    ends = [round(BITS * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def keys(fp: Column) -> Column:
    """The values by which a fingerprint meets others: for each segment, it and either half of the next one."""
    parts, out = ring(), []
    for i, (start, n) in enumerate(parts):
        after, m = parts[(i + 1) % len(parts)]
        for at, size in ((after, m // 2), (after + m // 2, m - m // 2)):
            bits = _mask(start, n) | _mask(at, size)
            out.append(F.struct(F.lit(len(out)).alias("kind"), fp.bitwiseAND(F.lit(bits)).alias("bits")))
    return F.array(*out)


def chain(x: Column, kind: Column) -> Column:
    """Whether the differing bits x keep to the budgets of the chain from the kind's segment on."""
    parts, within = ring(), F.lit(False)
    for i in range(len(parts)):
        bits, fits = 0, F.lit(True)
        for n in range(1, len(parts) + 1):
            bits |= _mask(*parts[(i + n - 1) % len(parts)])
            fits &= F.bit_count(x.bitwiseAND(F.lit(bits))) <= n * MOST // len(parts)
        within |= (F.floor(kind / 2) == i) & fits
    return within


def links(tables: Tables, values: DataFrame) -> DataFrame:
    """(a, b) that connect the same fingerprints (``fp``, distinct) as all pairs that differ in at most ``MOST`` bits do.

    Buckets of at most ``SMALL`` members compare their pairs, so that a row makes a bounded number of pairs. Members of
    larger buckets go by the 65 values at most one bit away: two that share one differ in two bits at most, and two that
    differ in at most two share one; so each value connects all its members to the least of them, without pairs.
    """
    met = values.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    sized = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    busy = tables.keep(met.join(sized, "key"))
    few = busy.where(F.col("members") <= SMALL)
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(chain(x, F.col("key.kind")))
    pairs = pairs.where(F.bit_count(x) <= MOST).select("a", "b").distinct()
    crowd = busy.where(F.col("members") > SMALL).select("fp").distinct()
    away = [F.lit(0).cast("long"), *[F.lit(_mask(i, 1)).cast("long") for i in range(BITS)]]
    steps = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(s) for s in away])).alias("by"))
    least = steps.groupBy("by").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = steps.join(least, "by").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """One row for each row: id, fingerprint (16 hex digits), component_id: the smallest id that links of at most two
    differing bits reach, its own included.

    Null and empty texts have fingerprint zero, which links like any other; repeated rows and ids come back as often as they
    are there. Rows without id connect others and get the component's smallest id, null if nobody in it has one. Very long
    texts are hashed in parts. Other columns play no part.
    """
    tables = Tables(documents.sparkSession, "simhash")
    rows = tables.keep(fingerprints(documents, id_col, text_col, k=k, seed=seed))
    values = tables.keep(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    linked = tables.keep(links(tables, values.select("fp")))
    classes = components(tables, linked)
    named = values.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    lowest = named.groupBy("class").agg(F.min("low").alias("component_id"))
    # only fingerprints that several rows have or that are linked can lead to another id than the row's own
    facts = named.join(lowest, "class").where((F.col("n") > 1) | ~F.col("low").eqNullSafe(F.col("component_id"))).select("fp", "component_id", F.lit(True).alias("known"))
    out = rows.join(facts, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
