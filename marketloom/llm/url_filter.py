"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A listed URL is a host and a path, and stands for all subdomains and longer paths. For each url the filter is asked for
every ending of its host with every beginning of its path that is as long as some listed path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bits of a key in its block of 64; blocks at most (8 bytes each, so that all blocks fit every executor)
BITS, MOST_BLOCKS = 4, 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; the path after it up to ``?`` or ``#``. Both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The form in which listed sites are looked up: no user name, port or closing dots; an empty path is ``/``."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+(:[0-9]*)?$", ""), F.when(path == "", "/").otherwise(path)


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest rule that fits, else null) and ``verdict``: the rule's; where no rule fits
    ``block`` for what ``blocked`` lists; else ``default``.

    ``rules`` has host, path and verdict and fits urls as they are; ``blocked`` has host and path and fits their canonical
    form. Of equal entries the greatest verdict counts, entries with a null are left out. Each distinct url is judged once.
    Null and malformed urls have an empty host, so only a listed empty host fits them; null urls fit nothing. Columns of
    ``pages`` called like the results are replaced; an empty table gives an empty result.
    """
    listed = rules.select("host", "path", "verdict", F.lit(1).alias("own"))
    if blocked is not None:
        listed = listed.unionByName(blocked.select("host", "path", F.lit("block").alias("verdict"), F.lit(0).alias("own")))
    listed = listed.where("host is not null and path is not null and verdict is not null").groupBy("host", "path", "own").agg(F.max("verdict").alias("verdict"))
    key = F.concat(F.col("own").cast("string"), F.lit(" "), "host", "path")
    listed = listed.select(key.alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "own", "verdict")
    lengths = {(r["own"], r["path_length"]) for r in listed.select("own", "path_length").distinct().collect()}  # path lengths, not urls
    blocks = min(MOST_BLOCKS, max(64, listed.count() // 4))
    bloom = listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))

    def keys(own: int, host: str, path: str) -> Column:
        """What is asked for a url: every ending of its host with every beginning of its path."""
        names = F.split(host, "\\.")
        endings = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
        sizes = F.array(*[F.lit(n) for o, n in sorted(lengths) if o == own]).cast("array<int>")
        starts = F.transform(F.filter(sizes, lambda n: n <= F.length(path)), lambda n: F.substring(F.col(path), F.lit(1), n))
        return F.flatten(F.transform(endings, lambda e: F.transform(starts, lambda s: F.struct(F.concat(F.lit(f"{own} "), e, s).alias("key"), F.length(e).alias("host_length")))))

    urls = pages.select(F.col(url_col).alias("u")).distinct().where("u is not null")
    host, path = host_and_path(F.col("u"))
    urls = urls.withColumns({"h": host, "p": path})
    host, path = canonical(F.col("h"), F.col("p"))
    urls = urls.withColumns({"ch": host, "cp": path})
    asked = urls.select("u", F.explode(F.array_distinct(F.concat(keys(1, "h", "p"), keys(0, "ch", "cp")))).alias("k")).select("u", "k.*")
    asked = asked.withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"))})
    possible = asked.join(F.broadcast(bloom), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("u", "key", "host_length")
    hits = possible.join(listed, ["key", "host_length"])
    best = hits.groupBy("u").agg(F.max(F.struct("own", F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))

    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")
    # null urls are in no hit and are spread over the tasks of the join
    spread = F.when(F.col("u").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    out = pages.select(row, F.col(url_col).alias("u")).withColumn("spread", spread).join(best.withColumn("spread", F.lit(0).cast("long")), ["u", "spread"], "left")
    host, path = host_and_path(F.col("u"))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, host.alias("host"), path.alias("path"), F.when(F.col("best.own") == 1, F.col("best.rule")).alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
