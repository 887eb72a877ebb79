"""The registered queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, fim, html, jaccard_join, licenses, lm_scoring, merkle, mixing, permutation_index, secrets, simhash, toxicity, url_filter

#: (host, path, verdict)
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A stand-in for a published list: sites whose pages the filter blocks where no rule speaks, under three top-level domains.
BLOCKED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ENDS = ("example.com", "example.net", "example.org")
TOXIC_FROM = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that are labelled as of good quality; background: all others."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    small = good.count() <= jaccard_join.MOST_IDS
    documents = documents.join(F.broadcast(good) if small else good, "doc_id", "left")
    return lm_scoring.score(documents, target=F.col("good"), keep=["doc_id"]).select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "epoch", "place", "weight", "n_tokens")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(documents, model=secrets.fit(documents)).select("doc_id", "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name):
        return F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    blocked = spark.createDataFrame([(f"{s}.{e}", "/") for s in BLOCKED_SITES for e in BLOCKED_ENDS], "host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, blocked).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "item_words", "covered", "n_tiles", "longest", "coverage")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def toxic_score(spark: SparkSession, documents: DataFrame, sf_dir: str):
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(model, documents, F.col("text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = documents.select("doc_id", held_out.alias("held_out"), toxic_score(spark, documents, sf_dir).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("fim")
    done = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = fim.digest(x["output"]).alias("output_sha256"), fim.digest(x["output"], x["form"]).alias("restored_sha256")
    return done.select("doc_id", x["n"].alias("n"), x["form"].alias("form"), x["prefix_chars"].alias("prefix_chars"), x["middle_chars"].alias("middle_chars"), *digests)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    blocked = ", ".join(f"('{s}.{e}')" for s in BLOCKED_SITES for e in BLOCKED_ENDS)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rules}), blocked(bh) AS (VALUES {blocked}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT row_number() OVER () AS n, page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
parts AS (SELECT n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM split),
fits AS (SELECT n, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
forms AS (SELECT n, regexp_replace(host, '^.*@|:[0-9]*$|\\.+(:[0-9]*)?$', '', 'g') AS ch, CASE WHEN path = '' THEN '/' ELSE path END AS cp FROM parts),
bad AS (SELECT DISTINCT n FROM forms JOIN blocked ON (ch = bh OR ends_with(ch, '.' || bh)) AND starts_with(cp, '/'))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bad.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON parts.n = f.n LEFT JOIN bad ON parts.n = bad.n
"""


FIM_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(t) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS d FROM cut),
placed AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def _merkle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    # the last bit of the crc32 of an id's decimal digits: every byte is mixed in and followed by eight shifts
    steps = "flatten([[ascii(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, length(k) + 1)])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    tree = """
{name} AS (
  SELECT 0 AS level, g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM {start}
  UNION ALL
  SELECT any_value(level) + 1, g, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, pos // 3
)"""
    climb = """
{name} AS (
  SELECT {first}
  UNION ALL
  SELECT c.row, c.g, c.pos // 3, c.level + 1, sha256(coalesce(l.before, '') || c.folded || coalesce(l.behind, '')), c.proof || coalesce(l.before, '') || coalesce(l.behind, ''), c.n
  FROM {name} c JOIN {beside} l ON l.level = c.level AND l.g = c.g AND l.pos = c.pos
)"""
    beside = """
{name} AS (
  SELECT level, g, pos, string_agg(digest, '') OVER (PARTITION BY level, g, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         string_agg(digest, '') OVER (PARTITION BY level, g, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM {tree} WHERE n > 1
)"""
    row = " || ".join(map(part, ("doc_id", "source", "lang", "n_chars")))
    return f"""
WITH RECURSIVE keyed AS (SELECT *, doc_id::VARCHAR AS k FROM documents),
found AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM keyed),
hashed AS (SELECT doc_id, source, sha256({row} || {part("text")}) AS digest, sha256({row} || {part("seen")}) AS other FROM found),
placed AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, row_number() OVER () AS row FROM hashed),
{tree.format(name="low", start="placed")},
subroots AS (SELECT 0 AS g, g AS pos, digest FROM low WHERE n = 1),
{tree.format(name="high", start="subroots")},
{beside.format(name="low_beside", tree="low")},
{beside.format(name="high_beside", tree="high")},
{climb.format(name="inner_path", beside="low_beside", first="row, g, pos, 0 AS level, other AS folded, '' AS proof, doc_id AS n FROM placed")},
halfway AS (SELECT * FROM inner_path QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1),
{climb.format(name="outer_path", beside="high_beside", first="row, 0 AS g, g AS pos, 0 AS level, folded, proof, n FROM halfway")},
whole AS (SELECT * FROM outer_path QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
FROM placed p JOIN whole w ON w.row = p.row JOIN subroots s ON s.pos = p.g CROSS JOIN (SELECT digest FROM high WHERE n = 1) r
"""


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_mixing, op3_license_scan, op4_permutation_index, op5_secret_scan, op6_jaccard_join, op7_url_filter, op8_decontamination, op9_html_text, op10_toxicity, op11_fill_in_middle, op12_simhash, op13_merkle_manifest)
}
ORACLES = {"op7_url_filter": _url_sql(), "op11_fill_in_middle": FIM_SQL, "op13_merkle_manifest": _merkle_sql()}
