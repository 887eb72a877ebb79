"""The registered queries and the pipeline's stages on small tables, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import corpus_pipeline
from marketloom.llm import queries
from marketloom.llm.jaccard_join import text_shingles
from marketloom.llm.text import WordHashes
from test_llm import near, sentence

TOXIC = ["zorkig", "zorkut", "wumplo", "wumpli"]
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and the documents by what they are."""
    r, folder = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    item = sentence(r, 60)
    texts, kinds = [], []

    def add(kind, text):
        texts.append(text)
        kinds.append(kind)

    for i in range(420):
        w = sentence(r, r.randint(20, 120)).split()
        toxic = i % 4 == 0
        for _ in range(2 + len(w) // 40 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(TOXIC))
        add("toxic" if toxic else "plain", " ".join(w))
    for i in (1, 2, 3, 5):
        for _ in range(3):
            add("copy", texts[i])
        add("near", near(r, texts[i]))
    add("leak", f"{sentence(r, 40)} {item} {sentence(r, 10)}")
    add("leak", " ".join(item.split()[30:] + item.split()[:30]))
    for value in ('password = "Ab12Cd34Ef56"', "AKIA" + "Q7" * 9, "5f" * 20):
        add("secret", f"{sentence(r, 30)} {value} {sentence(r, 30)}")
    for text in (None, "", "...", LONG):
        add("odd", text)
    rows = [(i, t, "en", r.choice(["web", "web", "web", "wiki", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(k == "toxic")) for i, k in enumerate(kinds[:420])], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(enumerate(kinds)), dict(enumerate(texts))


def test_secret_query(spark, tables):
    folder, _, texts = tables
    for x in queries.op5_secret_scan(spark, folder).collect():
        text = texts[x["doc_id"]] or ""
        base = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = sorted(base, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [x[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert x["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [s for s in x["spans"].split(",") if s and not s.startswith("crf")] == joined


def test_toxicity_query(spark, tables):
    folder, kinds, _ = tables
    got = {x["doc_id"]: x for x in queries.op10_toxicity(spark, folder).collect()}
    assert len(got) == len(kinds) and all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and x["predicted"] == (x["score"] >= 0.7) and 0 <= x["score"] <= 1 for i, x in got.items())
    held = [i for i, k in kinds.items() if k in ("toxic", "plain") and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (kinds[i] == "toxic") for i in held) >= 0.97 * len(held)


def test_license_query(spark, tables):
    folder, kinds, texts = tables
    got = {x["doc_id"]: x for x in queries.op3_license_scan(spark, folder).collect()}
    assert len(got) == len(kinds) and all(x["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[i] or "").lower())) for i, x in got.items())


def test_pipeline_stages(spark, tables):
    folder, kinds, texts = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "secrets", "mixing"]
    docs, kept, columns = spark.read.parquet(f"{folder}/documents.parquet"), dict(texts), None
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        got = {x["doc_id"]: x["text"] for x in docs.select("doc_id", "text").collect()}
        if name == "toxicity":
            gone = set(kept) - set(got)
            assert sum(kinds[i] == "toxic" for i in gone) >= 0.97 * sum(k == "toxic" for k in kinds.values()) and sum(kinds[i] != "toxic" for i in gone) <= 2
        elif name == "near_copies":
            sets = {i: set(text_shingles(t, WordHashes(), 5).tolist()) for i, t in kept.items()}
            parent = {i: i for i in kept}

            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in itertools.combinations(sorted(kept), 2):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
            assert set(got) == {root(i) for i in kept}
        elif name == "decontamination":
            assert set(kept) - set(got) == {i for i in kept if kinds[i] == "leak"}
        elif name == "secrets":
            assert set(got) == set(kept)
            for i, t in got.items():
                assert t == kept[i] if kinds[i] == "plain" else True
                if kinds[i] == "secret":
                    assert "<secret>" in t and not re.search("Ab12Cd34|AKIAQ7|5f5f5f", t)
        else:
            words = lambda t: len(re.findall(r"\S+", t or ""))
            used = docs.agg({"n_tokens": "sum"}).first()[0]
            total = sum(words(t) for t in kept.values())
            assert {"epoch", "weight", "place", "n_tokens"} <= set(docs.columns) and 0.8 * total <= used <= total + 1 and set(got) <= set(kept)
        if name != "mixing":
            assert docs.columns == columns
        kept = got
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        assert q(spark, folder).count() == 0, name
