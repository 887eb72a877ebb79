import itertools
import re
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, html, jaccard_join, licenses, lm_scoring, mixing, permutation_index, secrets, toxicity, url_filter
from marketloom.llm.crf import train
from marketloom.llm.text import WordHashes, shingles, words

R = random.Random(1)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(400)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    crf = train([[("a",), ("b",), ("a",)]] * 4, [[0, 1, 0]] * 4, 3, rounds=20, forbidden=((0, 2),), not_first=(2,))
    for _ in range(20):
        e = r.normal(size=(5, 3))
        score = lambda p: crf.first[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(crf.decode(e)) == max(itertools.product(range(3), repeat=5), key=score)


def test_jaccard_join(spark):
    r = random.Random(2)
    base = [sentence(r, 80) for _ in range(6)]

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    texts = base + [base[0]] * 30 + [edit(base[1], 1) for _ in range(40)] + [edit(base[2], k) for k in (1, 2, 3)] + ["", None, "one two", "One, two!", "x" * 5]
    rows = list(enumerate(texts)) + [(None, base[3])]
    got = {x["doc_id"]: x for x in jaccard_join.jaccard_join(frame(spark, rows).withColumn("n", F.lit(1)).withColumn("digest", F.lit("x"))).collect()}
    assert len(got) == len(rows) and got[None]["class_id"] is None
    sets = [set(jaccard_join.text_shingles(t, WordHashes(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: got[i]["class_id"] for i in range(len(texts))} == {i: root(i) for i in range(len(texts))}
    assert got[0]["copies"] == 31 and got[texts.index("")]["n_links"] == 0
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


def test_jaccard_join_counts_all_links(spark):
    r = random.Random(14)
    texts = set()
    for size in (12, 16, 17, 40, 300):
        base, family = [r.choice(WORDS) for _ in range(80)], set()
        while len(family) < size:
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            family.add(" ".join(w))
        texts |= family
    texts = sorted(texts, key=lambda t: r.random())
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.jaccard_join(frame(spark, list(enumerate(texts)))).collect()}
    sets = [set(jaccard_join.text_shingles(t, WordHashes(), 5).tolist()) for t in texts]
    n = Counter()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            n[i] += 1
            n[j] += 1
    assert got == {i: n[i] for i in range(len(texts))}


def test_tiles_against_plain_tiling():
    r = random.Random(3)
    for _ in range(60):
        d, i = [r.choice("abc") for _ in range(30)], [r.choice("abc") for _ in range(14)]
        k = 3
        hits = np.array([(x, y) for x in range(len(d) - k + 1) for y in range(len(i) - k + 1) if d[x : x + k] == i[y : y + k]]).reshape(-1, 2)
        if not len(hits):
            continue
        used_d, used_i, plain = set(), set(), 0
        while True:
            best = (0,)
            for y, x in itertools.product(range(len(i)), range(len(d))):
                n = 0
                while x + n < len(d) and y + n < len(i) and d[x + n] == i[y + n] and x + n not in used_d and y + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, y, x)
            if best[0] < k:
                break
            n, y, x = best
            used_d.update(range(x, x + n)), used_i.update(range(y, y + n))
            plain += n
        got = decontaminate.tiles(hits, k)
        assert sum(t[2] for t in got) == plain and all(d[x : x + n] == i[y : y + n] for x, y, n in got)


def test_leaks(spark):
    r = random.Random(4)
    item = sentence(r, 40)
    w = item.split()
    moved = " ".join(w[20:] + w[:20])
    docs = frame(spark, [(1, sentence(r, 50) + " " + item), (2, sentence(r, 30) + " " + moved + " end"), (3, sentence(r, 300)), (4, " ".join(w[:25])), (5, None), (6, ""), (None, item)])
    items = frame(spark, [(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {1, 2} and got[2]["n_tiles"] == 2 and got[1]["coverage"] == 1
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_licenses(spark):
    phrase = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    r = random.Random(5)
    texts = [None, "", "cc by nc", "Under the MIT License! under   the mit license", "Apache License, Version 2.0 CC BY-NC", "under the mit x license", licenses.TEXTS[0][1], licenses.TEXTS[0][1].replace(" of this", " of all of this"), "All Rights Reserved."]
    texts += [" ".join(r.choice("under the mit license cc by nc apache version 2 x é".split()) for _ in range(60)) for _ in range(30)]
    got = {x["doc_id"]: x for x in licenses.scan(frame(spark, list(enumerate(texts))).withColumn("row", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(n, label) for label, p in phrase.items() for n in range(len(w)) if w[n : n + len(p.split())] == p.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["base_labels"]) == (len(w), len(at), ",".join(sorted({a[1] for a in at}))), t
        assert (x["first_word"], x["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert got[6]["labels"] == "mit" and got[7]["labels"] == "mit" and got[8]["labels"] == "all-rights-reserved" and 0 <= got[5]["score"] < 1


def test_permutation_index(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (None, [1.0] * 16)]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id % 100 = 0"), shard_rows=300).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == list(range(1, 11)) and all(abs(g["score"] - d[g["vec_id"]]) < 1e-12 for g in mine)
        hits += len(set(np.argsort(d)[:10]) & {g["vec_id"] for g in mine})
    assert hits >= 81 and {g["query_id"] for g in got} == set(range(0, 900, 100))
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(g["rank"], g["vec_id"]) for g in permutation_index.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert permutation_index.search(few.limit(0), few).count() == 0


@pytest.fixture(scope="module")
def secret_model(spark):
    r = random.Random(7)
    return secrets.fit(frame(spark, [(i, sentence(r, 60)) for i in range(160)]))


def test_secrets(spark, secret_model):
    scanner = secrets.Scanner(secret_model)
    r = random.Random(8)
    for _ in range(40):
        parts = [sentence(r, r.randint(0, 40)), *secrets._planted(r), sentence(r, r.randint(0, 60)), "%%% x=1", sentence(r, 5)]
        text = " ".join(parts)
        tokens, starts = secrets._tokens(text)
        y = secret_model.decode(secrets.emissions(scanner.classes, tokens, secrets._file(text)))
        plain, i = [], 0
        while i < len(y):
            j = i + 1
            if y[i]:
                while j < len(y) and y[j] == 2:
                    j += 1
                plain.append((int(starts[i]), int(starts[j - 1]) + len(tokens[j - 1])))
            i = j
        assert scanner.spans(text) == plain
    docs = frame(spark, [(1, 'é Token = "24be64439e3e49cf46b2" AKIA' + "A1" * 8), (2, None), (3, ""), (4, "secret:token:abcdefgh"), (5, "a" * 23 + " " + "0af" * 9)])
    found = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["secrets"] if s["kind"] != "crf"] for x in secrets.find_secrets(docs, model=secret_model).collect()}
    assert found == {1: [("assign", 2, 31), ("access", 33, 53)], 2: [], 3: [], 4: [], 5: [("hex", 24, 51)]}
    clean = secrets.redact(secrets.find_secrets(docs, model=secret_model)).collect()
    assert clean[0]["text"].count("<secret>") == 2 and clean[1]["text"] is None


def test_secrets_keep_what_runs_on_from_a_pattern(spark, secret_model):
    text = "a b c 0123456789abcdef01234567zqXk9Tt2 d e"
    found = secrets.find_secrets(frame(spark, [(1, text)]), model=secret_model)
    assert {(x["kind"], x["start"], x["end"]) for x in found.first()["secrets"]} == {("hex", 6, 30), ("crf", 6, 38)}
    assert secrets.redact(found).first()["text"] == "a b c <secret> d e"


def test_url_filter(spark):
    rules = frame(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")], "host string, path string, verdict string")
    bad = frame(spark, [("spam.org", "/")], "host string, path string")
    urls = ["http://A.com/x", "http://b.example.com/en/1?q", "http://www.example.com/en/", "https://x.net/es/1#a", "http://com", "nothing", None, "http://u.spam.org/z", "http://notspam.org/z", "http://www.example.com/en/"]
    got = {x["page_id"]: x for x in url_filter.judge(frame(spark, list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("old")), rules, bad).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, "www.example.com/en/"]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert got[0]["host"] == "a.com" and got[6]["host"] == "" and got[4]["path"] == ""


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, r.randint(1, 60)), "big" if i % 3 else f"s{i % 4}") for i in range(900)] + [(900, None, None), (None, "a b", "big")]
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumn("place", F.lit(0))
    total = sum(len((t or "").split()) for _, t, _ in rows)
    out = mixing.mix_sources(docs, entropy=0.95, repetition=4.0, block_tokens=500).toPandas()
    source = {}
    for _, t, s in rows:
        source[s or ""] = source.get(s or "", 0) + len((t or "").split())
    used, weight = out.groupby("source").n_tokens.sum(), out.groupby("source").weight.first()
    for s, n in source.items():
        if n:
            assert weight[s] * total - 60 < used[s] <= weight[s] * total + 1, s
            assert out[out.source == s].groupby("doc_id").size().max() <= weight[s] * total / n + 1
    p = weight.to_numpy()
    assert -(p * np.log(p)).sum() / np.log(len(p)) == pytest.approx(0.95, abs=0.002)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_lm_scoring(spark):
    r = random.Random(10)
    a, b = WORDS[:200], WORDS[200:]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(60)), i % 2 == 1 and i < 120) for i in range(200)] + [(500, None, None), (501, "", True)]
    docs = frame(spark, rows, "doc_id long, text string, good boolean")
    got = {x["doc_id"]: x for x in lm_scoring.score(docs, target=F.col("good")).collect()}
    held = [i for i in range(120, 200)]
    assert np.mean([(got[i]["difference"] > np.median([got[j]["difference"] for j in held])) == (i % 2 == 1) for i in held]) > 0.95
    assert got[500]["n_tokens"] == 0 and got[500]["difference"] == 0 and got[501]["target_loss"] is None
    assert lm_scoring.score(docs.limit(0), target=F.col("good")).count() == 0


def plain_losses(rows, n_contexts):
    """Losses of (text, target) rows by dictionaries of counts."""
    texts = [words(t) for t, _ in rows]
    seen = Counter(w for t, (_, good) in zip(texts, rows) if good for w in t)
    h = WordHashes()
    contexts = set(sorted(seen, key=lambda w: (-seen[w], h.of([w]).view(np.int64)[0]))[:n_contexts])
    alone, pairs, behind = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]

    def add(t, k, by):
        for i, w in enumerate(t):
            alone[k][w] += by
            if i and t[i - 1] in contexts:
                pairs[k][t[i - 1], w] += by
                behind[k][t[i - 1]] += by

    for t, (_, good) in zip(texts, rows):
        add(t, int(good), 1)
    vocabulary = len({w for t in texts for w in t}) + 1
    matched = alone[1].total() / alone[0].total()
    for t, (_, good) in zip(texts, rows):
        add(t, int(good), -1)
        loss = []
        for k, scale in ((0, matched), (1, 1.0)):
            total = 0.0
            for i, w in enumerate(t):
                p = (scale * alone[k][w] + lm_scoring.ADDED) / (scale * alone[k].total() + lm_scoring.ADDED * vocabulary)
                if i and t[i - 1] in contexts:
                    p = (scale * pairs[k][t[i - 1], w] + lm_scoring.PRIOR * p) / (scale * behind[k][t[i - 1]] + lm_scoring.PRIOR)
                total -= np.log(p)
            loss.append(total / len(t))
        add(t, int(good), 1)
        yield loss


@pytest.mark.parametrize("block_bytes", [500, 8_000_000])
def test_lm_scoring_equals_plain_counts(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    r = random.Random(12)
    rows = [(sentence(r, r.randint(1, 50)), i % 3 == 0) for i in range(60)]
    rows += [rows[0]] * 5
    docs = frame(spark, [(i, *x, "x", None) for i, x in enumerate(rows)], "doc_id long, text string, good boolean, block string, difference string").repartition(3)
    got = {x["doc_id"]: x for x in lm_scoring.score(docs, target=F.col("good"), contexts=20).collect()}
    assert len(got) == len(rows) and got[0]["block"] == "x"
    for i, (b, t) in enumerate(plain_losses(rows, 20)):
        assert (got[i]["background_loss"], got[i]["target_loss"]) == pytest.approx((b, t), rel=1e-9)


def test_lm_scoring_counts_behind_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 2_000)
    r = random.Random(13)
    many = [f"w{i}" for i in range(300)]
    rows = [(" ".join(r.choice(many[i % 3 * 50 :]) for _ in range(r.randint(1, 60))), i % 3 == 0) for i in range(120)]
    texts = [t.split() for t, _ in rows]
    alone, pairs, behind = ([Counter(), Counter()] for _ in range(3))
    for t, (_, good) in zip(texts, rows):
        alone[good].update(t), pairs[good].update(zip(t, t[1:])), behind[good].update(t[:-1])
    vocabulary, matched = len({*alone[0], *alone[1]}) + 1, alone[1].total() / alone[0].total()
    got = {x["doc_id"]: x for x in lm_scoring.score(frame(spark, [(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, good boolean").repartition(3), target=F.col("good")).collect()}
    for i, (t, (_, good)) in enumerate(zip(texts, rows)):
        own, loss = (Counter(t), Counter(zip(t, t[1:])), Counter(t[:-1])), []
        for k, scale in ((0, matched), (1, 1.0)):
            mine, total = good == k, 0.0
            for j, w in enumerate(t):
                p = (scale * (alone[k][w] - own[0][w] * mine) + lm_scoring.ADDED) / (scale * (alone[k].total() - len(t) * mine) + lm_scoring.ADDED * vocabulary)
                if j:
                    c = t[j - 1]
                    p = (scale * (pairs[k][c, w] - own[1][c, w] * mine) + lm_scoring.PRIOR * p) / (scale * (behind[k][c] - own[2][c] * mine) + lm_scoring.PRIOR)
                total -= np.log(p)
            loss.append(total / len(t))
        assert (got[i]["background_loss"], got[i]["target_loss"]) == pytest.approx(loss, rel=1e-9)


def test_toxicity_held_out(spark):
    r = random.Random(11)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = sentence(r, r.randint(8, 120)).split()
        for _ in range(2 + len(w) // 40 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["zorkig", "zorkut", "wumplo", "wumpli"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows + [(700, None), (701, "")])
    model = toxicity.fit(docs, frame(spark, labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x["s"] for x in docs.select("doc_id", toxicity.score(model, docs, F.col("text")).alias("s")).collect()}
    held = [i for i in range(600) if fold(i) == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert got[700] == got[701] < 0.5
    assert toxicity.fit(docs.limit(0), frame(spark, [], "doc_id long, toxic int")).score("x") < 0.01


def test_html():
    model = html.fit()
    held = [html.blocks(p) for p in html.labelled_pages(60, seed=99)]
    right = [b.label == y for page in held if page for b, y in zip(page, model.decode(np.array([model.emission(b.features) for b in page])))]
    assert np.mean(right) > 0.98
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Big  day</h1><p>It was <b>a</b>\n good &amp; long day.<script>x()</script><p>We went home, and slept well.</p><div class="ad">Buy this now.</div></article><footer>&copy; me</footer></body></html>'
    assert html.main_text(model, page) == "Big day It was a good & long day. We went home, and slept well."
    assert html.main_text(model, None) == html.main_text(model, "") == ""


def test_shingles():
    h = WordHashes().of(words("a b c d e f"))
    assert len(shingles(h, 5)) == 2 and len(shingles(h[:3], 5)) == 1 and len(shingles(h[:0], 5)) == 0


def near(r, text, edits=1):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_jaccard_join_compares_rows_not_ids(spark):
    r = random.Random(15)
    a, b = sentence(r, 90), sentence(r, 90)
    got = jaccard_join.jaccard_join(frame(spark, [(5, a), (5, b), (7, near(r, a)), (None, b + " x"), (8, "y " + b)])).collect()
    assert sorted((x["doc_id"] or 0, x["class_id"] or 0, x["n_links"]) for x in got) == [(0, 0, 0), (5, 5, 1), (5, 5, 2), (7, 5, 1), (8, 5, 2)]


def test_keep_one(spark):
    r = random.Random(16)
    a, b, c, d = (sentence(r, 90) for _ in range(4))
    rows = [(9, near(r, a), 1), (3, a, 2), (3, a, 3), (3, b, 4), (None, c, 5), (None, c, 6), (None, near(r, d), 7), (11, d, 8), (12, "", 9), (None, None, 10), (13, "!", 11), (4, b, 12)]
    got = jaccard_join.keep_one(frame(spark, rows, "doc_id long, text string, row int").withColumn("_id", F.lit(1)).withColumn("stays", F.lit(0))).collect()
    assert sorted(x["row"] for x in got if x["row"] not in (2, 3, 5, 6)) == [4, 8, 9, 10, 11]
    assert len({2, 3} & {x["row"] for x in got}) == len({5, 6} & {x["row"] for x in got}) == 1 and set(got[0].asDict()) == {"doc_id", "text", "row", "_id", "stays"}
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0


HARD_PAGES = {
    "<p>a</p><![foo bar[x]]>": "a",
    "<article><p>One two three.</p></article>": "One two three.",
    '<article><p>One two three.</p></article><section class="comments"><h3>Comments</h3><div><p>I like it.</p></div></section>': "One two three.",
    "<h1>T</h1><form><label>Search</label><input><button>Go</button></form><p>Text follows here.</p>": "T Text follows here.",
    "<h1>T</h1><svg><path d=''><p>This comes after an unclosed drawing.</p><p>And more.</p>": "T This comes after an unclosed drawing. And more.",
    "<noscript><p>Never closed here.</p>": "Never closed here.",
    "<article><h1>Title of it</h1><p>Some text goes here, and more.</p><ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul></article><footer>c</footer>": "Title of it Some text goes here, and more. First source Second source",
    "<article><p>A b.</p><aside>side</aside><p>B &amp;\n c&#46;</p></article>": "A b. B & c.",
    "": "",
    "<script>x()</script><style>p{}</style><!-- no -->": "",
    "<p>x<": "x<",
}


def test_html_extract(spark):
    long = "<nav><a href=/>Home</a></nav><article>" + "<p>It was a good day, and long.</p>" * 20_000 + "</article>"
    pages = [*HARD_PAGES, None, long, "<p>a</p><![foo bar[x]]>"]
    df = frame(spark, list(enumerate(pages)), "page_id long, html string").withColumns({"text": F.lit("old"), "url": F.lit(None)})
    got = {x["page_id"]: x["text"] for x in html.extract(df).collect()}
    want = [HARD_PAGES.get(p, "") for p in pages]
    want[len(HARD_PAGES) + 1] = " ".join(["It was a good day, and long."] * 20_000)
    assert got == dict(enumerate(want))
    assert html.extract(df.limit(0)).count() == 0


def test_html_against_an_independent_extractor(spark):
    """Pages with an article element, cut by regular expressions: its text without the boxes inside it."""
    import html as standard

    r = random.Random(17)
    s = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    pages = []
    for i in range(40):
        inside = "".join(r.choice((f"<p>{s(r.randint(2, 30))} &eacute;&nbsp;{s(3)}</p>", f"<h2>{s(3)}</h2>", f"<ul><li>{s(4)}</li><li><a href='/x'>{s(2)}</a></li></ul>", f"<aside><p>{s(6)}</p></aside>", f"<div class='ad'>{s(5)}</div>", f"<script>var x = '{s(3)}'</script>")) for _ in range(r.randint(2, 9)))
        pages.append((i, f"<html><head><title>{s(3)}</title></head><body><header>{s(2)}</header><nav><ul><li><a href='/'>{s(1)}</a></li></ul></nav><div class='cookie-banner'>{s(4)}</div><article><h1>{s(4)}</h1>{inside}</article><section class='comments'><p>{s(9)}</p></section><aside>{s(4)}</aside><footer>&copy; {s(2)}</footer></body></html>"))
    got = {x["page_id"]: x["text"] for x in html.extract(frame(spark, pages, "page_id long, html string")).collect()}
    for i, page in pages:
        article = re.sub(r"<(aside|script)>.*?</\1>|<div class='ad'>.*?</div>", " ", re.search("<article>(.*)</article>", page)[1])
        assert got[i] == " ".join(standard.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_url_filter_edges(spark):
    rules = frame(spark, [("com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    bad = frame(spark, [("spam.org", "/"), ("x.org", "/a/")], "host string, path string")
    urls = ["http://spam.org", "http://u:p@spam.org:80/z", "http://SPAM.org.?q", "http://x.org/a/b", "http://x.org/b", None, None, "http://y.org/" + "a" * 50_000, "http://spam.org", "http://spam.org.evil.net/"]
    df = frame(spark, list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("old") for c in ("best", "_url_", "u", "key", "row", "spread", "rule")})
    got = url_filter.judge(df, rules, bad)
    assert {x["page_id"]: x["verdict"] for x in got.collect()} == dict(enumerate(["block"] * 4 + ["allow"] * 4 + ["block", "allow"]))
    assert set(got.columns) == {*df.columns, "host", "path", "verdict"} and got.where("rule is not null").count() == 0
    assert url_filter.judge(df.limit(0), rules, bad).count() == 0


def test_mixing_realises_the_permutation(spark):
    """Blocks, their order in each epoch and the cut of the last, partial epoch, against plain loops over the same hashes."""
    r = random.Random(18)
    rows = [(i, sentence(r, r.randint(0, 40)), r.choice(["a", "a", "a", "b", None])) for i in range(300)] + [(7, "twice the same id", "a"), (None, "no id at all", "a"), (None, "nor here", "b")]
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("blocks", "left", "_source", "block", "row", "id")})
    budget, block_tokens, seed = 9_000, 700, 2
    out = mixing.mix_sources(docs, budget=budget, block_tokens=block_tokens, seed=seed, entropy=None)
    assert set(out.columns) == {*docs.columns, "epoch", "weight", "place", "n_tokens"}
    tokens = Counter()
    for _, t, s in rows:
        tokens[s or ""] += len(t.split())
    n_blocks = {s: max(1, -(-n // block_tokens)) for s, n in tokens.items()}
    hashed = {(x["i"], x["s"]): x for x in docs.select(F.col("doc_id").alias("i"), F.coalesce("source", F.lit("")).alias("s"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), *(F.xxhash64(F.lit(e), "doc_id").alias(f"o{e}") for e in range(9))).collect()}
    size = Counter()
    for i, t, s in rows:
        size[s or "", hashed[i, s or ""]["h"] % n_blocks[s or ""]] += len(t.split())
    order = {(x["e"], x["s"], x["b"]): x["h"] for x in frame(spark, [(e, s, b) for s in tokens for b in range(n_blocks[s]) for e in range(9)], "e int, s string, b int").withColumn("h", F.xxhash64(F.lit(seed), "e", "s", "b")).collect()}
    want = Counter()
    for s, total in tokens.items():
        left, epoch = budget * total / sum(tokens.values()), 0
        while left > 1e-6:
            have = min(left, total)
            for place, b in enumerate(sorted({b for t, b in size if t == s}, key=lambda b: (order[epoch, s, b], b)), 1):
                if have < 1e-6:
                    break
                mine = [(i, t) for i, t, x in rows if (x or "") == s and hashed[i, s]["h"] % n_blocks[s] == b]
                if size[s, b] <= have + 1e-6:
                    want.update((i, t, s, epoch, place) for i, t in mine)
                    have -= size[s, b]
                    continue
                each = Counter()
                for i, t in mine:
                    each[i] += len(t.split())
                for i in sorted(each, key=lambda i: (hashed[i, s][f"o{epoch}"], (i is not None, i or 0))):
                    have -= each[i]
                    if have < -1 + 1e-6:
                        break
                    want.update((j, t, s, epoch, place) for j, t in mine if j == i)
                break
            left, epoch = left - total, epoch + 1
    assert Counter((x["doc_id"], x["text"], x["source"] or "", x["epoch"], x["place"]) for x in out.collect()) == want


def test_leaks_against_plain_tiling(spark):
    r = random.Random(19)
    few = "a b c d e f g h".split()
    docs = [(i, " ".join(r.choice(few) for _ in range(r.randint(3, 90)))) for i in range(40)] + [(41, "a " * 3_000)]
    items = [(i % 9, " ".join(r.choice(few) for _ in range(r.randint(2, 14)))) for i in range(12)] + [(20, "a " * 20)]
    for i, (_, t) in enumerate(items[:6]):
        w = t.split()
        docs.append((50 + i, " ".join(w[len(w) // 2 :] + ["z"] + w[: len(w) // 2])))
    k = 3
    want = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        x, y = words(text), words(item)
        hits = np.array([(a, b) for a in range(len(x) - k + 1) for b in range(len(y) - k + 1) if x[a : a + k] == y[b : b + k]]).reshape(-1, 2)
        covered = sum(t[2] for t in decontaminate.tiles(hits, k)) if len(hits) else 0
        if len(y) >= k and covered / len(y) >= 0.8:
            want[d, i] = max(want.get((d, i), 0), covered / len(y))
    got = decontaminate.find_leaks(frame(spark, docs).withColumn("h", F.lit(1)), frame(spark, items, "item_id long, text string").withColumn("gram", F.lit("")), k=k).collect()
    assert want and {(x["doc_id"], x["item_id"]): x["coverage"] for x in got} == want


def test_permutation_index_on_several_shards(spark):
    r = np.random.default_rng(20)
    centres = r.normal(size=(12, 32))
    x = np.concatenate([centres[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 32)), r.normal(size=(20, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[200].tolist()), (1, x[300].tolist()), (2, x[200].tolist())]
    df = frame(spark, rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "rank": F.lit(1)})
    got = permutation_index.search(df, df.where("vec_id % 100 = 0"), shard_rows=400, block_rows=10).collect()
    ids, all_ = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 3020, 100):
        d = np.sqrt(((all_ - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        best = np.lexsort((ids, d))[:10]
        hits += sum(min(a, b) for a, b in ((Counter(ids[best])[i], Counter(g["vec_id"] for g in mine)[i]) for i in set(ids[best])))
        if q in (200, 300):
            assert 1 in {g["vec_id"] for g in mine if g["score"] == 0}
    assert hits >= 0.9 * 10 * len(range(0, 3020, 100))


def test_two_marks_at_every_distance(secret_model):
    scanner, r = secrets.Scanner(secret_model), random.Random(22)
    for gap in range(1, 31):
        for first, second in itertools.product(("%%%", "x=1", "AKIA" + "Z9" * 9, "password"), repeat=2):
            text = " ".join([sentence(r, 30), first, *([sentence(r, gap - 1)] if gap > 1 else []), second, sentence(r, 40)])
            tokens, starts = secrets._tokens(text)
            y = secret_model.decode(secrets.emissions(scanner.classes, tokens, secrets._file(text)))
            inside = {int(s) for s, label in zip(starts, y) if label}
            assert inside == {int(s) for s in starts for a, b in scanner.spans(text) if a <= s < b}, (gap, first, second)
