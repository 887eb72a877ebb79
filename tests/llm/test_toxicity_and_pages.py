"""Kneser-Ney probabilities against a plain version, label rows in any order, deeply nested pages."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import html, toxicity
from test_llm import sentence


def plain_differences(texts):
    """texts: one list for each class -> (gram -> log P1 - log P0, context -> that of a gram that nobody has seen there)."""
    counts = [Counter(g for t in ts for g in toxicity._grams(t)) for ts in texts]
    levels = [set(counts[0]) | set(counts[1])]
    while levels[-1]:
        levels.append({g[1:] for g in levels[-1] if len(g) > 1})
    kinds = Counter()  # over how many different letters each shorter gram has been seen
    for upper in levels:
        kinds.update(g[1:] for g in upper if len(g) > 1)
    letters = {c: [g for g in kinds if g[:-1] == c] for c in {g[:-1] for g in kinds}}

    def shared(g):
        if not g:
            return toxicity.FLOOR
        after = letters.get(g[:-1])
        if after is None:
            return shared(g[1:])
        total = sum(kinds[x] for x in after)
        return max(kinds[g] - 0.75, 0) / total + 0.75 * len(after) / total * shared(g[1:])

    def p(k, g):
        after = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not after:
            return shared(g[1:])
        total = sum(after.values())
        return max(after.get(g, 0) - 0.75, 0) / total + 0.75 * len(after) / total * shared(g[1:])

    return {g: np.log(p(1, g) / p(0, g)) for g in levels[0]}, {g[:-1]: np.log(p(1, g[:-1] + "\x01") / p(0, g[:-1] + "\x01")) for g in levels[0]}, counts


def test_kneser_ney_probabilities():
    r = random.Random(3)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 8)))
    texts = [[" ".join(word("abcde") for _ in range(12)) for _ in range(8)], [" ".join(word("abxyé") for _ in range(9)) for _ in range(5)]]
    grams, contexts, counts = plain_differences(texts)
    tables = toxicity.build_tables({g: (counts[0][g], counts[1][g]) for g in grams})
    got, found = tables[0].get(toxicity._keys(list(grams))[0])
    assert found.all() and np.allclose(got, list(grams.values()), atol=1e-4)
    got, found = tables[1].get(toxicity._keys([c + "x" for c in contexts])[1])
    assert found.all() and np.allclose(got, list(contexts.values()), atol=1e-4)


def test_rows_in_any_order_give_the_same_model(spark):
    r = random.Random(14)
    rows = [(i, sentence(r, 30) + (" zorkig wumplo" if i % 3 == 0 else ""), "clash") for i in range(150)]
    rows += [(i, sentence(r, 10), "clash") for i in range(20)]  # ids with two texts
    labels = [(i, int(i % 3 == 0)) for i in range(150)] + [(i, 1 - int(i % 3 == 0)) for i in range(30, 50)] + [(i, int(i % 3 == 0)) for i in range(60, 90)] + [(7, None), (None, 1)]
    scores = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        random.Random(seed).shuffle(labels)
        docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(seed + 1)
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(seed))
        out = docs.withColumn("s", toxicity.score(model, docs, F.col("text"))).collect()
        scores.append(sorted((x["doc_id"], x["text"], x["s"]) for x in out))
    for other in scores[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in scores[0]] and [x[2] for x in other] == pytest.approx([x[2] for x in scores[0]], abs=1e-9)
    clean = [i for i in range(150) if not 30 <= i < 50]
    without = spark.createDataFrame([(i, int(i % 3 == 0)) for i in clean], "doc_id long, toxic int")
    model = toxicity.fit(docs, without)  # ids with both labels teach nothing
    assert docs.where("doc_id = 100").select(toxicity.score(model, docs, F.col("text"))).first()[0] == pytest.approx(next(s for i, _, s in scores[0] if i == 100), abs=1e-9)


def test_deep_pages_take_time_by_their_length():
    for page in ("<article>" + "<div>x " * 140_000, "<article>" + "<span>" * 70_000 + "<div>x</div><li>y" * 30_000, "<ul>" + "<li><div>" * 50_000 + "x"):
        began = time.time()
        cut = html.blocks(page)
        assert len(cut) == page.count("x") + page.count("y") and time.time() - began < 60
    deep = html.blocks("<article>" + "<div>x " * 3000 + "<nav>y")
    assert deep[2999].features == deep[100].features != deep[3000].features


def test_what_a_form_holds_is_no_text():
    model = html.fit()
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>It was a long day. We went home, and slept well.</p><textarea>Write here, please.</textarea><p>Then it rained all night long.</p></article></body></html>"
    assert html.main_text(model, page) == "A title It was a long day. We went home, and slept well. Then it rained all night long."
    assert "never closed" in html.main_text(model, "<article><p>It was a long day and a good one.</p><textarea><p>This field is never closed, so its text stays.</p></article>")
