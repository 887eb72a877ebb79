"""Fill-in-middle, SimHash near-duplicates and the Merkle manifest against plain versions, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import fim, frames, merkle, queries, simhash
from marketloom.llm.stored import Tables
from test_llm import sentence

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(r):
    """Texts of every odd kind: null, empty, white space, marks, wide characters, very long ones, copies."""
    out = [None, "", " ", "\n\t ", "a", " a", "a ", "a b c d", "<P> in the text", "x <M>", "é" * 40, "日本 語\n" * 50, "😀 " * 30, "w" * 5000, " " * 5000, "one two three " * 9000, "ÄÖ A\x0bB\x1cC"]
    out += [sentence(r, r.randint(1, 60)) + r.choice(["", " ", "\n", " \n"]) for _ in range(120)]
    return out + out[:30]


def plain_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if d[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [5, 64, 1 << 16])
def test_fill_in_middle(spark, frame_bytes):
    texts = odd_texts(random.Random(3))
    rows = [(None if i == 7 else i, t, i) for i, t in enumerate(texts)] + [(11, texts[11], 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output long").repartition(3)
    out = fim.fill_in_middle(df, frame_bytes=frame_bytes)
    assert out.columns == ["doc_id", "text", "output", "fim"]
    x = F.col("fim")
    got = out.select("doc_id", "text", "output", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", fim.to_text(x["output"]).alias("o"), fim.to_text(x["output"], x["form"]).alias("back"), fim.digest(x["output"]).alias("sha"), fim.digest(x["output"], x["form"]).alias("again")).collect()
    assert len(got) == len(rows) and {x["form"] for x in got} == {"plain", "spm", "psm"}
    for g in got:
        want = plain_fim(g["doc_id"], g["text"])
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["o"]) == want
        assert g["back"] == (g["text"] or "") and g["sha"] == sha(want[4]) and g["again"] == sha(g["text"] or "")


def test_frames_read_any_part():
    r = random.Random(5)
    for size in (4, 7, 64):
        text = "".join(r.choice(["a", " ", "é", "日", "\n", "😀", "bc"]) for _ in range(200))
        data, units = text.encode(), UNIT.findall(text)
        reader = frames.Reader(frames.Packer(size).pack(data))
        assert reader.frames[-1]["units"] == len(units) and reader.frames[-1]["chars"] == len(text) and reader.length == len(data)
        for n in range(len(units) + 1):
            head = "".join(units[:n])
            assert reader.behind_unit(n) == (len(head.encode()), len(head))
        for _ in range(100):
            a, b = sorted(r.randrange(len(data) + 1) for _ in "ab")
            assert b"".join(reader.read(a, b)) == data[a:b] and reader.find(data[a : a + 5]) == data.find(data[a : a + 5])
        assert reader.find(b"<P>") == -1
    assert frames.Packer().pack(b"") == []


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_in_parts():
    for text in odd_texts(random.Random(4)):
        data = (text or "").encode()
        assert simhash.fingerprint(data) == plain_fingerprint(text)
        if len(data) < 2000:  # parts that end within every word
            whole = [h for part in simhash.shingle_hashes(data, 3, 42) for h in part.tolist()]
            assert all([h for part in simhash.shingle_hashes(data, 3, 42, chunk) for h in part.tolist()] == whole for chunk in (1, 3, 17))


def plain_components(rows):
    """rows: (id, fingerprint) -> smallest id reachable, row by row."""
    values = sorted({f for _, f in rows})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [low.get(find(f)) for _, f in rows]


@pytest.mark.parametrize("small", [0, 3, 32])
def test_links_join_what_all_pairs_join(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(9)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:  # chains and crowds around a value, one to four bits away
        for _ in range(12):
            x = v
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            values.add(x)
    values |= {0, 1, 3, 7, 1 << 63, 2**64 - 1}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = simhash.links(Tables(spark, "t"), spark.createDataFrame(signed, "fp long")).collect()
    assert all(((x["a"] ^ x["b"]) & (2**64 - 1)).bit_count() <= 2 or small < 32 for x in got)
    root = {v: v for (v,) in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for x in got:
        root[find(x["a"])] = find(x["b"])
    want = plain_components([(v, v & (2**64 - 1)) for (v,) in signed])
    classes = {}
    for (v,), c in zip(signed, want):
        classes.setdefault(c, set()).add(find(v))
    assert all(len(s) == 1 for s in classes.values()) and len({next(iter(s)) for s in classes.values()}) == len(classes)


def test_pigeonring_keeps_every_close_pair(spark):
    r = random.Random(2)
    pairs = [(v, v ^ sum(1 << b for b in bits)) for bits in [(b,) for b in range(64)] + list(itertools.combinations(range(64), 2)) for v in [r.getrandbits(64)]]
    wrap = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(wrap(a), wrap(b)) for a, b in pairs], "a long, b long")
    both = df.select("a", "b", F.arrays_zip(simhash.keys(F.col("a")).alias("x"), simhash.keys(F.col("b")).alias("y")).alias("z"))
    kept = both.select("a", "b", F.explode("z").alias("z")).where("z.x = z.y").where(simhash.chain(F.col("a").bitwiseXOR(F.col("b")), F.col("z.x.kind"))).select("a", "b").distinct()
    assert kept.count() == len(pairs)


def test_near_duplicates(spark):
    r = random.Random(6)
    base = [sentence(r, 300) for _ in range(12)]
    texts = odd_texts(r) + base
    for t in base:  # near copies: a word changed here and there
        for n in range(1, 9):
            w = t.split()
            w[r.randrange(len(w))] = f"changed{n}"
            texts.append(" ".join(w))
    rows = [(None if i == 20 else i, t, "x") for i, t in enumerate(texts)]
    rows += [(3, texts[40], "x"), (None, "alone without an id", "x"), (900, base[0], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([(-1 if i is None else i) for i, _, _ in rows], (f"{p:016x}" for p in prints), [-1 if c is None else c for c in plain_components([(i, p) for (i, _, _), p in zip(rows, prints)])]))
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["fingerprint"], -1 if x["component_id"] is None else x["component_id"]) for x in got) == want
    assert len({c for _, _, c in want}) < len(want) - 60


def H(*parts):
    return sha("".join(parts))


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests, fan):
    """(root, for every leaf its [(left, right)])"""
    level, paths, at = digests, [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for k, p in enumerate(at):
            a = p - p % fan
            paths[k].append(("".join(level[a:p]), "".join(level[p + 1 : a + fan])))
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [p // fan for p in at]
    return level[0], paths


def plain_manifest(rows, tamper, fan=3):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, plain_leaf(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        done[s] = plain_tree([d for _, d in groups[s]], fan)
    root, above = plain_tree([done[s][0] for s in names], fan)
    out = []
    for k, s in enumerate(names):
        for (row, d), path in zip(groups[s], done[s][1]):
            path = path + above[k]
            found = plain_leaf(tamper(row))
            for left, right in path:
                found = H(left, found, right)
            out.append((row[0], d, done[s][0], root, H(*(a + b for a, b in path)), found, found == root))
    return sorted(out, key=str)


def tamper(row):
    odd = row[0] is None or zlib.crc32(str(row[0]).encode()) % 2
    return row if odd or row[4] is None else (*row[:4], row[4].replace("\n", ""))


@pytest.mark.parametrize("digits", [2, 6])
def test_manifest(spark, digits):
    r = random.Random(12)
    rows = []
    for s, n in (("web", 95), ("Wiki", 28), (None, 9), ("é", 27), ("solo", 1), ("", 3), ("two", 2), ("ten", 10)):
        for _ in range(n):
            i = len(rows) * 7 % 1000
            rows.append((i, s, r.choice(["en", None]), r.choice([5, None]), r.choice([None, "", "a\nb", "plain", "x" * 50_000 + "\n"])))
    rows += [rows[3], rows[3], (None, "web", None, None, "no id\n"), (rows[0][0], "web", "de", 1, "same id\n")]
    df = spark.createDataFrame([(i, t, l, s, n, "clash") for i, s, l, n, t in rows], f"{DOCS}, pos string").repartition(5)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle.manifest(df, tampered=changed, digits=digits).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_manifest(rows, tamper)
    assert {x["verified"] for x in got} == {True, False}


def test_manifest_of_one_row_and_one_group(spark):
    for n in (1, 2, 4):
        rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
        df = spark.createDataFrame([(i, t, l, s, c) for i, s, l, c, t in rows], DOCS)
        got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert sorted((tuple(x) for x in got), key=str) == plain_manifest(rows, lambda row: row)


def test_registered_queries(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, t, "en", r.choice(["a", "b", None]), 1) for i, t in enumerate(odd_texts(r))]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()}
    assert all(tuple(got[i])[1:5] == plain_fim(i, t)[:4] and got[i]["output_sha256"] == sha(plain_fim(i, t)[4]) and got[i]["restored_sha256"] == sha(t or "") for i, t, *_ in rows)
    marked = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    got = sorted(tuple(x) for x in queries.op12_simhash(spark, str(tmp_path)).collect())
    assert got == sorted((i, f"{p:016x}", c) for (i, p), c in zip(marked, plain_components(marked)))
    got = sorted((tuple(x) for x in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_manifest([(i, s, l, n, t) for i, t, l, s, n in rows], tamper)
