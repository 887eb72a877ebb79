"""Secret scan: fixed patterns, and a linear-chain CRF that tags tokens as secret begin, inside or outside.

Features are a token's shape, the kinds of the tokens around it and features of the whole file. Tokens that are
certainly outside split a text into short stretches, so that the Viterbi path of the whole text is found without
stepping through every word.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.crf import Crf, train
from marketloom.llm.text import small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
TOKEN = re.compile(r"\s+|[\w+/.-]+|[^\w\s+/.-]+")
NAMES = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_-]?key|private[_-]?key|credential|bearer|auth", re.I)
PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abprs]-|eyJ|AIza|glpat-|ya29\.|npm_|hf_")
O, B, I = 0, 1, 2
#: kinds of token that can stand in a run that is certainly outside
PLAIN = ("word", "mixed")
PAD = 8


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the fixed patterns: leftmost matches that do not overlap, per kind; failing ones are dropped."""
    low = text.lower()
    out = []
    if any(name in low for name in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _kind(token: str) -> str:
    """Coarse kind of a token, as its neighbours see it."""
    if NAMES.search(token):
        return "name"
    if token[0] in "=:\"'>" and set(token) <= set("=:\"'>`([{ "):
        return "sep"
    if token.isdigit():
        return "number"
    return "word" if token.isalpha() else "mixed"


def _shape(token: str) -> tuple[str, ...]:
    n = len(token)
    upper, lower = any("A" <= c <= "Z" for c in token), any("a" <= c <= "z" for c in token)
    digits = sum(c.isdigit() for c in token)
    found = ["all", f"kind:{_kind(token)}", f"len:{min(8, n // 4)}", f"sets:{upper + lower + (digits > 0)}", f"digits:{min(4, 5 * digits // n)}"]
    if n >= 8:
        found.append(f"varied:{min(5, len(set(token)) // 4)}")
        if digits and re.fullmatch("[0-9a-f]+", token):
            found.append("hex")
        if n >= 16 and digits and lower and upper:
            found.append("dense")
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        found.append(f"turns:{min(4, turns // 2)}")
    if PREFIX.match(token) and n >= 12:
        found.append("prefix")
    if token.isalpha() and not token.isascii():
        found.append("accents")
    if "." in token or "/" in token:
        found.append("path")
    return tuple(found)


class _Classes(dict):
    """token -> number of its class; tokens with the same features share one. Arrays of the classes' emissions grow with it."""

    def __init__(self, model: Crf, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.numbers: dict[tuple, int] = {}
        self.tables = np.zeros((4, 4096, 3))

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        key = (_shape(token), _kind(token))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.numbers)
            if number == self.tables.shape[1]:
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
            e = self.model.emission
            self.tables[:, number] = [e(key[0]), e((f"before:{key[1]}",)), e((f"before2:{key[1]}",)), e((f"after:{key[1]}",))]
        self[token] = number
        return number


def _file(text: str) -> tuple[str, ...]:
    """Features that a whole file's tokens share: how many credential names it has, and whether it is dense with assignments."""
    names = sum(1 for _ in NAMES.finditer(text)) if any(n in text.lower() for n in ("pass", "secret", "token", "key", "credential", "bearer", "auth")) else 0
    return (f"file:names{min(2, names)}", f"file:seps{int((text.count('=') + text.count(':')) * 50 > len(text) // 6)}")


def _chain(tokens: list[str], file: tuple[str, ...]) -> list[tuple[str, ...]]:
    """All features of each token, as used in training; _Classes gives the same sums."""
    kinds = [_kind(t) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        f = _shape(t) + file
        if i:
            f += (f"before:{kinds[i - 1]}",)
        if i > 1:
            f += (f"before2:{kinds[i - 2]}",)
        if i + 1 < len(tokens):
            f += (f"after:{kinds[i + 1]}",)
        out.append(f)
    return out


def _tokens(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens without white space, and their starts."""
    pieces = TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    keep = [i for i, p in enumerate(pieces) if not p.isspace()]
    tokens = [pieces[i] for i in keep]
    return tokens, ends[keep] - np.fromiter(map(len, tokens), np.int64, len(tokens)) if keep else np.zeros(0, np.int64)


def emissions(classes: _Classes, tokens: list[str], file: tuple[str, ...]) -> np.ndarray:
    ids = np.fromiter(map(classes.__getitem__, tokens), np.int64, len(tokens))
    own, before, before2, after = classes.tables
    e = own[ids] + classes.model.emission(file)
    e[1:] += before[ids[:-1]]
    e[2:] += before2[ids[:-2]]
    e[:-1] += after[ids[1:]]
    return e


class Scanner:
    """Finds the CRF's spans of whole texts.

    A path that is not O along PAD + 1 plain tokens in a row loses at least PAD times the least margin of a plain token;
    a plain token's margin (between plain tokens, whichever they and the file are) is over any move's gain plus a PAD-th
    of the most that changing the path there can cost. So the best path is O inside every longer run of plain tokens,
    and only windows around the other tokens are decoded.
    """

    def __init__(self, model: Crf):
        self.classes = _Classes(model)
        allowed = model.moves[model.moves > -1e3]
        groups = [[model.emission((f"{slot}:{k}",)) for k in PLAIN] + [np.zeros(3)] for slot in ("before", "before2", "after")]
        groups += [[model.emission((f"file:names{k}",)) for k in range(3)], [model.emission((f"file:seps{k}",)) for k in range(2)]]
        self.worst = sum(np.min([g[O] - g[1:] for g in group], axis=0) for group in groups)
        spread = sum(max(float(g[I] - g[B]) for g in group) for group in groups) + sum(max(0.0, float(w[I] - w[B])) for w in model.weights)
        gain = max(0.0, float(allowed.max() - model.moves[O, O]))
        self.least = gain + (2 * float(allowed.max() - allowed.min()) + max(0.0, spread)) / PAD
        self.known: dict[str, bool] = {}
        # the longest words that are plain in any spelling, alone or before a mark
        longest = 0
        if all(self.plain(("all", f"kind:{k}", f"len:{n}", "sets:0", "digits:0")) for k in PLAIN for n in (0, 1)):
            while longest < 7 and all(
                self.plain(("all", f"kind:{k}", f"len:{longest}", f"sets:{sets}", "digits:0") + extra + more)
                for k in PLAIN for sets in range(3) for more in ((), ("accents",), ("path",), ("accents", "path"))
                for extra in ([()] if longest < 2 else [(f"varied:{v}", "turns:0") + pre for v in range(6) for pre in ((), ("prefix",))])
            ):
                longest += 1
        word = rf"[^\W\d_]{{1,{4 * longest - 1}}}+" if longest else r"(?!)"
        self.other = re.compile(rf"\s*+(?:{word}\.?[%#$&*,;!?]{{0,7}}+(?:\s++|\Z))*+(\S*+)")

    def plain(self, features: tuple[str, ...]) -> bool:
        e = self.classes.model.emission(features)
        return bool((e[O] - e[1:] + self.worst).min() > self.least)

    def opens(self, piece: str) -> bool:
        """Whether the best path may leave O near this piece."""
        value = self.known.get(piece)
        if value is None:
            if len(self.known) > 200_000:
                self.known.clear()
            value = self.known[piece] = any(_kind(t) not in PLAIN or not self.plain(_shape(t)) for t in TOKEN.findall(piece) if not t.isspace())
        return value

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every run B I I ... on the best path of the whole text."""
        marks = [m.span(1) for m in self.other.finditer(text) if m[1] and self.opens(m[1])]
        low = text.lower()
        if any(n in low for n in ("pass", "secret", "token", "key", "credential", "bearer", "auth")):
            marks = sorted(marks + [m.span() for m in NAMES.finditer(text)])
        windows: list[list[int]] = []
        for s, t in marks:
            b = _on(text, t)
            # a window reaches behind each of its marks as far as the proof needs
            a = windows[-1][0] if windows and s <= windows[-1][1] else _back(text, s)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        file, model, out = _file(text) if windows else (), self.classes.model, []
        for a, b in windows:
            tokens, starts = _tokens(text[a:b])
            e = emissions(self.classes, tokens, file)
            if b < len(text):
                e[-1] += model.moves[:, O]
            labels, i = model.decode(e, model.moves[O] if a else None), 0
            while i < len(labels):
                j = i + 1
                if labels[i] != O:
                    while j < len(labels) and labels[j] == I:
                        j += 1
                    out.append((a + int(starts[i]), a + int(starts[j - 1]) + len(tokens[j - 1])))
                i = j
        return out


def _back(text: str, at: int, pieces: int = PAD + 4) -> int:
    """Start of the piece that lies so many pieces before a place, 0 at the text's start."""
    reach = 256
    while reach < at:
        found = [m.start() for m in re.finditer(r"(?<=\s)\S+", text[at - reach : at])]
        if len(found) > pieces:
            return at - reach + found[-pieces - 1]
        reach *= 4
    found = [m.start() for m in re.finditer(r"\S+", text[:at])]
    return found[-pieces - 1] if len(found) > pieces else 0


def _on(text: str, at: int, pieces: int = PAD + 4) -> int:
    """End of the piece that lies so many pieces after a place, or the text's end."""
    for n, m in enumerate(re.finditer(r"\S+", text[at:] if len(text) - at < 4096 else text[at : at + 4096])):
        if n > pieces and at + m.end() < len(text) and m.end() < 4096:
            return at + m.end()
    return len(text) if len(text) - at <= 4096 else re.compile(rf"(?:\s*\S+){{0,{pieces + 2}}}").match(text, at).end()


def scan(scanner: Scanner, text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind: the fixed patterns' and the CRF's, which may overlap."""
    found = [("crf", s, t) for s, t in scanner.spans(text)]
    return sorted([x[:3] for x in base_spans(text)] + found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _planted(r: random.Random) -> tuple[str, str, str]:
    """(text before, secret or nothing, text after) as found in files."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = lower + lower.upper() + digits

    def s(chars, a, b):
        return "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    q = r.choice(('"', "'", ""))
    value = r.choice((s(every, 12, 44), s("0123456789abcdef", 24, 64), s(every + "+/", 20, 60), "AKIA" + s(lower.upper() + digits, 16, 16), "ghp_" + s(every, 36, 36), "sk_live_" + s(every, 24, 24), "xoxb-" + s(digits, 10, 12) + "-" + s(every, 20, 24), "eyJ" + s(every, 20, 30) + "." + s(every, 30, 40) + "." + s(every, 20, 43), s(lower, 2, 6) + s(digits, 2, 5) + s(every, 2, 8), "AIza" + s(every, 35, 35)))
    name = r.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Secret", "private_key", "auth_token", "client_secret", "access_key"))
    x = r.random()
    if x < 0.45:
        return f"{name}{r.choice((' = ', '=', ': ', ':', ' := '))}{q}", value, q
    if x < 0.55:
        return "", r.choice((s("0123456789abcdef", 32, 64), "AKIA" + s(lower.upper() + digits, 16, 16), "ghp_" + s(every, 36, 36), "sk_live_" + s(every, 24, 30), "eyJ" + s(every, 30, 60))), ""
    if x < 0.6:
        return "Authorization: Bearer ", s(every, 30, 60), ""
    plain = (
        f"{s(lower, 3, 9)}.{s(digits, 2, 3)}@mail{s(digits, 1, 1)}.example.com", f"+{s(digits, 1, 2)} ({s(digits, 3, 3)}) {s(digits, 3, 3)}-{s(digits, 4, 4)}", f"{s(digits, 1, 3)}.{s(digits, 1, 3)}.{s(digits, 1, 3)}.{s(digits, 1, 3)}", s(digits, 13, 19), f"{s(digits, 4, 4)}-{s(digits, 2, 2)}-{s(digits, 2, 2)}T{s(digits, 2, 2)}:{s(digits, 2, 2)}",
        f"https://www.{s(lower, 4, 12)}.org/{s(lower, 3, 9)}/{s(digits, 1, 5)}.html", f"{s(lower, 3, 8)}-{s(lower, 3, 8)}-{s(digits, 1, 4)}", f"{s(lower, 2, 8)} = {s(digits, 1, 6)}", f"{s(lower, 2, 8)}: {s(lower, 2, 12)}", s(lower, 14, 34), s(lower.upper(), 5, 16), f"version {s(digits, 1, 2)}.{s(digits, 1, 2)}.{s(digits, 1, 3)}", f"the {r.choice(('password', 'token', 'secret'))} {s(lower, 2, 9)}", f"{s(lower, 4, 9)}{s(digits, 1, 4)}", f"${s(digits, 1, 5)}.{s(digits, 2, 2)}", f"{s(lower, 3, 7)}_{s(lower, 3, 9)}_{s(lower, 3, 9)}({s(lower, 1, 5)})", f"ISBN {s(digits, 3, 3)}-{s(digits, 10, 10)}", f"{s(lower, 4, 9)}{r.choice(('###', '%%%', '$$$', '&&&', '***'))}",
    )
    return r.choice(plain), "", ""


def windows(text: str, seed: str, per_text: int = 3, width: int = 24, max_word: int = 200) -> list[tuple[str, str]]:
    """(left, right) of so many places between a text's words, ``width`` words together; only the first ``max_word`` characters of a word."""
    r = random.Random(seed)
    ws = [w[:max_word] for w in re.findall(r"\S+\s*", text)] or [""]
    spots = [r.randrange(len(ws)) for _ in range(per_text)]
    return [("".join(ws[max(0, s - width // 2) : s]), "".join(ws[s : s + width // 2])) for s in spots]


def labelled_chains(places: list[tuple[str, str]], seed: int = 5) -> tuple[list, list]:
    """Windows with something planted in most of them; labelled by what was planted and by the fixed patterns."""
    r = random.Random(seed)
    chains, labels = [], []
    for left, right in places:
        before, secret, after = _planted(r)
        if left and not left[-1].isspace():
            left += " "
        window = left + before + secret + after + r.choice((" ", "\n", ". ", "### ")) + right
        spans = [(a, b) for _, _, b, a in base_spans(window)] + ([(len(left + before), len(left + before + secret))] if secret else [])
        tokens, starts = _tokens(window)
        y = []
        for t, s in zip(tokens, starts):
            inside = [a for a, b in spans if s < b and s + len(t) > a and _kind(t) != "sep"]
            y.append(O if not inside else I if y and y[-1] != O and min(inside) < s else B)
        chains.append(_chain(tokens, _file(window)))
        labels.append(y)
    return chains, labels


def fit(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 300) -> Crf:
    """Train on windows of at most ``max_docs`` documents: those with the lowest hashed id; of rows that repeat an id the one
    with the smallest md5 of its text. Without documents, the windows hold only what is planted.

    Only ids are sorted, and only windows (three of 24 words from each document) reach the driver.
    """
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    picked = rows.select("id").distinct().orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, hashlib.md5(t.encode()).hexdigest(), [dict(zip("lr", w)) for w in windows(t, i)]) for i, t in zip(pdf["id"], pdf["text"])], columns=["id", "key", "w"])

    small_batches(documents.sparkSession)
    found = rows.join(F.broadcast(picked), "id").mapInPandas(cut, "id string, key string, w array<struct<l: string, r: string>>")
    one = found.groupBy("id").agg(F.min_by("w", "key").alias("w"))
    places = [(w["l"], w["r"]) for row in sorted(one.collect()) for w in row["w"]]
    chains, labels = labelled_chains(places + [("", "")] * max(0, 450 - len(places)))
    return train(chains, labels, 3, rounds=60, ridge=1e-3, forbidden=((O, I),), not_first=(I,))


def find_secrets(documents: DataFrame, *, text_col: str = "text", model: Crf, out_col: str = "secrets") -> DataFrame:
    """Add ``out_col``: array of (kind, start, end) of every secret in the whole text, in code points, end exclusive.

    A null text counts as empty and has no secrets. Rows are independent; an existing column ``out_col`` is replaced.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<kind: string, start: long, end: long>>"

    @F.pandas_udf(kind)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(scanner, t)] for t in texts])

    return documents.withColumn(out_col, spans(F.coalesce(F.col(text_col), F.lit(""))))


def redact(documents: DataFrame, *, text_col: str = "text", secrets_col: str = "secrets") -> DataFrame:
    """Replace every found span of the text by ``<secret>``; overlapping spans become one. A null text stays null."""
    keep = F.aggregate(
        F.array_sort(F.transform(secrets_col, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["b"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["a"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int")), F.lit("<secret>"))).alias("out"),
                s["b"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return documents.withColumn(text_col, F.when(F.size(secrets_col) > 0, keep).otherwise(F.col(text_col)))
