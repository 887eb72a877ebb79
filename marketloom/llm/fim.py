"""Fill-in-the-middle: texts kept as seekable zstandard frames, cut at tokens and put together in another order.

Every step is a column function of the frames, so that a query of all steps is one stage without a shuffle. A text that fits
a row fits its frames, and no step holds more than one decompressed frame.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import frames
from marketloom.llm.text import small_batches

MARKS = (b"<P>", b"<S>", b"<M>")
RESULT = f"struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:{frames.TYPE}>"


#: The same types in Arrow.
FRAMES = pa.list_(pa.struct([("data", pa.binary()), ("bytes", pa.int64()), ("chars", pa.int64()), ("units", pa.int64())]))
CUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", FRAMES)])


def to_frames(text: Column, frame_bytes: int = frames.FRAME_BYTES) -> Column:
    """The text as independent compressed frames of at most so many bytes; null is an empty text, which has none."""

    @F.arrow_udf(frames.TYPE)
    def pack(texts: pa.Array) -> pa.Array:
        packer = frames.Packer(frame_bytes)
        return pa.array([packer.pack(t.as_py()) for t in texts], FRAMES)

    return pack(F.coalesce(text.cast("binary"), F.lit(b"")))


def draws(key: Column, seed: int = 42) -> Column:
    """Four numbers below 2^32 from the digest of seed and key (null: the empty key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def rearrange(text_frames: Column, numbers: Column, *, percent: int = 50, spm_percent: int = 80) -> Column:
    """struct (n tokens, form, prefix_chars, middle_chars, output frames).

    The two first numbers modulo n + 1 are the cuts; the third decides by ``percent`` whether a text is rearranged, the fourth
    by ``spm_percent`` whether suffix-prefix-middle (spm) or prefix-suffix-middle (psm). Empty texts and texts that hold a
    mark stay plain, with null lengths. Frames without a cut go into the output as they are.
    """

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, numbers_: pa.Array) -> pa.Array:
        packer, out = frames.Packer(), []
        for given, h in zip(texts.to_pylist(), numbers_.to_pylist()):
            r = frames.Reader(given)
            n = given[-1]["units"] if given else 0
            if not n or h[2] % 100 >= percent or any(r.find(m) >= 0 for m in MARKS):
                out.append({"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": given})
                continue
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            (start, before), (end, behind) = r.behind_unit(a), r.behind_unit(b)
            form = "spm" if h[3] % 100 < spm_percent else "psm"
            parts = {b"<P>": (0, start), b"<S>": (end, r.length), b"<M>": (start, end)}
            order = (b"<S>", b"<P>", b"<M>") if form == "spm" else (b"<P>", b"<S>", b"<M>")
            out.append({"n": n, "form": form, "prefix_chars": before, "middle_chars": behind - before, "output": joined(r, packer, [(m, *parts[m]) for m in order])})
        return pa.array(out, CUT)

    return cut(text_frames, numbers)


def joined(r: frames.Reader, packer: frames.Packer, parts: list[tuple[bytes, int, int]]) -> list[dict]:
    """Frames of every mark followed by the text's bytes from start to end. Whole frames are taken over; cut ones are compressed anew.

    Units of an output are not counted: its marks are no part of the text's tokens.
    """
    out, size, chars = [], 0, 0

    def add(data: bytes, n_bytes: int, n_chars: int) -> None:
        nonlocal size, chars
        size, chars = size + n_bytes, chars + n_chars
        out.append({"data": data, "bytes": size, "chars": chars, "units": None})

    for mark, start, end in parts:
        add(packer.compressor.compress(mark), len(mark), len(mark))
        if start == end:
            continue
        for i in range(r._of("bytes", start + 1), r._of("bytes", end) + 1):
            low, high = r.start(i), r.frames[i]["bytes"]
            if start <= low and high <= end:
                add(r.frames[i]["data"], high - low, r.frames[i]["chars"] - r.start(i, "chars"))
            else:
                for piece in packer.pack(r.frame(i)[max(0, start - low) : end - low]):
                    add(piece["data"], piece["bytes"], piece["chars"])
    return out


def spans(r: frames.Reader, form: str) -> list[tuple[int, int]]:
    """Where an output has the parts of its text, in the text's order; found by its marks, frame by frame."""
    if form == "plain":
        return [(0, r.length)]
    first, second = (b"<P>", b"<S>") if form == "psm" else (b"<S>", b"<P>")
    assert r.find(first) == 0
    cut = r.find(second, len(first))
    last = r.find(b"<M>", cut + len(second))
    one, two, middle = (len(first), cut), (cut + len(second), last), (last + 3, r.length)
    return [one, middle, two] if form == "psm" else [two, middle, one]


def digest(output: Column, form: Column | None = None) -> Column:
    """sha256 (lowercase hex) of the bytes of an output, streamed frame by frame; with its form, of the text that it restores to."""

    @F.arrow_udf("string")
    def sha(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        out = []
        for given, f in zip(outputs.to_pylist(), forms.to_pylist()):
            r, h = frames.Reader(given), hashlib.sha256()
            for start, end in spans(r, f):
                for part in r.read(start, end):
                    h.update(part)
            out.append(h.hexdigest())
        return pa.array(out, pa.string())

    return sha(output, F.lit("plain") if form is None else form)


def to_text(output: Column, form: Column | None = None) -> Column:
    """The text of an output; with its form, the text that it restores to."""

    @F.arrow_udf("string")
    def text(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        out = []
        for given, f in zip(outputs.to_pylist(), forms.to_pylist()):
            r = frames.Reader(given)
            out.append(b"".join(part for start, end in spans(r, f) for part in r.read(start, end)).decode())
        return pa.array(out, pa.string())

    return text(output, F.lit("plain") if form is None else form)


def fill_in_middle(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", seed: int = 42, percent: int = 50, spm_percent: int = 80, frame_bytes: int = frames.FRAME_BYTES) -> DataFrame:
    """The documents with one more column: struct (n, form, prefix_chars, middle_chars, output frames).

    One row for each row, repeated rows and ids included; a row's result depends on its id and text only. A null text is
    empty and plain with n = 0; a null id draws from the empty key; of a very long text, one frame at a time is decompressed.
    ``out_col`` replaces a column of that name; all others stay.
    """
    small_batches(documents.sparkSession)
    return documents.withColumn(out_col, rearrange(to_frames(F.col(f"`{text_col}`"), frame_bytes), draws(F.col(f"`{id_col}`"), seed), percent=percent, spm_percent=spm_percent))
