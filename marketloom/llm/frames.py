"""Texts as lists of independent zstandard frames with cumulative unit counts, so that any part can be read by itself.

A unit is a token ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a run of other characters with the white space
before it, or white space at the end of the text. A frame ends at any character; ``units`` of a frame counts the tokens that
end in it or before it, ``chars`` and ``bytes`` likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

#: Spark's type of one text: its frames in order, each with the totals up to its end.
TYPE = "array<struct<data:binary,bytes:long,chars:long,units:long>>"
FRAME_BYTES = 1 << 16


def unit_ends(b: np.ndarray, after: int) -> np.ndarray:
    """Places behind the last byte of every token that ends within these bytes; ``after``: the byte that follows, -1 at the text's end."""
    if not len(b):
        return np.zeros(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    follows = np.append(space[1:], after == 32 or 9 <= after <= 13)
    ends = ~space & follows
    ends[-1] |= after < 0
    return np.flatnonzero(ends) + 1


class Packer:
    """Writes texts as frames; one for each task."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.size, self.compressor = max(4, frame_bytes), zstandard.ZstdCompressor(level=3)

    def pack(self, data: bytes) -> list[dict]:
        b, out, at, chars, units = np.frombuffer(data, np.uint8), [], 0, 0, 0
        while at < len(data):
            end = min(len(data), at + self.size)
            while end < len(data) and 0x80 <= data[end] < 0xC0:  # not within a character
                end -= 1
            part = b[at:end]
            chars += int(np.count_nonzero((part & 0xC0) != 0x80))
            units += len(unit_ends(part, data[end] if end < len(data) else -1))
            out.append({"data": self.compressor.compress(data[at:end]), "bytes": end, "chars": chars, "units": units})
            at = end
        return out


class Reader:
    """Random access to a text in frames. Holds one decompressed frame at a time."""

    def __init__(self, frames: list[dict]):
        self.frames, self.at, self.text = frames, -1, b""
        self.length = frames[-1]["bytes"] if frames else 0

    def frame(self, i: int) -> bytes:
        if self.at != i:
            self.text, self.at = zstandard.ZstdDecompressor().decompress(self.frames[i]["data"]), i
        return self.text

    def start(self, i: int, what: str = "bytes") -> int:
        return self.frames[i - 1][what] if i else 0

    def _of(self, what: str, n: int) -> int:
        """The first frame up to whose end there are n units, characters or bytes."""
        low, high = 0, len(self.frames) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.frames[mid][what] >= n else (mid + 1, high)
        return low

    def behind_unit(self, n: int) -> tuple[int, int]:
        """(bytes, characters) before the end of the n-th token; only the frame in which it ends is decompressed."""
        if n == 0:
            return 0, 0
        i = self._of("units", n)
        text = self.frame(i)
        ends = unit_ends(np.frombuffer(text, np.uint8), 32)[n - self.start(i, "units") - 1 :]
        end = int(ends[0]) if len(ends) else len(text)  # white space that ends the text
        return self.start(i) + end, self.start(i, "chars") + int(np.count_nonzero((np.frombuffer(text[:end], np.uint8) & 0xC0) != 0x80))

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        if start < end:
            for i in range(self._of("bytes", start + 1), self._of("bytes", end) + 1):
                yield self.frame(i)[max(0, start - self.start(i)) : end - self.start(i)]

    def find(self, mark: bytes, start: int = 0) -> int:
        """The first place of the mark, also across frames; -1 if there is none."""
        tail, at = b"", start
        for part in self.read(start, self.length):
            hit = (tail + part).find(mark)
            if hit >= 0:
                return at - len(tail) + hit
            at += len(part)
            tail = (tail + part)[-(len(mark) - 1) :]
        return -1
