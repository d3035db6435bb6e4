"""Word tables over whole Arrow batches: boundaries and 64-bit hashes with numpy.

Words are ``[^\\x20\\x09-\\x0D]+``. All documents of a slice are hashed in one
vectorised pass: a prefix polynomial modulo 2**64 gives the hash of any byte
range, and a second one over word hashes gives the hash of any run of words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_DELIM = np.zeros(256, bool)
_DELIM[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but letters, for the text kernels that look at letters only; bytes above ASCII count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def trim() -> None:
    """Give freed memory back to the system, so that a worker that lives on holds none of its last task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _BASES[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[kind] = (both[0], both[1])
    return have


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A hash of the values in each range."""
    up, down = _powers(kind, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


class Words:
    """The words of a slice of documents.

    ``start``/``end``: byte places in ``data``; ``first``: per document the
    place of its first word, with one more entry at the end; ``hash``: one
    64-bit value per word.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, delim: np.ndarray = _DELIM):
        self.data = b" ".join(t or b"" for t in texts)
        buf = np.frombuffer(self.data, np.uint8)
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        offs = np.concatenate([[0], np.cumsum(lens + 1)])
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~delim[buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, offs)
        self._values = (_LOWER if lower else _PLAIN)[buf]
        self.hash = ranges(self._values, self.start, self.end, "byte")

    def doc(self) -> np.ndarray:
        """Per word its document's place in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of more than ``n`` bytes, and the hashes of their first ``n``."""
        at = np.flatnonzero(self.end - self.start > n)
        return at, ranges(self._values, self.start[at], self.start[at] + n, "byte")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words within one document."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc()
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return at, ranges(self.hash, at, at + k, "word")

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the given runs of words."""
        return ranges(self.hash, starts, ends, "word")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut a batch so that each part holds about SLICE_BYTES of text at most, or one row."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    size = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int64)
    at = 0
    while at < len(col):
        to, held = at, 0
        while to < len(col) and (to == at or held + size[to] <= SLICE_BYTES):
            held += size[to]
            to += 1
        yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
        at = to
    del col
    trim()
