"""Substring dedup by prefix-partitioned suffix trees.

A suffix is followed for WINDOW words, so a repeat of that length is an inner
node at that depth of the tree of all suffixes. The tree is never built as a
whole: suffixes are split by prefixes of variable length into groups that fit
into memory, and each group's subtree is built from its words alone.

1. A suffix's first prefix is the least hashed run of GRAM words in its window.
   That depends on the window alone, so equal windows share a prefix, and
   neighbouring ones mostly do too: they are one entry. Prefixes are counted; one
   with a single entry is a leaf and ends there.
2. The other entries are taken from their documents, with the words that they
   cover together. Every slice of documents first folds its own equal windows
   into the earliest, so a passage that a third of all documents share is sent
   once for each slice. Entries go to bins of prefixes; a bin's suffixes are
   sorted by their words, and where neighbours agree over WINDOW words, they are
   leaves below one deep inner node, a maximal repeat: all but the earliest are
   marked.
3. A bin that passes CHUNK_WORDS is sorted a chunk at a time, and what no chunk
   could decide goes to another round with longer prefixes: the words that all
   of 7, then 4 neighbouring windows share, and at last whole windows. There the
   leaves of a group are equal, and every round leaves one for each chunk. A
   prefix that holds a large share of all entries is dealt to several bins at
   once and takes the same way.

Hashes choose groups and find candidates; words decide what is equal.

Results: a null text has no words; texts shorter than a window lose nothing; a
text that loses no word stays as it is, and others keep all that stands outside
of the words that they lose, up to the next word. ``doc_id`` names a document:
rows that repeat one are versions of it, which never make repeats of each other
at the same place, and a place is removed in all versions if it is in one. Rows
without an id come after all others, equal texts as versions of one document.
Extra columns stay; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import cut, partitions
from sitewright.llm.textkernel import Words, mix, ranges, slices, trim

WINDOW = 20
GRAM = 8
#: For each level the number of neighbouring windows whose common words are the prefix.
LEVELS = (WINDOW - GRAM + 1, 7, 4, 1)
#: Bytes of text to a bin, as expected; entries overlap and hold 3 to 4 times as many words.
BIN_BYTES = 2_000_000
#: Words of entries that are sorted at once, and that a worker gathers before it deals them out.
CHUNK_WORDS = 3_000_000
HELD_WORDS = 8_000_000
#: Bytes of text to a bin of the count, and entries that a worker gathers before it sends their keys.
COUNT_BYTES = 64_000_000
HELD_ENTRIES = 1_500_000
#: The least entries of a prefix that is dealt to several bins, and bytes of text to an entry, as expected.
HOT_ENTRIES = 4_096
ENTRY_BYTES = 50
#: Bins of this number and above hold parts of hot prefixes.
_HOT_BIN = 1 << 40
#: Names of rows without an id begin here.
_NAMELESS = 1 << 62
_ZSTD = pa.Codec("zstd", compression_level=3)


class Entries(NamedTuple):
    """Runs of neighbouring windows with one prefix.

    ``many`` windows from word ``start`` of ``doc``, the first one ``off`` words
    before the prefix's anchor; ``words``: places in ``vocab`` of the words that
    they cover, one entry after the other.
    """

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    off: np.ndarray
    many: np.ndarray
    words: np.ndarray
    vocab: list[bytes]

    def first(self) -> np.ndarray:
        """Where each entry's words begin, with one more place at the end."""
        return np.concatenate([[0], np.cumsum(self.many.astype(np.int64) + (WINDOW - 1))])

    def take(self, at: np.ndarray) -> Entries:
        first = self.first()
        return Entries(*(x[at] for x in self[:5]), self.words[_flat(first[at], first[at + 1])], self.vocab)


_KINDS = ("<u8", "<i8", "<u4", "u1", "u1")


def _flat(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    n = ends - starts
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n)


def _joined(parts: list[Entries]) -> Entries:
    """Entries over one vocabulary, in which equal words have one place."""
    known: dict[bytes, int] = {}
    words = []
    for p in parts:
        used, place = np.unique(p.words, return_inverse=True)
        words.append(np.array([known.setdefault(p.vocab[i], len(known)) for i in used.tolist()], np.int32)[place])
    cols = [np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(k) for i, k in enumerate(_KINDS)]
    return Entries(*cols, np.concatenate([*words, np.zeros(0, np.int32)]), list(known))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the least of ``width`` values from there, the leftmost of equal ones."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        right = at[np.minimum(np.arange(len(at)) + step, len(at) - 1)]
        at = np.where(values[right] < values[at], right, at)
        done += step
    return at


def _windows(words: Words) -> np.ndarray:
    """First words of all windows."""
    doc = words.doc()
    return np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)


def _anchors(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window's first word the place of its anchor, and a hash of the anchor's words."""
    gram = np.full(len(words.hash), ~np.uint64(0))
    places, h = words.grams(GRAM)
    gram[places] = h
    anchor = _least(gram, WINDOW - GRAM + 1)[at]
    return anchor, mix(gram[anchor])  # the least ones are small numbers, which would share few bins


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new run begins: any key differs from the one before."""
    head = np.ones(len(keys[0]), bool)
    for k in keys:
        head[1:] &= k[1:] == k[:-1]
    head[1:] = ~head[1:]
    return head


def _spans(doc: np.ndarray, start: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Marked windows, sorted by document and start, as pairs of unsigned 32-bit words: names of documents and their pairs."""
    if not len(doc):
        return [], []
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc)) - 1
    pairs = np.stack([start[first], start[last] + WINDOW], 1).astype("<u4")
    names, at = np.unique(doc[first], return_index=True)
    at = np.append(at, len(pairs)) * 8
    data, at = pairs.tobytes(), at.tolist()
    return names.tolist(), [data[a:b] for a, b in zip(at, at[1:])]


def _numbered(words: Words) -> tuple[np.ndarray, list[bytes]]:
    """A place for each word, and the word at each place; equal places are equal words."""
    _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
    size, lead = words.end - words.start, first[place]
    good = bool((size == size[lead]).all())
    buf = np.frombuffer(words.data, np.uint8)
    for at in range(0, len(size) if good else 0, 100_000):
        a, b, n = words.start[at : at + 100_000], words.start[lead[at : at + 100_000]], size[at : at + 100_000]
        good = good and bool((buf[_flat(a, a + n)] == buf[_flat(b, b + n)]).all())
    if good:
        return place.astype(np.int32), [words.data[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
    known: dict[bytes, int] = {}  # two words with one hash
    places = [known.setdefault(words.data[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist())]
    return np.array(places, np.int32), list(known)


def _prefixes(doc: np.ndarray, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry its key, its document and its anchor's place there."""
    words = Words(texts)
    at = _windows(words)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchor, key = _anchors(words, at)
    first = np.flatnonzero(_heads(anchor))
    of = words.doc()[anchor[first]]
    return key[first], doc[of], anchor[first] - words.first[of]


def _fold(doc: np.ndarray, texts: list[bytes | None], wanted: list[np.ndarray] | None = None) -> tuple[Entries, tuple[list[int], list[bytes]]]:
    """A slice's entries without the windows that repeat earlier ones of the slice, and the spans of these.

    ``wanted``: for each text the places of the anchors whose entries matter; all without it.
    """
    order = np.argsort(doc, kind="stable")
    doc, texts = doc[order], [texts[i] for i in order]
    words = Words(texts)
    at = _windows(words)
    if len(at):
        anchor, key = _anchors(words, at)
    if len(at) and wanted is not None:
        meant = np.zeros(len(words.hash), bool)
        for i, k in enumerate(order.tolist()):
            meant[words.first[i] + wanted[k][wanted[k] < words.first[i + 1] - words.first[i]]] = True
        some = np.flatnonzero(meant[anchor])
        at, anchor, key = at[some], anchor[some], key[some]
    if not len(at):
        return _joined([]), ([], [])
    full = words.runs(at, at + WINDOW)
    place, vocab = _numbered(words)
    of = words.doc()[at]
    start = at - words.first[of]

    order = np.argsort(full, kind="stable")
    head = _heads(full[order])
    lead = np.empty(len(at), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    again = lead != np.arange(len(at))
    dup = np.flatnonzero(again)
    if len(dup):  # runs of windows that repeat one passage; words decide
        first = np.flatnonzero(_heads(at[dup] - np.arange(len(dup)), at[lead[dup]] - np.arange(len(dup)), of[dup], of[lead[dup]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(dup)]):
            i, j, n = at[dup[a]], at[lead[dup[a]]], b - a + WINDOW - 1
            if (place[i : i + n] != place[j : j + n]).any():
                again[dup[a:b]] = False
    mark = np.flatnonzero(again & ((doc[of] != doc[of[lead]]) | (start != start[lead])))
    mark = mark[np.lexsort((start[mark], doc[of[mark]]))]

    send = np.flatnonzero(~again)
    first = np.flatnonzero(_heads(anchor[send], at[send] - np.arange(len(send))))
    many = np.diff(np.append(first, len(send)))
    e = send[first]
    entries = Entries(key[e], doc[of[e]], start[e], anchor[e] - at[e], many, place[_flat(at[e], at[e] + many + WINDOW - 1)], vocab)
    return entries, _spans(doc[of[mark]], start[mark])


#: Columns as they are sent: the low half of a key tells the prefixes of a bin apart well enough to drop most leaves.
_SENT = ("<u4", *_KINDS[1:])


def _bin(key: np.ndarray, bins: int) -> np.ndarray:
    return (key // np.uint64(((1 << 64) - 1) // bins)).astype(np.int64)


def _short(key: np.ndarray, bins: int) -> np.ndarray:
    """Names of prefixes as the count knows them: the bin, and the low half of the key; with no bins the key itself."""
    return (_bin(key, bins).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF)) if bins else key


class Hot(NamedTuple):
    """Prefixes that are dealt to several bins: sorted names over ``bins``, and how many bins each gets."""

    names: np.ndarray
    tiles: np.ndarray
    bins: int


def _dealt(entries: Entries, bins: int, hot: Hot) -> Iterator[tuple[int, bytes, int, int]]:
    """(bin, compressed entries, their size and words) for each bin."""
    to = _bin(entries.key, bins)
    if len(hot.names):
        name = _short(entries.key, hot.bins)
        place = np.minimum(np.searchsorted(hot.names, name), len(hot.names) - 1)
        is_hot, tiles = hot.names[place] == name, hot.tiles
        salt = mix(entries.doc.astype(np.uint64) ^ np.uint64(0x5A17)) % tiles[place].astype(np.uint64)
        own = mix(entries.key + mix(salt + np.uint64(1))) >> np.uint64(24)
        to = np.where(is_hot, own.astype(np.int64) + _HOT_BIN, to)
    order = np.lexsort((entries.start, entries.doc, to))
    entries, to = entries.take(order), to[order]
    first = np.flatnonzero(_heads(to)).tolist() if len(to) else []
    begin = entries.first()
    for a, b in zip(first, [*first[1:], len(to)]):
        used, words, times = np.unique(entries.words[begin[a] : begin[b]], return_inverse=True, return_counts=True)
        by_use = np.argsort(-times, kind="stable")  # small numbers for common words
        number = np.empty(len(used), "<u4")
        number[by_use] = np.arange(len(used), dtype="<u4")
        planes = np.ascontiguousarray(number[words].view(np.uint8).reshape(-1, 4).T)
        vocab = b" ".join([entries.vocab[i] for i in used[by_use].tolist()])  # no word holds a blank
        cols = [x[a:b].astype(k).tobytes() for x, k in zip(entries[:5], _SENT)]
        sizes = np.array([b - a, len(words), len(vocab)], "<u4").tobytes()
        raw = b"".join([sizes, *cols, planes.tobytes(), vocab])
        yield int(to[a]), _ZSTD.compress(raw, asbytes=True), len(raw), len(words)


def _opened(data: pa.Buffer, size: int) -> Entries:
    raw = _ZSTD.decompress(data, size, asbytes=True)
    (n, words, vocab), at, cols = np.frombuffer(raw, "<u4", 3).tolist(), 12, []
    for k in _SENT:
        cols.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    planes = np.frombuffer(raw, np.uint8, 4 * words, at).reshape(4, -1)
    return Entries(*cols, np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int32), raw[at + 4 * words :].split(b" ") if vocab else [])


class Subtree:
    """The suffixes of some entries in the order of their words."""

    def __init__(self, entries: Entries):
        self.entries = entries.take(np.lexsort((entries.start, entries.doc)))
        many = self.entries.many.astype(np.int64)
        self.entry = np.repeat(np.arange(len(many)), many)
        self.nth = _flat(np.zeros_like(many), many)
        self.at = self.entries.first()[self.entry] + self.nth
        self.doc, self.start = self.entries.doc[self.entry], self.entries.start[self.entry].astype(np.int64) + self.nth
        words = self.entries.words.astype(np.uint64)
        bits = max(1, len(self.entries.vocab).bit_length())
        columns = []
        for i in range(0, WINDOW, 63 // bits):  # several words to a number
            x = np.zeros(len(self.at), np.uint64)
            for j in range(i, min(WINDOW, i + 63 // bits)):
                x = (x << np.uint64(bits)) | words[self.at + j]
            columns.append(x)
        # suffixes stand by document and start, so a node's leaves come in that order
        by_place = np.lexsort((self.start, self.doc))
        self.order = by_place[np.lexsort([c[by_place] for c in reversed(columns)])]
        #: Whether a suffix shares less than WINDOW words with the one before, so that a node begins.
        self.node = _heads(*(c[self.order] for c in columns)) if len(self.order) else np.zeros(0, bool)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, whether its node's first leaf is another place, and whether it isn't that leaf."""
        lead = np.empty(len(self.order), np.int64)
        lead[self.order] = self.order[np.maximum.accumulate(np.where(self.node, np.arange(len(self.order)), 0))]
        return (self.doc != self.doc[lead]) | (self.start != self.start[lead]), lead != np.arange(len(lead))

    def deeper(self, left: np.ndarray, level: int) -> Entries:
        """The suffixes at places ``left`` as entries of the prefixes of a level."""
        width = LEVELS[level]
        off = self.entries.off[self.entry[left]].astype(np.int64) - self.nth[left]  # words from a window to its anchor
        part = off // width
        first = np.flatnonzero(_heads(self.entry[left], part, left - np.arange(len(left)))) if len(left) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(left)))
        e, low = left[first], part[first] * width
        anchor = self.at[e] + off[first]
        hashes = Words([b" ".join(self.entries.vocab)]).hash[self.entries.words]
        key = ranges(hashes, anchor - low, anchor - np.minimum(low + width, LEVELS[0]) + 1 + WINDOW, "word")
        words = self.entries.words[_flat(self.at[e], self.at[e] + many + WINDOW - 1)]
        return Entries(key, self.doc[e], self.start[e], off[first], many, words, self.entries.vocab)


_OUT = "doc long, spans binary, key long, start long, off int, many int, text binary"
_OUT_NAMES = ["doc", "spans", "key", "start", "off", "many", "text"]


def _marks(names: list[int], spans: list[bytes]) -> pa.RecordBatch:
    n = len(names)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(spans, pa.binary()), *(pa.nulls(n, k) for k in kinds)], names=_OUT_NAMES)


def _undecided(e: Entries) -> pa.RecordBatch:
    first, words = e.first().tolist(), [e.vocab[i] for i in e.words.tolist()]
    text = [b" ".join(words[a:b]) for a, b in zip(first, first[1:])]
    cols = [pa.array(e.key.view(np.int64)), pa.array(e.start, pa.int64()), pa.array(e.off, pa.int32()), pa.array(e.many, pa.int32()), pa.array(text, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(e.doc, pa.int64()), pa.nulls(len(text), pa.binary()), *cols], names=_OUT_NAMES)


def _decided_later(batch: pa.RecordBatch) -> Entries:
    """What ``_undecided`` wrote."""
    cols = [np.asarray(batch.column(i)) for i in range(5)]
    words, vocab = _numbered(Words(batch.column(5).to_pylist()))
    return Entries(cols[0].view(np.uint64), *cols[1:], words, vocab)


def _grown(parts: list[Entries], whole: bool, level: int) -> Iterator[pa.RecordBatch]:
    """Marks of a bin or of a chunk of it, and, unless it is whole, what is left to decide."""
    if whole:  # prefixes with one entry are leaves
        keys, place, count = np.unique(np.concatenate([p.key for p in parts]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p.key) for p in parts])
        parts = [p.take(np.flatnonzero(c > 1)) for p, c in zip(parts, np.split(count[place], ends[:-1]))]
    entries = _joined(parts)
    if not len(entries.key):
        return
    tree = Subtree(entries)
    marked, later = tree.repeats()
    mark = np.flatnonzero(marked)
    mark = mark[np.lexsort((tree.start[mark], tree.doc[mark]))]
    yield _marks(*_spans(tree.doc[mark], tree.start[mark]))
    if not whole:
        yield _undecided(tree.deeper(np.flatnonzero(~later), level))


def _forest(dealt: DataFrame, level: int) -> DataFrame:
    """Marks (doc, spans) and undecided entries from rows (bin, doc, size, words, data)."""
    chunk, after = CHUNK_WORDS, min(level + 1, len(LEVELS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, split = None, [], 0, False
        for batch in batches:
            names, size, many, data = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i, to in enumerate(batch.column(0).to_pylist()):
                if to < 0:
                    yield _marks([names[i]], [data[i].as_py()])
                    continue
                ended, full = to != now, held + many[i] > chunk
                if parts and (ended or full):
                    split = split or not ended
                    yield from _grown(parts, not split, after)
                    parts, held = [], 0
                    trim()
                if ended:
                    now, split = to, to >= _HOT_BIN
                parts.append(_opened(data[i].as_buffer(), size[i]))
                held += many[i]
        if parts:
            yield from _grown(parts, not split, after)
            trim()

    # the rows of a bin follow each other, so a task holds one chunk of one bin
    return dealt.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, _OUT)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.binary()))], names=["bin", "doc", "size", "words", "data"])


def _rows_of(held: list[Entries], bins: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    rows = []
    for to, data, size, words in _dealt(_joined(held), bins, hot):
        rows.append((to, None, size, words, data))
        if len(rows) == 100:
            yield _row_batch(rows)
            rows = []
    yield _row_batch(rows)


def _deal(found: Iterator[tuple[Entries, tuple[list[int], list[bytes]]]], bins: int, hot: Hot, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (bin, doc, size, words, data): entries by bin, and spans in bins below 0, which nothing gathers."""
    held: list[Entries] = []
    size = 0
    for entries, (names, spans) in found:
        yield _row_batch([(-1 - (n & 0xFFFFFFFF), n, 0, 0, s) for n, s in zip(names, spans)])
        held.append(entries)
        size += len(entries.words)
        if size > most:
            yield from _rows_of(held, bins, hot)
            held, size = [], 0
            trim()
    yield from _rows_of(held, bins, hot)


_DEALT = "bin long, doc long, size long, words long, data binary"


def _hot(counts: DataFrame, total: float, parts: int, bins: int) -> Hot:
    """Of names (name, n) those of over a quarter of a partition's share, of which there are at most 4 for each partition."""
    share = max(HOT_ENTRIES, total / (4 * parts))
    rows = sorted((r["name"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in counts.where(F.col("n") > share).collect())
    return Hot(np.array([k for k, _ in rows], np.uint64), np.array([-(-n // int(share)) for _, n in rows], np.uint64), bins)


_PLACES = "doc long, place int, name long, n long"


def _place_batch(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["doc", "place", "name", "n"])


def _shared_places(texts: DataFrame, bins: int) -> DataFrame:
    """(doc, place) of the anchors of prefixes with several entries, and (name, n) of those with HOT_ENTRIES or more."""
    most, hot = HELD_ENTRIES, HOT_ENTRIES

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, of in slices(batch):
                held.append(_prefixes(np.asarray(part.column(0)), of))
                size += len(held[-1][0])
                if size > most:
                    yield from sent(held)
                    held, size = [], 0
        yield from sent(held)

    def sent(held: list) -> Iterator[pa.RecordBatch]:
        key, doc, place = (np.concatenate([h[i] for h in held] or [np.zeros(0, k)]) for i, k in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(key, kind="stable")
        key, doc, place = key[order], doc[order], place[order]
        first = np.flatnonzero(_heads(key)) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        known = np.flatnonzero(np.repeat(count > 1, count))  # shared here already; nothing gathers bins below 0
        known = known[np.argsort(doc[known], kind="stable")]
        cuts = np.flatnonzero(_heads(doc[known])).tolist() if len(known) else []
        places = place[known].astype("<u4")
        rows = [(-1 - (int(doc[known[a]]) & 0xFFFFFFFF), int(doc[known[a]]), 0, 0, places[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(known)])]
        cols = [(key[first] & np.uint64(0xFFFFFFFF)).astype("<u4"), count.astype("<u4"), doc[first].astype("<i8"), place[first].astype("<u4")]
        to = _bin(key[first], bins)
        cuts = np.flatnonzero(_heads(to)).tolist() if len(to) else []
        rows += [(int(to[a]), None, b - a, 0, b"".join([c[a:b].tobytes() for c in cols])) for a, b in zip(cuts, [*cuts[1:], len(to)])]
        for i in range(0, len(rows), 2_000):
            yield _row_batch(rows[i : i + 2_000])
        trim()

    def counted(now: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cols = []
        for kind, at, to in (("<u4", 0, 4), ("<u4", 4, 8), ("<i8", 8, 16), ("<u4", 16, 20)):
            cols.append(np.concatenate([np.frombuffer(d[at * n : to * n], kind) for n, d in held]))
        low, count, doc, place = cols
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(_heads(low[order]))
        total = np.add.reduceat(count[order].astype(np.int64), first)
        shared = order[np.repeat(total > 1, np.diff(np.append(first, len(low)))) & (count[order] == 1)]
        shared = shared[np.argsort(doc[shared], kind="stable")]
        yield _place_batch(doc[shared], place[shared])
        many = np.flatnonzero(total >= hot)
        if len(many):
            name = (np.uint64(now) << np.uint64(32)) | low[order][first[many]].astype(np.uint64)
            empty = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty.cast(pa.int32()), pa.array(name.view(np.int64)), pa.array(total[many])], names=["doc", "place", "name", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for to, doc, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if to < 0:
                    places = np.frombuffer(data, "<u4")
                    yield _place_batch(np.full(len(places), doc), places)
                    continue
                if to != now and held:
                    yield from counted(now, held)
                    held = []
                    trim()
                now = to
                held.append((n, data))
        if held:
            yield from counted(now, held)
            trim()

    # the rows of a bin follow each other, so a task holds one bin
    return texts.mapInArrow(keys, _DEALT).repartition("bin").sortWithinPartitions("bin").mapInArrow(count, _PLACES)


def repeats(texts: DataFrame) -> DataFrame:
    """doc, spans: of each document (doc, text) the word ranges that repeat earlier ones, as pairs of unsigned 32-bit numbers."""
    texts = texts.select("doc", "text")
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts, most = partitions(texts), HELD_WORDS
    bins = lambda size: max(4 * parts, int(size // BIN_BYTES))
    counts = max(4 * parts, total // COUNT_BYTES)
    places = cut(_shared_places(texts, counts), "places")
    hot, n_bins = _hot(places.where("name IS NOT NULL"), total / ENTRY_BYTES, parts, counts), bins(total)
    wanted = places.where("doc IS NOT NULL").groupBy("doc").agg(F.collect_list("place").alias("places"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[Entries, tuple[list[int], list[bytes]]]]:
            for batch in batches:
                for part, of in slices(batch):
                    yield _fold(np.asarray(part.column(0)), of, [np.asarray(x.values) for x in part.column(2)])

        yield from _deal(found(), n_bins, hot, most)

    # in order, so that a task that runs again cuts the same slices
    rows = texts.join(wanted, "doc").select("doc", "text", "places").sortWithinPartitions("doc")
    out = cut(_forest(rows.mapInArrow(first, _DEALT), 0), "repeats")
    marks = [out]
    for level in range(1, 100):
        left = out.where("key IS NOT NULL")
        size = left.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
        if not size["n"]:
            break
        level = min(level, len(LEVELS) - 1)
        hot, n_bins = _hot(left.groupBy(F.col("key").alias("name")).agg(F.count("*").alias("n")), size["n"], parts, 0), bins(size["bytes"])

        def again(batches: Iterator[pa.RecordBatch], hot: Hot = hot, n_bins: int = n_bins) -> Iterator[pa.RecordBatch]:
            yield from _deal(((_decided_later(b), ([], [])) for b in batches), n_bins, hot, most)

        out = cut(_forest(left.select("key", "doc", "start", "off", "many", "text").mapInArrow(again, _DEALT), level), "repeats")
        marks.append(out)
    spans = marks[0].select("doc", "spans")
    for m in marks[1:]:
        spans = spans.unionByName(m.select("doc", "spans"))
    return spans.where("spans IS NOT NULL").groupBy("doc").agg(F.collect_list("spans").alias("spans"))


def _without(words: Words, i: int, text: bytes, at: int, spans: list[bytes]) -> tuple[bytes, int]:
    """The i-th text of a slice, which begins at byte ``at``, without the words in spans, and how many these are."""
    a, b = words.first[i], words.first[i + 1]
    start, end = words.start[a:b] - at, words.end[a:b] - at
    edge = np.zeros(len(start) + 1, np.int64)
    pairs = np.minimum(np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2), len(start))
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    step = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept, done = [], 0
    for x, y in step.reshape(-1, 2).tolist():
        kept.append(text[done : start[x]])
        done = int(start[y]) if y < len(start) else int(end[-1])
    return b"".join([*kept, text[done:]]), int(gone.sum())


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with the words that stay in ``text``, and n_words and n_removed."""
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(_NAMELESS)))
    found = repeats(docs.select(name.alias("doc"), "text")).withColumnsRenamed({"doc": "__doc", "spans": "__spans"})
    rows = docs.select(*rest, "text", name.alias("__doc")).join(found, "__doc", "left").select(*rest, "__spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                spans = part.column(part.num_columns - 2).to_pylist()
                n, gone = [len((t or b"").split()) for t in texts], [0] * len(texts)  # at the same six characters
                some = [i for i, s in enumerate(spans) if s and texts[i]]
                words, at = Words([texts[i] for i in some]), 0
                for k, i in enumerate(some):
                    size = len(texts[i])
                    texts[i], gone[i] = _without(words, k, texts[i], at, spans[i])
                    at += size + 1
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*rest, "text", "n_words", "n_removed"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return rows.mapInArrow(run, f"{kinds}, text string, n_words long, n_removed long")
