"""SentencePiece encoding and decoding by a distinct-chunk table.

The pieces of the model never hold a whitespace marker after another character
(checked when the model is loaded), so no merge crosses the start of a marked
word. Each task keeps one table of marked words: every distinct one is
segmented once by the library and its ids are joined back by position. The
table stays on the worker, as shipping each word of each document through a
shuffle would move more bytes than the texts have; it is emptied when full, so
its memory is bounded whatever the input.

Results: a null or empty text has only the end id; whole texts are encoded
however long; equal rows give equal results; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct marked words kept in a worker's table before it starts anew.
TABLE_WORDS = 1_000_000
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
_LOADED: dict[str, "ChunkTable"] = {}


class ChunkTable:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"
        self.mark = np.array([self.sp.piece_to_id(MARK)], np.int32)
        self.clear()

    def clear(self) -> None:
        """The table: the place of each word, where its ids start in ``flat``, and how many they are."""
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, words: list[str]) -> None:
        # an empty chunk is a lone marker, for which the library's encode("") gives nothing
        got = [x if w else self.mark for w, x in zip(words, self.sp.encode(words, num_threads=1))]
        n = np.fromiter(map(len, got), np.int64, len(got))
        first, total = len(self.place), int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.int32, total)
        self.start[first : first + len(words)] = self.used + np.cumsum(n) - n
        self.count[first : first + len(words)] = n
        self.place.update(zip(words, range(first, first + len(words))))
        self.used += total

    def chunks(self, text: str) -> list[str]:
        """Marked words, each without its first marker."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin, with one more entry at the end."""
        if not self.apart:  # a model whose pieces cross markers is run on whole texts
            got = [self.sp.encode(t or "", add_eos=True) for t in texts]
            return np.array(list(chain.from_iterable(got)), np.int32), np.cumsum([0, *map(len, got)])
        chunks = [self.chunks(t) if t else [] for t in texts]
        words = list(chain.from_iterable(chunks))
        new = set(words).difference(self.place)
        if new:
            if len(self.place) + len(new) > TABLE_WORDS:
                self.clear()
                new = set(words)
            self.add(list(new))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        n = self.count[at]
        end = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(self.start[at] - end[:-1], n) + np.arange(end[-1])]
        bounds = end[np.cumsum([0, *map(len, chunks)])]
        eos = np.full(len(texts), self.sp.eos_id(), np.int32)
        return np.insert(flat, bounds[1:], eos), bounds + np.arange(len(bounds))


def loaded(model: str) -> ChunkTable:
    if model not in _LOADED:
        _LOADED[model] = ChunkTable(model)
    return _LOADED[model]


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without the column ``text``, with the text's ids and the end id as array<int>."""
    rest = [c for c in df.columns if c not in (text, ids)]
    plain = df.select(*rest, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, bounds = table.encode(part.column(part.num_columns - 1).to_pylist())
                arrays = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, ids])

    schema = plain.drop("text").schema.add(ids, T.ArrayType(T.IntegerType()))
    return plain.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` without the column ``ids``, with the library's decoding; null ids give null."""
    rest = [c for c in df.columns if c not in (ids, text)]
    plain = df.select(*rest, F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = loaded(model).sp
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                col = part.column(part.num_columns - 1)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0))]).tolist()
                flat = col.flatten().to_numpy().tolist()
                texts = [sp.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*rest, text])

    return plain.mapInArrow(run, plain.drop("ids").schema.add(text, "string"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of what they decode to."""
    ids = encode(docs.select("doc_id", "text"), model)
    ids = ids.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    return decode(ids, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
