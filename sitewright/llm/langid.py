"""Language ID by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte
n-grams (log-odds learned from counts of the languages on either side) gives a
margin for a whole text; decoding takes the codeword of least logistic loss,
each bit weighted by how well it tells its sides apart. A text whose two least
losses are nearly equal is flagged as ambiguous.

Results: a null text or one without a letter is ``und`` with score 0; so is
every text where nothing could be learned; equal texts get equal results; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as naturals

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.textkernel import NO_LETTER, slices

#: Expected documents of a language that training reads; the others of that language are not needed for its counts.
TRAIN_DOCS = 2_000
BUCKETS = 1 << 16
GRAMS = (3, 4)
#: Difference of the two least losses, for one bit's weight, below which a text is ambiguous.
AMBIGUOUS = 0.5

_FOLD = np.where(NO_LETTER, 32, np.arange(256)).astype(np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += np.uint32(32)


def held_out(parts: int, hold: int) -> Column:
    """The rows that training must not see; a null doc_id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == hold, F.lit(True))


def _grams(data: bytes) -> Iterator[np.ndarray]:
    """For each n the bucket of the n-gram that starts at each byte; bucket 0 holds blanks alone."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    for n in GRAMS:
        x = np.zeros(max(0, len(b) - n + 1), np.uint32)
        for i in range(n):
            x = (x << np.uint32(8)) | b[i : len(b) - n + 1 + i]
        blank = x == np.uint32(0x20202020 >> (8 * (4 - n)))
        h = (((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
        h[blank] = 0
        yield h


def codebook(languages: int) -> np.ndarray:
    """Codewords of -1 and 1, one row for each language: all splits of few languages, else the best of many seeded draws."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = [[1, *(1 if m >> i & 1 else -1 for i in range(languages - 1))] for m in range(2 ** (languages - 1) - 1)]
        return np.array(bits).T.astype(float)
    width = 3 * int(np.ceil(np.log2(languages))) + 8
    best, apart = np.zeros((0, 0)), -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, width))
        gaps = (width - code @ code.T) / 2 + width * np.eye(languages)
        if gaps.min() > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, gaps.min()
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: for each language those of its n-grams by bucket."""
        self.languages, self.code = languages, codebook(len(languages))
        rate = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1])
        for b in range(self.code.shape[1]) if len(languages) > 1 else ():
            for_, against = rate[self.code[:, b] > 0].mean(0), rate[self.code[:, b] < 0].mean(0)
            w = np.clip(np.log(for_ / against), -4, 4)
            w[0] = 0
            self.weights[:, b] = w
            margins = rate @ w
            self.trust[b] = max(1e-3, (margins * self.code[:, b]).min())  # what the worst language has on its own side
        self.trust /= self.trust.max(initial=1e-3)

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean log-odds of each text's n-grams for each bit."""
        data = b"".join((t or b"") + b"   " for t in texts) + b"   "
        size = np.array([len(t or b"") for t in texts], np.int64)
        starts = np.cumsum(size + 3) - size - 3
        after = (np.repeat(starts + size, 3) + np.tile(np.arange(3), len(texts))).astype(np.int64)
        total = np.zeros((len(texts), self.weights.shape[1]))
        seen = np.zeros(len(texts))
        for h in _grams(data):
            h = h[: len(data) - 3]  # so that equal texts are sums of equally many
            h[after] = 0  # those of the blanks between texts reach into the next one
            for b in range(self.weights.shape[1]):
                total[:, b] += np.add.reduceat(self.weights[:, b][h], starts)
            seen += np.add.reduceat(h != 0, starts, dtype=np.int64)
        return total / np.maximum(seen, 1)[:, None]

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score, and how much more the next nearest codeword loses in the mean of the bits' weights."""
        m = self.margins(texts) * 6
        loss = np.stack([(np.logaddexp(0, -c * m) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(2 * (loss.min(1, keepdims=True) - loss))
        p /= p.sum(1, keepdims=True)
        two = np.sort(loss, axis=1)[:, :2]
        apart = (two[:, 1] - two[:, 0]) / self.trust.sum() if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(1), p.max(1), apart


def train(docs: DataFrame, lang: str = "lang") -> Model | None:
    """Learn from (doc_id, text, lang) rows; a bounded share of each language, drawn by doc_id, is counted."""
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, TRAIN_DOCS / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text").repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in slices(batch):
                for name, t in zip(part.column(0).to_pylist(), texts):
                    own = found.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for h in _grams(t or b""):
                        own += np.bincount(h, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(found), pa.string()), "counts": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = sample.mapInArrow(run, "lang string, counts binary").groupBy("lang").applyInArrow(summed, "lang string, counts binary")
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in found.collect()}  # a row of BUCKETS numbers for each language
    languages = sorted(counts)
    return Model(languages, np.stack([counts[x] for x in languages]).astype(float)) if languages else None


def _has_letter(text: bytes | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and lang_pred, score, ambiguous, without moving a row; columns of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "ambiguous")]
    rows = docs.select(*rest, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                known = np.array([_has_letter(t) for t in texts], bool) & (model is not None)
                best, score, apart = model.predict(texts) if model is not None else (np.zeros(len(texts), int), *np.zeros((2, len(texts))))
                names = [model.languages[i] if k else "und" for i, k in zip(best, known)]
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(~known | (apart < AMBIGUOUS))], names=[*rest, "text", "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs (doc_id, text)."""
    return annotate(docs.select("doc_id", "text"), model).drop("text")


def identify(docs: DataFrame, parts: int = 5, hold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the rows that are not held out."""
    found = predict(docs, train(docs.where(~held_out(parts, hold))))
    return found.select("doc_id", held_out(parts, hold).alias("held_out"), "lang_pred", "score", "ambiguous")
