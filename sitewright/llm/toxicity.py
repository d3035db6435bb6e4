"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and their beginnings; those that toxic examples hold
clearly more often than others make the vocabulary. Document frequencies come
from all documents. The labelled examples form an inverted index whose postings
are cut into blocks with their greatest weight: a block is scored only if its
bound reaches the k-th best found so far, so the result is that of a full
search. The nearest examples vote with weights by cosine; each vote stands for
as many documents as its class had for one sampled, which calibrates the score.

Results: a text without a term of the vocabulary (empty and null ones too) gets
the rate of toxic ones among such examples; without labels that is 0; equal
texts get equal scores; extra columns are ignored; an empty table gives an
empty one; repeated labels count one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import keep
from sitewright.llm.langid import held_out
from sitewright.llm.textkernel import NO_LETTER, Words, slices, trim

#: Expected examples of each class that training reads.
TRAIN_DOCS = 4_000
#: Terms of the vocabulary at most.
TERMS = 3_000
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.3
_PREFIXES = (4, 5, 6, 7, 8, 9)


def _terms(texts: list[bytes | None]) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Places of words and the hashes of their terms, one kind of term after the other."""
    words = Words(texts, lower=True, delim=NO_LETTER)
    yield words, np.arange(len(words.hash)), words.hash
    for n in _PREFIXES:
        at, h = words.prefixes(n)
        yield words, at, h ^ np.uint64(n * 0x51ED2701)


def _class_counts(sample: DataFrame) -> DataFrame:
    """term, n1, n0: examples of either class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                label = np.asarray(part.column(0).to_pylist(), np.int64)
                held, docs = [], []
                for words, at, h in _terms(texts):
                    held.append(h)
                    docs.append(words.doc()[at])
                h, d = np.concatenate(held), np.concatenate(docs)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, y = h[first], label[d[first]]
                terms, place = np.unique(h, return_inverse=True)
                ones = np.bincount(place, y, len(terms)).astype(np.int64)
                both = np.bincount(place, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(ones), pa.array(both - ones)], names=["term", "n1", "n0"])

    return sample.select("toxic", "text").mapInArrow(run, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def vocabulary(sample: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """Sorted hashes of the terms that tell toxic examples apart, by chi squared."""
    n1, n0 = float(max(1, sizes.get(1, 0))), float(max(1, sizes.get(0, 0)))
    a, b = F.col("n1"), F.col("n0")
    chi = (n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (n1 * n0 * (a + b) * F.greatest(F.lit(1.0), n1 + n0 - a - b))
    kept = _class_counts(sample).where((a >= 3) & (a / n1 > 4 * b / n0)).select("term", chi.alias("chi")).where("chi > 8")
    return np.sort(np.array([r["term"] for r in kept.orderBy(F.desc("chi"), "term").limit(TERMS).collect()], np.int64).view(np.uint64))


class Vocabulary:
    def __init__(self, terms: np.ndarray):
        """terms: sorted hashes."""
        self.terms = terms
        self.seen = np.zeros(1 << 20, bool)  # of the hashes' first bits, to look up few
        self.seen[terms >> np.uint64(44)] = True

    def count(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms begin, with one more entry at the end; places in the vocabulary, ascending; counts."""
        ids, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words, at, h in _terms(texts) if len(self.terms) else ():
            some = np.flatnonzero(self.seen[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
            good = self.terms[place] == h[some]
            ids.append(place[good])
            docs.append(words.doc()[at[some[good]]])
        key, n = np.unique(np.concatenate(docs) * (1 << 32) + np.concatenate(ids), return_counts=True)
        return np.searchsorted(key >> 32, np.arange(len(texts) + 1)), (key & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


def vectors(docs: DataFrame, vocab: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep``, terms array<int> (places in the vocabulary, ascending) and counts array<int>."""
    plain = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                offs, ids, n = vocab.count(texts)
                lists = [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(x)) for x in (ids, n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*keep, "terms", "counts"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{kinds}, terms array<int>, counts array<int>")


class Index:
    """Block-max inverted index of distinct unit vectors with the votes of each class."""

    def __init__(self, examples: dict[tuple, list[float]], idf: np.ndarray, prior: list[float], one: tuple[float, float] = (1.0, 1.0)):
        """examples: ((term, count), ...) to the weight of class 0 and 1; prior: those of examples without a term; one: the weight of one example."""
        self.idf, self.one = idf, one
        rows = sorted(examples)
        self.votes = np.array([examples[r] for r in rows], float).reshape(-1, 2)
        self.blocks = -(-len(rows) // BLOCK)
        total = self.votes.sum(0) + prior
        self.base = (total[1] + 1e-3) / (total.sum() + 1.0) if total.sum() else 0.0
        self.empty = (prior[1] + self.base * 0.5) / (sum(prior) + 0.5)
        term, row, weight = [], [], []
        for i, r in enumerate(rows):
            t, w = self.unit(np.array([x for x, _ in r]), np.array([n for _, n in r]))
            term.append(t)
            row.append(np.full(len(t), i))
            weight.append(w)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        term, self.row, self.weight = cat(term, int), cat(row, int), cat(weight, float)
        order = np.lexsort((self.row, term))
        term, self.row, self.weight = term[order], self.row[order], self.weight[order]
        self.at = np.searchsorted(term, np.arange(len(idf) + 1))
        block = self.row // BLOCK
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(head)
        self.block_of, self.most = block[starts], np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.block_at = np.searchsorted(term[starts], np.arange(len(idf) + 1))

        self.slope, self.shift = 1.0, 0.0
        self._calibrate(rows)

    def _calibrate(self, rows: list[tuple]) -> None:
        """Fit a logistic curve to what each example would score if it were not in the index itself."""
        logits, label, weight = [], [], []
        for i, r in enumerate(rows):
            terms, counts = np.array([t for t, _ in r]), np.array([n for _, n in r])
            for y in (0, 1):
                if own := self.one[y] if self.votes[i, y] > 0 else 0.0:
                    had, self.votes[i, y] = self.votes[i, y], max(0.0, self.votes[i, y] - own)
                    s = min(1 - 1e-6, max(1e-6, self._share(*self.nearest(terms, counts))))
                    self.votes[i, y] = had
                    logits.append(np.log(s / (1 - s)))
                    label.append(y)
                    weight.append(had)
        if len(set(label)) < 2:
            return
        x = np.column_stack([logits, np.ones(len(logits))])
        y, w, fit = np.array(label, float), np.array(weight) / np.mean(weight), np.array([1.0, 0.0])
        for _ in range(30):  # Newton steps, held near the identity where examples are few
            p = 1 / (1 + np.exp(-x @ fit))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (w * (p - y)) + (fit - [1.0, 0.0]))
            fit = fit - np.clip(step, -1, 1)
        if 0.2 < fit[0] < 20:
            self.slope, self.shift = float(fit[0]), float(fit[1])

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k best, ties to the smaller row; rows that share no term take no part."""
        terms, q = self.unit(terms, counts)
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, q):
            s = slice(self.block_at[t], self.block_at[t + 1])
            bound[self.block_of[s]] += w * self.most[s]
        order = np.argsort(-bound, kind="stable")
        score = np.zeros(len(self.votes))
        done, width, floor = 0, 4, 0.0
        while done < len(order) and bound[order[done]] > 0 and bound[order[done]] >= floor - 1e-9:
            chosen = np.zeros(self.blocks, bool)
            some = order[done : done + width]
            chosen[some[bound[some] >= floor - 1e-9]] = True
            for t, w in zip(terms, q):
                s = slice(self.at[t], self.at[t + 1])
                rows = self.row[s]
                hit = chosen[rows // BLOCK]
                score[rows[hit]] += w * self.weight[s][hit]
            done += width
            width *= 4
            if len(score) > k:
                floor = max(floor, float(np.partition(score, -k)[-k]))
        found = np.flatnonzero(score > 0)
        found = found[np.lexsort((found, -np.round(score[found], 9)))][:k]
        return found, score[found]

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The votes' share of class 1, and the evidence."""
        if not len(terms):
            return self.empty, terms, np.zeros(0)
        rows, cos = self.nearest(terms, counts)
        if not len(rows):
            return self.base, rows, cos
        s = min(1 - 1e-6, max(1e-6, self._share(rows, cos)))
        return float(1 / (1 + np.exp(-(self.slope * np.log(s / (1 - s)) + self.shift)))), rows, cos

    def _share(self, rows: np.ndarray, cos: np.ndarray) -> float:
        votes = self.votes[rows] * (np.minimum(cos, 1.0) ** 8)[:, None]
        return float((votes[:, 1].sum() + self.base * 0.3) / (votes.sum() + 0.3))


class Scorer:
    """Scores of texts' vectors, each distinct one searched once as long as the memo holds it."""

    MEMO = 20_000

    def __init__(self, index: Index):
        self.index = index
        self.memo: dict[bytes, tuple[float, int, float]] = {}

    def many(self, offs: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[tuple[float, int, float]]:
        """(score, neighbours, best cosine) of each vector."""
        out = []
        for a, b in zip(offs.tolist(), offs[1:].tolist()):
            key = ids[a:b].tobytes() + counts[a:b].tobytes()
            got = self.memo.get(key)
            if got is None:
                if len(self.memo) > self.MEMO:
                    self.memo.clear()
                s, rows, cos = self.index.score(ids[a:b].astype(np.int64), counts[a:b])
                got = self.memo[key] = (min(1.0, max(0.0, s)), len(rows), float(cos[0]) if len(cos) else 0.0)
            out.append(got)
        return out


_SCORED = (("score", pa.float64()), ("neighbours", pa.int32()), ("nearest", pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, hold: int = 2) -> tuple[Vocabulary, Index, DataFrame]:
    """The vocabulary, the index of labelled examples, and the vectors of all documents (doc_id, terms, counts)."""
    known = labels.where(~held_out(parts, hold) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, TRAIN_DOCS / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for k, p in share.items():
        wanted = wanted | ((F.col("toxic") == k) & (draw < p))
    drawn = F.broadcast(known.where(wanted))  # twice TRAIN_DOCS rows of two numbers are expected
    texts = docs.select("doc_id", "text")
    sample = keep(texts.join(drawn, "doc_id").repartition(8))
    got = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    vocab = Vocabulary(vocabulary(sample, got))

    every = keep(vectors(texts, vocab, ["doc_id"]))
    df = {r["t"]: r["n"] for r in every.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # TERMS rows at most
    n_docs = every.count()
    idf = np.array([np.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in range(len(vocab.terms))])
    weight = {k: sizes[k] / got[k] for k in got}
    examples: dict[tuple, list[float]] = {}
    prior = [0.0, 0.0]
    for r in vectors(sample, vocab, ["toxic"]).groupBy("toxic", "terms", "counts").count().collect():  # the sample's bound
        own = examples.setdefault(tuple(zip(r["terms"], r["counts"])), [0.0, 0.0]) if r["terms"] else prior
        own[r["toxic"]] += r["count"] * weight[r["toxic"]]
    return vocab, Index(examples, idf, prior, (weight.get(0, 1.0), weight.get(1, 1.0))), every


def score(docs: DataFrame, labels: DataFrame, parts: int = 4, hold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, nearest for every row of docs (doc_id, text)."""
    _, index, every = fit(docs, labels, parts, hold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index)
        for batch in batches:
            terms, counts = batch.column(1), batch.column(2)
            offs = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(terms)))])
            out = scorer.many(offs, np.asarray(terms.flatten()), np.asarray(counts.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(_SCORED))], names=["doc_id", *(n for n, _ in _SCORED)])
            trim()

    found = every.mapInArrow(run, "doc_id long, score double, neighbours int, nearest double")
    return found.select("doc_id", held_out(parts, hold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "nearest")


def annotate(docs: DataFrame, labels: DataFrame, parts: int = 4, hold: int = 2) -> DataFrame:
    """All columns of docs and score, neighbours, nearest, predicted; texts are read once more, and no row moves."""
    names = [n for n, _ in _SCORED]
    rest = [c for c in docs.columns if c not in ("text", "predicted", *names)]
    vocab, index, _ = fit(docs, labels, parts, hold)
    rows = docs.select(*rest, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index)
        for batch in batches:
            for part, texts in slices(batch):
                out = scorer.many(*vocab.count(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(_SCORED))], names=[*rest, "text", *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(run, f"{kinds}, score double, neighbours int, nearest double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
