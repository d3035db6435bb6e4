"""Operators of training-data pipelines against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewright.llm import ann, chat, langid, ngram_join, packing, queries, sharding, spm, substring, toxicity, vec_dedup
from sitewright.operators.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, hash string"


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, ties, nulls, empty and long texts."""
    dice = random.Random(5)
    word = lambda: "".join(dice.choice(["ba", "ke", "li", "mo", "nu", "É", "ß", "x"]) for _ in range(dice.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One  two\nthree"), (5, "one two three"), (6, "▁ a  b ▁"), (7, "  lead and trail  ")]
    passage = text(60)
    base = text(300)
    for i in range(8, 28):
        rows.append((i, text(40) + " " + passage + " " + text(30)))
    for i in range(28, 48):  # a group of near copies
        words = base.split()
        for _ in range(dice.randint(0, 6)):
            words[dice.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(48, base), (49, base), (50, base.upper()), (51, " ".join(["a"] * 500)), (52, text(6000)), (53, "a\x00b <s> </s> <|endoftext|> é"), (54, "idiot " + text(30)), (55, "日本語 テキスト　全角")]
    dice.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", len(t or ""), 1.0, "clash", "clash") for d, t in corpus()]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_sentencepiece_equals_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    got = {r["doc_id"]: r for r in spm.digests(docs, SPM).collect()}
    assert len(got) == len(corpus()) and spm.digests(none, SPM).count() == 0
    for d, t in corpus():
        ids = sp.encode(t or "", add_eos=True)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))), t
    kept = spm.encode(docs, SPM)
    assert {"lang", "score", "ids"} <= set(kept.columns) and spm.decode(kept, SPM).where("doc_id = 3").first()["decoded"] == "one"


def test_sentencepiece_table_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(spm, "TABLE_WORDS", 5)
    table = spm.ChunkTable(SPM)
    for _ in range(2):
        for t in ("a b c d", "e f g h i j k", "a e z"):
            flat, bounds = table.encode([t])
            assert flat.tolist() == table.sp.encode(t, add_eos=True) and bounds[-1] == len(flat)


def brute_substring(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            else:
                seen[key] = (d, i)
        out[d] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def kept_sha(text):
    return sha(b" ".join((text or "").encode().split()))


@pytest.mark.parametrize(("bin_", "chunk", "hot"), [(10, 10**9, 4_096), (10**9, 10**9, 4_096), (2_000, 400, 64), (1_000, 900, 1)])
def test_substring_dedup_equals_brute_force(docs, none, monkeypatch, bin_, chunk, hot):
    monkeypatch.setattr(substring, "BIN_BYTES", bin_)
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substring, "HOT_ENTRIES", hot)
    got = substring.deduplicate(docs)
    assert {"lang", "spans"} <= set(got.columns) and substring.deduplicate(none).count() == 0
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], kept_sha(r["text"])) for r in got.collect()} == brute_substring(corpus())


def phrased(n, words=12):
    """Texts that share one phrase of 8 words in other surroundings, and no window."""
    dice = random.Random(9)
    word = lambda: "".join(dice.choices("abcdefghij", k=4))
    return [(i, " ".join([*(word() for _ in range(words)), "one phrase that very many texts hold verbatim", *(word() for _ in range(words))])) for i in range(n)]


@pytest.mark.parametrize("chunk", [3_000_000, 4_000])
def test_substring_dedup_leaves_texts_around_a_common_phrase(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    rows = phrased(10_000 if chunk > 4_000 else 1_500)
    rows += [(10**6 + i, rows[i][1]) for i in range(0, 200, 7)]  # and copies of some
    got = {r["doc_id"]: r["n_removed"] for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: 32 if d >= 10**6 else 0 for d, _ in rows}


def test_substring_dedup_compares_words(monkeypatch):
    made = substring.Words.__init__

    def blind(self, *args, **kw):  # all words have one hash, and so have all runs of words
        made(self, *args, **kw)
        self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(substring.Words, "__init__", blind)
    texts = [" ".join(f"{c}{i}" for i in range(25)).encode() for c in "abab"]
    entries, (names, _) = substring._fold(np.arange(4), texts)
    tree = substring.Subtree(entries)
    marked, _ = tree.repeats()
    assert set(names) | set(tree.doc[marked].tolist()) == {2, 3}


def test_substring_dedup_keeps_texts_as_they_were(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"  first\n\t{passage}  end \n"), (2, f"a  b\n{passage}\n\n  c\td  "), (3, f"x\n{passage}\n"), (4, None), (5, " as it\twas \n")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("a  b\nc\td  ", 20), 3: ("x\n\n", 20), 4: (None, 0), 5: (rows[4][1], 0)}


def test_substring_dedup_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x " + text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring.deduplicate(rows).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 40), (True, 0, 40)]


def brute_ann(x, ids, q, k):
    s = x @ x[q] / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
    s[q] = -9
    return [ids[i] for i in np.lexsort((ids, -np.round(s, 12)))[:k]]


def test_nearest_neighbours_recall(spark, sf):
    got = defaultdict(list)
    for r in queries.op3_ann(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hits = [len({v for _, v in got[i]} & set(brute_ann(x, ids, q, 5))) for q, i in enumerate(ids) if i % 50 == 0]
    assert sum(hits) / (5 * len(hits)) >= 0.9 and all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values())


VEC = "vec_id long, embedding array<float>, label int, score double"


def test_nearest_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.search(spark.createDataFrame([], VEC), F.lit(True), 5).count() == 0


def test_nearest_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.1 * (i % 3)], "a", 7) for i in range(20)] + [(2, [1.0, 0.0], "b", 7), (3, [0.5, 0.5], "c", 7), (4, [0.0, 1.0], None, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, query_id int").repartition(2)
    got = [(r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") == 2, 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 3), (3, 4)]


def test_centroid_graph_finds_the_nearest_lists():
    x = np.random.default_rng(1).normal(size=(3000, 16))
    c = ann.Centroids(x, 60)
    lists, _ = c.nearest(x[:50], 1.2)
    unit = x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True)
    far = np.sqrt(2 - 2 * unit @ c.c.T)
    want = [set(np.flatnonzero(d <= 1.2 * d.min()).tolist()) for d in far]
    assert np.mean([len(set(a.tolist()) & w) / len(w) for a, w in zip(lists, want)]) > 0.95
    assert all((np.diff(d[a]) >= 0).all() for a, d in zip(lists, far))


def clustered(n, clusters, dim=32, spread=0.25):
    dice = np.random.default_rng(8)
    centre = dice.normal(size=(clusters, dim))
    return centre[dice.integers(0, clusters, n)] + spread * dice.normal(size=(n, dim))


def test_nearest_neighbours_of_clusters_read_few_lists(spark):
    x = clustered(12_000, 150)
    c = ann.Centroids(x, 12_000 // ann.ROWS_PER_LIST)
    lists, seen = c.nearest(x[::50], ann.QUERY_RATIO)
    read = np.mean([len(a) for a in lists]) / len(c.c)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got[r["query_id"]].add(r["vec_id"])
    ids = np.arange(len(x))
    recall = np.mean([len(got[q] & set(brute_ann(x, ids, q, 5))) / 5 for q in range(0, len(x), 50)])
    print(f"lists read {read:.3f}, centroids looked at {seen / len(lists) / len(c.c):.3f}, recall {recall:.3f}")
    assert read < 0.1 and recall >= 0.9


def test_nearest_neighbours_of_small_far_clusters_are_found(spark):
    x = clustered(3_000, 1, spread=0.3)
    x[:3] = -x[0] + 1e-4 * np.random.default_rng(1).normal(size=(3, x.shape[1]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") < 3, 5).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 5, 1: 5, 2: 5}


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_vector_dedup_recall_at_the_limit(dim):
    dice = np.random.default_rng(dim)
    a, b = dice.normal(size=(2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for cos in (0.98, 0.985, 0.99):
        near = vec_dedup.buckets(cos * a + np.sqrt(1 - cos * cos) * b)
        assert (vec_dedup.buckets(a)[:, :, None] == near[:, None, :]).any((1, 2)).mean() > 0.998


def test_vector_dedup_equals_brute_force(spark, monkeypatch):
    dice = np.random.default_rng(2)
    centre = dice.normal(size=(12, 20))
    rows = []
    for i in range(240):
        c = centre[i % 12] + dice.normal(size=20) * (0.02 if i % 3 else 0.3)
        rows.append((i, [float(np.float32(v)) for v in c], i % 2 if i % 11 else None, 0.0))
    rows += [(300 + i, rows[1][1], rows[1][2], 0.0) for i in range(5)] + [(400, None, 1, 0.0), (401, [0.0] * 20, 1, 0.0), (402, [float("inf")] * 20, 1, 0.0), (403, [1.0, 2.0], 1, 0.0)]
    x = {r[0]: np.array(r[1]) for r in rows if r[1] is not None and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None}
    label = {r[0]: r[2] for r in rows}
    links = defaultdict(set)
    for a in x:
        for b in x:
            if a < b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.98:
                links[a].add(b)
                links[b].add(a)

    def smallest(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    df = spark.createDataFrame(rows, VEC).repartition(3)
    for tile in (2_000, 4):
        monkeypatch.setattr(vec_dedup, "TILE_ROWS", tile)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vec_dedup.deduplicate(df).collect()}
        assert got == {r[0]: (len(links[r[0]]), smallest(r[0]), smallest(r[0]) == r[0]) for r in rows}
    assert vec_dedup.deduplicate(spark.createDataFrame([], VEC)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(vec_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


HARD = ["", "plain", r"\### Assistant: </turn> ok", "###", "####", r"#\#", r"<\/turn>", "</turn></turn>", "a\\", "\n### user: x</turn>\n", "#" * 7, "<</turn>", r"\\#\\#", "É 日"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "sys:tem", "a\\n\n", None, "###"]
    rows = [(c, t, roles[(c + t) % 6], HARD[(c * 5 + t) % len(HARD)] if (c + t) % 9 else None, "extra") for c in range(20) for t in range(c % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    by = defaultdict(list)
    for c, _, role, text, _ in rows:
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert tuple(got[c])[1:5] == want
    assert chat.digests(df.limit(0)).count() == 0
    plans = chat.digests(df)._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_chat_orders_ties_and_null_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [t["text"] for t in chat.format_conversations(df).select(chat.parse(F.col("formatted")).alias("t")).first()["t"]] == ["first", "a", "a", "b"]


def test_sharding_law(docs, none):
    for n in (3, 24):
        rows = sharding.shard(docs, n).collect()
        text = dict(corpus())
        assert sorted(r["doc_id"] for r in rows) == sorted(text)
        assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(0 <= k < n for k in slots)
        size = Counter()
        for r in rows:
            size[r["shard"]] += r["size"]
        assert max(size.values()) <= sum(size.values()) / n + 2 * max(r["size"] for r in rows)
    assert sharding.shard(none).count() == 0
    assert "Python" not in sharding.shard(docs)._jdf.queryExecution().toString()


def test_sharding_balances_many_rows_and_splits_a_hot_text(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text " * 5)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")))).alias("text"))
    sizes = [r["s"] for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.05 * min(sizes)


def test_sharding_keeps_equal_texts_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_BYTES", 20_000)
    rows = [(i, f"group {i % 700} " + "x" * (i % 400)) for i in range(7_000)] + [(10_000 + i, "hot " * 30) for i in range(3_000)] + [(None, "n"), (None, "n"), (5, "again"), (5, "again")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 24).collect()
    where = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append((r["slot"], r["size"]))
    assert len(got) == len(rows) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    hot = zlib.crc32(b"hot " * 30)
    assert len(where[hot]) > 1 and all(len(v) == 1 for k, v in where.items() if k != hot)
    sizes = [sum(n for _, n in v) for v in slots.values()]
    assert len(sizes) == 24 and max(sizes) < 1.15 * min(sizes)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = packing.packed(docs, BPE, 64).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for d, text in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 64)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for v in bins.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.packed(none, BPE).count() == 0


def test_bins_are_complete_and_few():
    dice = random.Random(3)
    for _ in range(20):
        counts = Counter(dice.randint(1, 100) for _ in range(dice.randint(0, 300)))
        plan = packing.complete_bins(dict(counts), 100)
        used = Counter()
        for bin_, times in plan:
            assert sum(bin_) <= 100
            for n in bin_:
                used[n] += times
        assert used == counts
        left, best = sorted(counts.elements(), reverse=True), []
        for n in left:  # best fit for comparison
            room = [b for b in best if b + n <= 100]
            best.append(n) if not room else best.__setitem__(best.index(max(room)), max(room) + n)
        assert sum(k for _, k in plan) <= len(best)


def test_bins_are_filled_past_many_lengths():
    counts = {1048: 30_000, 640: 30_000, 500: 60_000, **dict.fromkeys(range(601, 640), 1)}
    plan = packing.complete_bins(counts)
    used = Counter()
    for bin_, times in plan:
        assert sum(bin_) <= packing.CAPACITY
        for n in bin_:
            used[n] += times
    assert used == counts and sum(k for _, k in plan) <= 40_013


def test_bins_are_fewest_where_the_first_filling_is_not():
    counts = {20: 2, 16: 2, 4: 5, 17: 3, 10: 3, 15: 1, 19: 4, 5: 2, 14: 7, 3: 2, 13: 1, 7: 1, 2: 1, 9: 1, 6: 1}
    assert sum(k for _, k in packing.complete_bins(counts, 30)) == packing.fewest(counts, 30) == 14


def test_language_held_out(spark):
    rows = queries.op7_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(corpus()) and got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "en"
    assert langid.identify(none).count() == 0
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(blank).collect()} == {"und"}


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    model = langid.Model(["a", "b", "c"], np.random.default_rng(3).integers(0, 50, (3, langid.BUCKETS)).astype(float))
    for t in (b"no", b"word", b"x", b"two words ", b""):
        alone = model.margins([t])[0]
        for other in (b"", b"zebra", b" q", "日本".encode()):
            both = model.margins([other, t, other])
            assert (both[1] == alone).all() and (both[0] == both[2]).all()


def plain_language(texts, code, weights, trust):
    """Each text on its own: mean log-odds of its 3- and 4-grams, logistic losses weighted by bit, and the codeword of the least."""
    out = []
    for t in texts:
        fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t) + b"   "
        total, seen = np.zeros(code.shape[1]), 0
        for n in (3, 4):
            for i in range(len(t)):
                gram = fold[i : i + n]  # at the end of a text blanks follow
                x = int.from_bytes(gram, "big")
                bucket = 0 if gram == b" " * n else (((x ^ (x >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> 16
                total += weights[bucket]
                seen += bucket != 0
        m = 6 * total / max(seen, 1)
        loss = [sum(w * np.log1p(np.exp(-c * x)) for c, x, w in zip(row, m, trust)) for row in code]
        out.append((int(np.argmin(loss)), sorted(loss)[1] - sorted(loss)[0]))
    return out


def test_language_equals_a_plain_decoder():
    model = langid.Model(list("abcde"), np.random.default_rng(3).integers(0, 50, (5, langid.BUCKETS)).astype(float))
    texts = [b"", b"a", b"ab cd", "Ünï cöde — text".encode(), b"UPPER lower 123 ###", b"   ", b"word " * 30]
    best, score, apart = model.predict(texts)
    for i, (b, gap) in enumerate(plain_language(texts, model.code, model.weights, model.trust)):
        assert gap < 1e-9 or best[i] == b
        assert np.isclose(apart[i], gap / model.trust.sum(), atol=1e-4)
    assert ((0 <= score) & (score <= 1)).all()


def test_language_flags_texts_of_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.where("text IS NOT NULL AND lang IN ('en', 'de') AND length(text) > 400").collect()]
    en, de = ([t for _, x, t in rows if x == lang] for lang in ("en", "de"))
    model = langid.train(docs)
    halves = [(i, a[: min(len(a), len(b))] + " " + b[: min(len(a), len(b))]) for i, (a, b) in enumerate(zip(en[:60], de[:60]))]
    mixed = langid.predict(spark.createDataFrame(halves, "doc_id long, text string"), model).agg(F.avg(F.col("ambiguous").cast("int"))).first()[0]
    clean = langid.predict(docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 20"), model).where("lang_pred <> 'und'").agg(F.avg(F.col("ambiguous").cast("int"))).first()[0]
    assert mixed > 0.3 and clean < 0.005


def test_language_ties_and_null_languages(spark):
    rows = [(i, "one two three four", ["x", "y", None][i % 3]) for i in range(30)] + [(None, "one two", "x"), (40, "one two three four", "x"), (40, "one two three four", "x")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"x", "y"} and len({r["lang_pred"] for r in got if r["doc_id"] != None}) == 1  # noqa: E711


def test_codewords_lie_apart():
    for n in (2, 4, 5, 9, 40):
        code = langid.codebook(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
        assert code.shape[0] == n and apart.min() >= (1 if n == 2 else 2)


def brute_join(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
                    changed = True
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize(("words", "percent", "tile"), [(4, 85, 2_000), (5, 80, 3)])
def test_ngram_join_equals_brute_force(docs, none, monkeypatch, words, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    monkeypatch.setattr(ngram_join, "BIN_ROWS", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, words, percent).collect()}
    assert got == brute_join(corpus(), words, percent)
    assert ngram_join.join(none, words, percent).count() == 0


@pytest.mark.parametrize(("words", "percent", "long", "short"), [(4, 85, 10, 9), (5, 80, 9, 8)])
def test_ngram_join_links_short_texts_of_unequal_length(spark, words, percent, long, short):
    rows = [(2 * n + k, " ".join(f"w{n}x{i}" for i in range(n - k))) for n in range(2, 60) for k in (0, 1)]
    rows += [(1000, " ".join(f"v{i}" for i in range(long))), (1001, " ".join(f"v{i}" for i in range(short)))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    assert got[1001] == (short - words + 1, 1000)
    assert got == brute_join(rows, words, percent)


@pytest.mark.parametrize("percent", [50, 80, 85, 97])
def test_sent_hashes_hold_what_every_partner_needs(percent):
    for n in range(1, 150):
        for k in range(n, 150):
            for common in range(1, n + 1):
                if 100 * common >= percent * (n + k - common):
                    # the worst order: this set's own hashes come first
                    for a, b in ((n, k), (k, n)):
                        need = min(a, 2 * int(ngram_join._missing(a, percent)) + 1) - int(ngram_join._missing(a, percent))
                        assert min(common, ngram_join._sent(b, percent) - (b - common)) >= need
                        assert min(common, ngram_join._sent(a, percent) - (a - common)) >= need
                    break


def test_signature_tree_keeps_every_similar_pair():
    dice = np.random.default_rng(4)
    base = [set(dice.integers(0, 5000, 200).tolist()) for _ in range(12)]
    sets = [b if k == 0 else (set(list(b)[:-k]) | {9000 + k}) for b in base for k in range(6)]
    arrays = [np.sort(np.array(list(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    order = np.argsort([len(s) for s in arrays], kind="stable")
    bits = np.stack([ngram_join._bitmap(arrays[i]) for i in order])
    x, y = ngram_join.SignatureTree(bits, np.array([len(arrays[i]) for i in order]), np.arange(len(order))).pairs(85)
    got = {tuple(sorted((order[a], order[b]))) for a, b in zip(x, y)}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7), (200, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100, 7: 0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in hit) >= 0.8 * sum(r["toxic"] for r in rows) and sum(r["toxic"] for r in hit) >= 0.85 * len(hit)


def test_toxicity_edges(docs, none):
    labels = docs.select("doc_id", (F.col("doc_id") == 54).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["score"] == got[1]["score"]
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert {"lang", "predicted"} <= set(toxicity.annotate(docs, labels).columns)


def test_block_max_search_equals_a_full_one():
    dice = np.random.default_rng(6)
    examples = {}
    for _ in range(700):
        terms = np.sort(dice.choice(60, dice.integers(1, 6), replace=False))
        examples[tuple(zip(terms.tolist(), dice.integers(1, 4, len(terms)).tolist()))] = [1.0, float(dice.integers(0, 2))]
    index = toxicity.Index(examples, dice.random(60) + 1, [5.0, 1.0])
    dense = np.zeros((len(index.votes), 60))
    for i, row in enumerate(sorted(examples)):
        t, w = index.unit(np.array([a for a, _ in row]), np.array([b for _, b in row]))
        dense[i, t] = w
    for _ in range(50):
        terms = np.sort(dice.choice(60, 4, replace=False))
        counts = dice.integers(1, 4, 4)
        rows, cos = index.nearest(terms, counts)
        t, w = index.unit(terms, counts)
        full = dense[:, t] @ w
        want = np.lexsort((np.arange(len(full)), -np.round(full, 9)))[:15]
        assert rows.tolist() == [i for i in want if full[i] > 0] and np.allclose(cos, full[rows])


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in p.STAGES]
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept[names[0]]) == {d for d, r in rows.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [d for d in kept[names[0]] if labels.get(d) == 0]
    assert sum(d in kept[names[1]] for d in clean) > 0.9 * len(clean)
    groups = brute_join(list(kept[names[1]].items()), 5, 80)
    assert set(kept[names[2]]) == {d for d, (_, c) in groups.items() if c == d}
    brute = brute_substring(kept[names[2]].items())
    assert {d: kept_sha(t) for d, t in kept[names[3]].items()} == {d: s for d, (n, gone, s) in brute.items() if gone == 0 or gone < n}
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept[names[3]])
    assert p.run(spark, sf).count() == packed.count()


def tables(spark, folder, docs, schema, labels):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, ambiguous boolean, predicted int, n_removed long, __doc long, spans string"


def test_pipeline_of_nulls_repeats_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p

    dice = random.Random(4)
    word = lambda: "".join(dice.choice(["ba", "ke", "li", "mo"]) for _ in range(3))
    long = " ".join(word() for _ in range(80))
    extra = (0.5, "x", True, 7, 3, 9, "s")
    rows = [(i, " ".join(word() for _ in range(40)), "en" if i % 2 else "de", None, 3, *extra) for i in range(12)]
    rows += [(20, long, "en", "s", 4, *extra), (21, long, "en", "s", 4, *extra), (21, long, "en", "s", 4, *extra), (None, "no id " + long, None, None, None, *extra), (None, None, None, None, None, *extra), (30, "", "en", "s", 0, *extra), (31, " \n ", "en", "s", 0, *extra)]
    sf = tables(spark, tmp_path, rows, CLASHING, [(1, 1, 0), (1, 1, 0), (None, 0, 1), (3, None, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.select("score", "lang_pred", "ambiguous", "predicted", "n_removed", "__doc", "spans").distinct().collect() == [extra]
        docs = after
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.collect())
    assert [g[1] for g in got if not g[0]] == [*range(12), 20] and [g[2] for g in got if g[0]] == ["no id "]
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == {*range(12), 20, None}


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_pipeline_of_empty_tables(spark, tmp_path, labels):
    import corpus_pipeline as p

    sf = tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long", labels)
    assert p.run(spark, sf).count() == 0


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, f"some words of a text {i} that is short", "en", "s", 1) for i in range(6)]
    sf = tables(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long", [])
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == set(range(6))


def letters(text):
    out, now = [], b""
    for b in (text or "").encode() + b" ":
        if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128:
            now += bytes([b + 32 if b <= 90 else b])
        elif now:
            out.append(now)
            now = b""
    return out


def toxic_terms(text):
    """Words and their beginnings of 4 to 9 bytes, counted."""
    found = Counter()
    for w in letters(text):
        found[(0, w)] += 1
        for n in range(4, 10):
            if len(w) > n:
                found[(n, w[:n])] += 1
    return found


def test_toxicity_scores_equal_brute_force(spark):
    dice = random.Random(7)
    plain = ["river", "mountain", "paper", "window", "garden", "sunlight"]
    docs = []
    for i in range(120):
        text = [dice.choice(plain) for _ in range(12)]
        if i % 4 == 1:
            text += [dice.choice(["scumbag", "moron"])] * dice.randint(1, 2)
        if i % 4 == 3 and i % 3 == 0:
            text += ["scumbag"]
        docs.append((i, " ".join(text) if i != 50 else None))
    docs += [(None, "scumbag moron"), (7, "repeated id moron")]
    labels = [(i, int(i % 4 == 1)) for i in range(0, 120)] + [(5, 1), (5, 1), (None, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    _, index, _ = toxicity.fit(df, lab)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 4 == 2
    train = [(text, y) for d, y in labels if not held(d) for x, text in docs if x == d]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    ones, zeros = Counter(), Counter()
    for text, y in train:
        (ones if y else zeros).update(set(toxic_terms(text)))
    vocab = set()
    for t, a in ones.items():
        b = zeros[t]
        chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * max(1, n1 + n0 - a - b))
        if a >= 3 and a / n1 > 4 * b / n0 and chi > 8:
            vocab.add(t)
    df_of = Counter(t for _, text in docs for t in set(toxic_terms(text)) if t in vocab)
    idf = {t: np.log((1 + len(docs)) / (1 + df_of[t])) + 1 for t in vocab}

    def vector(text):
        w = {t: (1 + np.log(n)) * idf[t] for t, n in toxic_terms(text).items() if t in vocab}
        size = np.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()}

    votes = defaultdict(lambda: [0, 0])
    for text, y in train:
        votes[tuple(sorted(vector(text).items()))][y] += 1
    prior = votes.pop((), [0, 0])
    assert 1 < len(votes) <= toxicity.NEIGHBOURS and len(vocab) > 4
    total = np.sum(list(votes.values()), 0) + prior
    base = (total[1] + 1e-3) / (sum(total) + 1)
    for r, (_, text) in zip(toxicity.score(df, lab).collect(), docs):
        v = vector(text)
        if not v:
            want = (prior[1] + 0.5 * base) / (sum(prior) + 0.5)
        else:
            near = [(sum(v[t] * x for t, x in row if t in v), n) for row, n in votes.items()]
            near = [(c, n) for c, n in near if c > 0]
            s = (sum(n[1] * min(c, 1.0) ** 8 for c, n in near) + 0.3 * base) / (sum(sum(n) * min(c, 1.0) ** 8 for c, n in near) + 0.3)
            s = min(1 - 1e-6, max(1e-6, s))
            want = 1 / (1 + np.exp(-(index.slope * np.log(s / (1 - s)) + index.shift))) if near else base
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def best_fit(lengths, room):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b + n <= room]
        if fits:
            bins.remove(max(fits))
            bins.append(max(fits) + n)
        else:
            bins.append(n)
    return len(bins)


def fewest_bins(lengths, room):
    """By trying all places of each length, the largest first."""
    lengths = sorted(lengths, reverse=True)

    def fits(k):
        rooms, seen = [room] * k, set()

        def put(i):
            if i == len(lengths):
                return True
            state = (i, tuple(sorted(rooms)))
            if state in seen:
                return False
            seen.add(state)
            for r in set(rooms):
                if r >= lengths[i]:
                    j = rooms.index(r)
                    rooms[j] -= lengths[i]
                    if put(i + 1):
                        return True
                    rooms[j] += lengths[i]
            return False

        return put(0)

    return next(k for k in range(-(-sum(lengths) // room), len(lengths) + 1) if fits(k))


def test_bins_are_never_more_than_best_fit():
    for seed in range(1_000):
        dice = random.Random(seed)
        lengths = [dice.randint(20, 60) for _ in range(dice.randint(6, 40))]
        assert sum(k for _, k in packing.complete_bins(dict(Counter(lengths)), 100)) <= best_fit(lengths, 100)


def test_bins_of_few_pieces_are_the_fewest():
    for seed in range(200):
        dice = random.Random(seed)
        lengths = [dice.randint(5, 60) for _ in range(dice.randint(2, 20))]
        assert sum(k for _, k in packing.complete_bins(dict(Counter(lengths)), 100)) == fewest_bins(lengths, 100)


def test_packing_of_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c", 1, 2), (None, "a b c", 1, 2), (4, "a b c", 1, 2), (4, "a b c", 1, 2), (5, None, 1, 2)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, length int, part int"), BPE).collect()
    assert len(got) == 5 and len({(r["sequence_id"], r["offset"]) for r in got}) == 5


def test_ngram_join_of_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(9, text, 1), (9, text, 1), (None, text, 1), (None, text, 1), (12, text.upper(), 1), (3, None, 1), (None, "alone in this text here", 1)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string, shared int")).collect())
    assert got == [(0, 2, 0), (0, 4, 9), (0, 4, 9), (3, 0, 3), (9, 4, 9), (9, 4, 9), (12, 4, 9)]


def test_chat_of_very_long_texts_and_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} ###") for t in range(3_000)] + [(2, 0, "assistant", "### </turn> x " * 40_000)]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["n_turns"] == 3_000 and got[2]["loss_chars"] == 14 * 40_000 and got[2]["loss_sha256"] == sha("### </turn> x " * 40_000)
