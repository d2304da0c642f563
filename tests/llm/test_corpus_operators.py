"""Near-duplicates, search, quality, language-model scores and the pipeline against plain versions and edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import common, components, lm_score, neardup, quality, queries, topk

DATA = "/root/testdata/sf0.001"


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent=80):
    """component of each id by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.integers(0, len(w))] = f"e{rng.integers(0, 10**6)}"
    return " ".join(w)


def corpus(seed=0, groups=12, members=8):
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = [f"w{g}x{rng.integers(0, 500)}" for _ in range(int(rng.integers(5, 90)))]
        for m in range(members):
            texts.append(edited(rng, base, int(rng.integers(0, 4))))
    chain = [f"c{i}" for i in range(80)]
    for _ in range(10):  # a chain whose ends aren't alike
        chain = chain[4:] + [f"n{rng.integers(0, 10**9)}" for _ in range(4)]
        texts.append(" ".join(chain))
    texts += ["", None, "   ", "a b", "A  B", "b a", "one", texts[0].upper(), texts[0]]
    return [(int(i), texts[k]) for k, i in enumerate(rng.permutation(len(texts)))]


@pytest.mark.parametrize("n, members", [(4, 256), (5, 3)])
def test_components_by_brute_force(spark, monkeypatch, n, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)  # small blocks take the way of large keys
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, n).collect()}
    want = brute_components(rows, n)
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_shingles == len(shingles(t, n)) and got[i].kept == (want[i] == i)


def test_loose_group_with_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 9)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == brute_components(rows, 4)


def test_signatures_share_a_key_within_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        b[k, rng.permutation(neardup.SYMBOLS)[: neardup.MAX_DISTANCE]] ^= 1
    assert (neardup.key_parts(a) == neardup.key_parts(b)).any(axis=1).all()


def test_near_duplicate_edge_cases(spark):
    rows = [(1, "x y z q r s"), (1, "other text that is not alike at all"), (2, "x y z q r s"), (7, "other text that is not alike at all"), (None, "x y z q r s"), (5, "x y z q r s"), (5, "x y z q r s")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (7, 1, False), (None, None, None), (5, 1, False), (5, 1, False)], key=str)
    kept = neardup.deduplicated(docs, 4).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and "component_id" in kept[0].asDict()
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {105: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 32)
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(300, 12)) / 4, np.zeros((3, 12)), -np.abs(rng.normal(size=(20, 12)))])
    vectors[5] = vectors[55] = vectors[105]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, [0.5] * 12), (1200, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.nearest(df).collect()}
    v = np.floor(256 * vectors).astype(int)
    want = {}
    for q in range(0, len(v), 50):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(order)}
    assert got == want
    for tile in (1 << 16, 60):
        small = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 50 = 0"), block=2, tile=tile).collect()}
        assert {k: v for k, v in small.items() if k[0] != 1200} == want
    two = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.nearest(two).collect()] == [(0, 1, 1)]
    assert topk.nearest(two.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 2e4, 1e6, 1e9, 1e15])
def test_top_k_of_any_components(spark, size):
    rng = np.random.default_rng(8)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(120, 6)) * size]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.nearest(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    v = [[math.floor(256 * x) for x in row] for row in vectors]
    for q in range(0, 120, 50):
        order = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(120) if i != q)[:5]
        for k, (s, i) in enumerate(order):
            assert got[q, k + 1][1] == max(-(1 << 63), min((1 << 63) - 1, -s)) and (abs(s) >= 1 << 63 or got[q, k + 1][0] == i)


def test_quality_held_out(spark):
    rng = np.random.default_rng(6)
    pool = ["tha", "ing", "wer", "and", "on", "re"]
    word = lambda: "".join(rng.choice(pool, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = [word() for _ in range(30)] if good else [x.upper() + "!!" for x in [word()] * 30]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (5, "again"), (None, "no id")]
    labels += [(None, 1, 0), (7, None, 0), (12345, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.qualities(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5]
    assert np.mean(right) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    # labels of held-out rows don't matter
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    other = quality.qualities(docs, marks.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert {(r.doc_id, r.score) for r in other.collect()} == {(r.doc_id, r.score) for r in out}
    assert {r.score for r in quality.qualities(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.qualities(docs.limit(0), marks).count() == 0


def test_context_vectors_by_plain_sums(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "The,", "a", "dog", "Cat!", "x1", "\u00e9t\u00e9", "..."], rng.integers(0, 40))) for _ in range(60)] + ["", None, "hot hot " * 500]
    want, counts = {}, Counter()
    for t in texts:
        cores = [quality.parts(w)[0] for w in (t or "").encode().split()]
        index = np.rint(2 * quality.index_vectors(quality.hashed(cores))).astype(int) if cores else []
        counts.update(cores)
        for i, w in enumerate(cores):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(cores):
                    want[w] = want.get(w, 0) + index[j]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (100, 1 << 20):
        got = {r.key: (r.n, np.frombuffer(r.sums, "<i8")) for r in quality.contexts(docs, share=share).collect()}
        assert len(got) == len(counts)
        for w, n in counts.items():
            n_got, sums = got[int(quality.hashed([w]).view(np.int64)[0])]
            assert n_got == n and (sums == want[w]).all()
    # the most frequent words have vectors, in whole steps of counts; others have their index vector
    few = quality.frequent(quality.contexts(docs), 3)
    assert 1 <= len(few.keys) <= 3 and int(quality.hashed([b"hot"])[0]) in few.keys.tolist()
    rare = quality.hashed([b"never seen"])
    assert np.allclose(few.of(rare), quality.index_vectors(rare)) and np.allclose(np.linalg.norm(few.of(few.keys), axis=1), 1, atol=1e-6)


class Caught(Exception):
    pass


class Rows:
    """Stands in for a table: hands over the function that tasks would run."""

    def agg(self, *columns):
        return self

    def first(self):
        return [20 << 20]

    def mapInArrow(self, run, schema):
        raise Caught(run)


def batches_of(texts):
    import pyarrow as pa

    return [pa.record_batch([pa.array(range(len(part)), pa.int64()), pa.array(part, pa.binary())], names=["doc_id", "body"]) for part in (texts[a : a + 500] for a in range(0, len(texts), 500))]


def test_context_sums_of_a_batch_take_little_memory(spark, monkeypatch):
    """A batch of 16 MB with as many distinct words as documents have."""
    import tracemalloc

    monkeypatch.setattr(quality, "texts", lambda *a: Rows())
    with pytest.raises(Caught) as caught:
        quality.contexts(None)
    rng = np.random.default_rng(12)
    words = [b"w%d" % i for i in range(400_000)]
    texts = [b" ".join(words[i] for i in (400_000 * rng.random(1200) ** 3).astype(int)) for _ in range(2000)]
    assert 15 << 20 < sum(map(len, texts)) < 17 << 20
    tracemalloc.start()
    sent = sum(1 for _ in caught.value.args[0](iter(batches_of(texts))))
    most = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert sent >= 3 and most < 250, f"{most} MB"


def test_context_sums_by_parts(spark, monkeypatch):
    """Parts of a batch and blocks of tokens change no sum; large sums keep their size."""
    monkeypatch.setattr(quality, "texts", lambda *a: Rows())
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(["the", "The,", "a", "dog", "Cat!", "..."], rng.integers(0, 40))).encode() for _ in range(300)]
    found = []
    for part, tokens, batch in ((2 << 20, 1 << 18, 16 << 20), (200, 7, 3000), (1, 1, 1)):
        for name, value in (("PART", part), ("TOKENS", tokens), ("BATCH", batch)):
            monkeypatch.setattr(quality, name, value)
        with pytest.raises(Caught) as caught:
            quality.contexts(None)
        total = {}
        for b in caught.value.args[0](iter(batches_of(texts))):
            for r in b.to_pylist():
                rows = np.column_stack([quality.unplanes(r["counts"]), quality.unplanes(r["sums"]).reshape(-1, quality.DIMS)])
                for key, row in zip(np.frombuffer(r["keys"], "<u8").tolist(), rows):
                    total[key] = total.get(key, 0) + row
        found.append({k: v.tolist() for k, v in total.items()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 5
    for x in ([], [0], [-1, 1, 127, -128, 128], [1 << 40, -(1 << 62), 5]):
        assert quality.unplanes(quality.planes(np.array(x, np.int64))).tolist() == x


def test_tokens_are_forgotten_and_learned_again():
    vectors = quality.Vectors(np.sort(quality.hashed([b"w1", b"w2"])), np.ones((2, quality.DIMS)))
    for coder in (quality.Tokens(), quality.Tokens(vectors)):
        coder.words.most = 20_000
        for k in range(4):
            words = [f"w{i}".encode() for i in range(15_000 * k, 15_000 * k + 30_000)]
            (ids,) = coder.ids([b" ".join(words)])
            assert (coder.keys[ids] == quality.hashed(words)).all()
            if coder.vectors:
                assert coder.rows.shape[0] >= coder.used


def test_quality_of_few_and_repeated_labels(spark):
    rows = [(i, ("fine calm words here " if i % 2 else "BAD!! LOUD!! ") * 5) for i in range(40)]
    docs = spark.createDataFrame(rows + [(1, "other text")] * 3, "doc_id long, text string")
    fold = {i: zlib.crc32(str(i).encode()) % 3 for i, _ in rows}
    nine = [i for i, _ in rows if fold[i] != 1][:9]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in nine] + [(nine[0], nine[0] % 2, 0)] * 500, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in quality.qualities(docs, labels).where("doc_id <> 1").collect()}
    assert np.mean([out[i] == i % 2 for i in out]) > 0.9
    two = quality.fit(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]))
    assert two.w1 is not None and two.temperature == 1.0


def test_language_model_base_and_order(spark):
    rng = np.random.default_rng(7)
    names = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(names[(k * k + i) % 40] if k % 3 else rng.choice(names) for k in range(int(rng.integers(0, 50))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Unseen WORDS only"), (None, "w1 w2"), (3, "w1 w2 w3"), (503, "é x w1\x0bw2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = lm_score.scores(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 for r in out)
    assert lm_score.scores(docs.limit(0)).count() == 0


def exact_scores(rows, trained=lambda i: True, order=3):
    """Scores by plain counts of all words and n-grams, quantised as the filter does."""
    q = lambda n: math.floor(math.log(n) / math.log(lm_score.BASE) + 1e-9) + 1 if n else 0
    low = lambda n: math.ceil(lm_score.BASE ** (q(n) - 1) - 1e-9) if n else 0
    high = lambda n: math.ceil(lm_score.BASE ** q(n) - 1e-9) - 1 if n else 0
    tokens = [(i, tuple((t or "").encode().lower().split() + [b" "])) for i, t in rows]
    c = Counter(x[k : k + n] for i, x in tokens if trained(i) for n in range(1, order + 1) for k in range(len(x) - n + 1))
    ones = [v for g, v in c.items() if len(g) == 1]
    total = sum(ones) + len(ones) + 1

    def p(history, w):
        shorter = p(history[1:], w) if history else None
        return (low(c[history + (w,)]) + lm_score.STRENGTH * shorter) / (high(c[history]) + lm_score.STRENGTH) if history else (low(c[(w,)]) + 1) / total

    vocabulary = [g[0] for g in c if len(g) == 1]
    return [sum(math.log10(min(1, p(x[max(0, k - order + 1) : k], x[k]))) for k in range(len(x))) for _, x in tokens], p, vocabulary


def lm_rows():
    rng = np.random.default_rng(9)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(names[int(x)] for x in np.minimum(rng.geometric(0.08, int(rng.integers(0, 60))), 59))) for i in range(200)]
    return rows + [(500, None), (501, ""), (502, "Unseen WORDS only"), (503, "\u00e9 x w1\x0bw2"), (504, "hot pair " * 3000), (3, rows[3][1])]


@pytest.mark.parametrize("order, share", [(1, 1 << 20), (2, 300), (3, 1 << 20), (3, 500), (4, 5000)])
def test_model_scores_by_plain_counts(spark, order, share):
    """Every word and n-gram has its own count, whatever the number of slices: in a filter without false positives the
    scores are those of plain counts."""
    rows, held = lm_rows(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_score.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, share, order, 400)
    got = sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm_score.score(docs, model).collect())
    want, p, vocabulary = exact_scores(rows, lambda i: not held(i), order)
    assert got == sorted((i, len((t or "").split()) + 1, round(s, 6)) for (i, t), s in zip(rows, want))
    for history in [(b"w1",), (b"w1", b"w2"), (b"hot", b"pair"), (b"new",)]:
        assert sum(p(history[-order + 1 :] if order > 1 else (), w) for w in vocabulary) <= 1 + 1e-9


class Steps(list):
    """Stands in for a table: notes the functions that tasks would run."""

    def mapInArrow(self, run, schema):
        self.append(run)
        return self

    applyInArrow = mapInArrow

    def select(self, *columns):
        return self

    where = groupBy = unionByName = select


def model_steps(monkeypatch, slice_bits, total, distinct):
    """The functions of the counting's and the scoring's tasks: count, add, ask, answer, finish."""
    from types import SimpleNamespace

    steps = Steps()
    monkeypatch.setattr(lm_score, "rows_of", lambda *a: steps)
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    lm_score.counted(steps, slice_bits, 3, 9)
    lm_score.score(None, SimpleNamespace(slice_bits=slice_bits, total=total, distinct=distinct, order=3, counts=None))
    return list(steps)


def by(column, messages):
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pa.Table.from_batches(messages) if isinstance(messages[0], pa.RecordBatch) else pa.concat_tables(messages)
    return [whole.filter(pc.equal(whole[column], k)) for k in pc.unique(whole[column]).to_pylist()]


def test_model_tasks_take_little_memory(spark, monkeypatch):
    """A batch of 16 MB with as many distinct words as documents have: tasks that count, that ask and that finish."""
    import tracemalloc

    rng = np.random.default_rng(12)
    words = [b"w%d" % i for i in range(400_000)]
    texts = [b" ".join(words[i] for i in (400_000 * rng.random(1200) ** 3).astype(int)) for _ in range(2000)]
    count, add, ask, answer, finish = model_steps(monkeypatch, 4, 10**7, 10**6)
    seen = []

    def watched(f):
        tracemalloc.start()
        out = f()
        seen.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
        return out

    sent = watched(lambda: list(count(iter(batches_of(texts)))))
    models = [add(t) for t in by("slice", sent)]
    asked = watched(lambda: list(ask(iter(batches_of(texts)))))
    answers = [answer(t) for t in by("slice", asked + [b for m in models for b in m.to_batches()])]
    out = watched(lambda: [finish(t) for t in by("batch", answers)])
    assert sum(t.num_rows for t in out) == 2000 and max(seen) < 200, f"{seen} MB"


def test_model_by_parts(spark, monkeypatch):
    """Parts of a batch and blocks of tokens change no score and no message's size."""
    texts = [(t or "").encode() for _, t in lm_rows()] + [b"x y " * 900, b""]
    found = []
    for part, block in ((2 << 20, 1 << 18), (300, 64), (1, 3)):
        monkeypatch.setattr(lm_score, "PART", part)
        monkeypatch.setattr(lm_score, "BLOCK", block)
        for bits in (0, 3):
            count, add, ask, answer, finish = model_steps(monkeypatch, bits, 10**4, 100)
            models = [add(t) for t in by("slice", list(count(iter(batches_of(texts)))))]
            sent = list(ask(iter(batches_of(texts)))) + [b for m in models for b in m.to_batches()]
            (out,) = [finish(t) for t in by("batch", [answer(t) for t in by("slice", sent)])]
            found.append((sum(b.nbytes for b in sent), out.to_pylist()))
    assert found[0] == found[2] == found[4] and found[1] == found[3] == found[5]
    for keys in ([], [[3, 5, 5 << 20], [], [5, (1 << 32) - 1]]):
        got = lm_score.level_of_sums([np.array(k, np.uint32) for k in keys], [np.full(len(k), 200, np.uint8) for k in keys])
        want = Counter(x for k in keys for x in k)
        assert got[0].tolist() == sorted(want) and got[1].tolist() == [int(lm_score.levels(np.array([200 * want[x]]))[0]) for x in sorted(want)]


def test_false_positives_are_few(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score(docs, lm_score.fit(docs, F.lit(True))).collect()}
    want, _, _ = exact_scores(rows)
    off = [abs(got[i, len((t or "").split()) + 1] - s) for (i, t), s in zip(rows, want)]
    assert np.median(off) < 0.2 and sum(off) < 0.02 * abs(sum(want))
    rng = np.random.default_rng(8)
    keys, n = rng.integers(0, 1 << 62, 20_000).astype(np.uint64), rng.integers(1, 5000, 20_000)
    held = lm_score.Filter.of(keys, lm_score.levels(n))
    got = held.read(keys)
    assert (got >= lm_score.levels(n)).all() and (got == lm_score.levels(n)).mean() > 0.96
    assert (held.read(keys + np.uint64(7)) == 0).mean() > 0.96


def test_tokens_are_the_words_between_white_space():
    rng = np.random.default_rng(2)
    pieces = ["a", "b\u00e9", "\x1c", "\u00a0", "\u3000", "\x00", " ", "\t", "\n", "\x0b", "\x0c", "\r", "zz"]
    bodies = ["".join(rng.choice(pieces, rng.integers(0, 12))).encode() for _ in range(500)] + [b"", b" ", b"x" * 3_000_000, b"y " * 1_000_000]
    for some in (bodies, bodies[:1], [b""], [b" a"]):
        words, numbers, sizes = common.tokens(some)
        want = [b.split() for b in some]
        assert [words[i] for i in numbers] == [w for x in want for w in x] and sizes.tolist() == list(map(len, want))
        assert len(words) == len(set(words)) == len({w for x in want for w in x})


def test_packed_codes_and_small_numbers():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5000):
        keys = common.distinct(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for bits in (0, 3):
            found = common.distinct(lm_score.codes(keys, bits))
            back = [np.uint64(s << 32) + lm_score.unpacked(lm_score.packed(found[a:b])) for s, a, b in zip(*lm_score.cuts(found))]
            assert (lm_score.together(back, np.uint64) == found).all() and all(0 <= s < 1 << bits for s in lm_score.cuts(found)[0])
        numbers = rng.integers(0, 600, size)
        assert (lm_score.unsmall(lm_score.small(numbers), size) == numbers).all()
    counts = np.arange(1, 5000)
    assert (lm_score.least(lm_score.levels(counts)) <= counts).all() and (counts <= lm_score.most(lm_score.levels(counts))).all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cur = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_pipeline_stages(spark):
    passage = " ".join(f"bench{i}" for i in range(12))
    good = " ".join(f"the word{i} ing" for i in range(60))
    near = good.replace("word7 ", "other ")
    rows = [(1, good, "en", "s", 1), (2, good, "en", "s", 1), (3, near, "en", "s", 1), (4, "12345 !!", "en", "s", 1), (5, None, None, None, None), (6, f"die {passage} und der text geht weiter mit mehr " + "wörtern der " * 10, "de", "s", 1), (7, "der schlüssel ist password = abcdef123 und mehr text", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    fn = dict(corpus_pipeline.STAGES)
    assert list(fn) == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]
    a = fn["language_id"](spark, docs, DATA)
    assert a.columns == docs.columns and sorted(r.doc_id for r in a.collect()) == [1, 2, 3, 6, 7]
    b = fn["near_duplicates"](spark, a, DATA)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == [1, 6, 7]
    from granary.llm import decontaminate, secrets

    c = decontaminate.cleaned(b, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert "bench3" not in {r.doc_id: r.text for r in c.collect()}[6]
    d = fn["secret_scan"](spark, c, DATA)
    assert d.columns == docs.columns and "[SECRET]" in {r.doc_id: r.text for r in d.collect()}[7]
    assert secrets.scan(d).where("n_assign > 0").count() == 0
    e = fn["packing"](spark, d, DATA)
    assert {r.doc_id for r in e.collect()} == {1, 6, 7}


def test_pipeline_runs_on_the_tables(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.select("sequence_id").distinct().count() == out.count()


def test_candidates_come_out_of_their_first_shared_key(spark):
    """Signatures that agree in 12 of 32 symbols are far enough; of several shared keys the first counts."""
    a = np.arange(neardup.SYMBOLS, dtype=np.uint16)
    b = a.copy()
    b[12:] += 1000
    long = bytes(range(neardup.LONG))
    other = b"\xff" * (neardup.LONG - neardup.LEAST_AGREED + 1) + long[neardup.LONG - neardup.LEAST_AGREED + 1 :]
    for which, ids in ((0, [1, 2]), (1, [])):
        key = int(neardup.key_parts(a[None]).view(np.int64)[0, which])
        rows = [(key, 0, 0, 0, 1, 1, 50, a.tobytes(), long), (key, 0, 0, 0, 2, 2, 50, b.tobytes(), long), (key, 0, 0, 0, 3, 3, 50, b.tobytes(), other), (key, 0, 0, 0, 5, 5, 99, a.tobytes(), long)]
        df = spark.createDataFrame(rows, "key long, low int, high int, block int, id long, label long, n long, sig binary, long binary")
        assert sorted(r.id for r in neardup.block_members(df, 80).collect()) == ids


def test_a_loose_group_gives_few_links(spark):
    """Of all the links in a group of near copies only those come out that join components."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 14)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = neardup.sketched(docs, 4, "doc_id", "text").toPandas()
    sets = neardup.Shingler(4).sets([t.encode() for _, t in rows])
    long = [x.astype(np.uint8).tobytes() for x in neardup.signatures(sets, neardup.LONG)]
    looked = spark.createDataFrame([(7, 0, 0, int(i), int(i), int(n), bytes(s), g, [int(v) for v in x.view(np.int64)]) for i, n, s, g, x in zip(sketch.doc_id, sketch.n, sketch.sig, long, sets)], "key long, low int, high int, id long, label long, n long, sig binary, long binary, shingles array<long>")
    links = neardup.block_links(looked, 80).collect()
    want = brute_components(rows, 4)
    assert len(links) == len(rows) - len(set(want.values()))
    assert {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == {i: c for i, c in want.items() if i != c}


def test_pairs_just_above_the_threshold_are_all_found(spark):
    """10,000 pairs of similarity 89 / 111, each of words of its own."""
    rows = [(2 * i + k, " ".join(f"p{i}w{j}" for j in range(11 * k, 103 + 11 * k))) for i in range(10_000) for k in (0, 1)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert out.where("component_id = doc_id - doc_id % 2").count() == 20_000


def test_boilerplate_in_many_documents(spark, monkeypatch):
    """Documents that share a third of their text and no more: keys with many members in different components."""
    from pyspark.sql import Row

    monkeypatch.setattr(neardup, "MEMBERS", 64)
    rng = np.random.default_rng(12)
    boilerplate = [f"b{j}" for j in range(60)]
    rows = []
    for i in range(500):
        own = [f"o{i}x{j}" for j in range(40)] if i % 10 else [f"o{i // 100}x{j}" for j in range(40)] + [f"y{rng.integers(0, 10**6)}" for _ in range(3)]
        rows.append((i, " ".join(boilerplate + own)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute_components(rows, 4)
    # a hot key: each class goes to the pairs of blocks that its own is in, no further
    monkeypatch.undo()
    hot = spark.range(5000).select(F.lit(7).alias("key"), "id", F.lit(5000).alias("members"), F.col("id").alias("label"), F.lit(9).alias("n"), F.lit(b"").alias("sig"), F.lit(b"").alias("long"))
    assert neardup.dealt(hot).count() == 5000 * 5 and neardup.dealt(hot).select("low", "high").distinct().count() == 15
    assert Row(low=0, high=0) in neardup.dealt(hot).select("low", "high").distinct().collect()
