"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

1. Random indexing over all documents: a word is the lower-cased text of a token up to its trailing symbols.  Its sparse
   ternary index vector follows by rule from a hash of the word; its context vector is the sum of the index vectors of
   its neighbours over the whole corpus.  Tasks add their own texts up, batch by batch, and send each slice of the hashes
   its words' counts and sums; slices grow in number with the table, and a frequent word costs a batch one entry.
2. A word's vector is made of its index vector and its context vector.  Those of the VOCABULARY most frequent words (a
   bound of the broadcast, about 15 MB) are broadcast; a rarer word, whose contexts say little, has its index vector
   alone, whatever the corpus' size.  A token adds vectors of its letter case and its trailing symbols.
3. A document is the pooled mean and spread of its tokens' vectors and the mean product of neighbours' vectors.
4. A two-layer numpy network is trained on at most SAMPLE labelled documents (a bounded sample, by hash of the id);
   a temperature fitted on a part held back from training calibrates its probabilities.
5. One map scores all whole texts with the broadcast vectors and network.

Defined cases: a null text counts as empty; texts without words get the pooled vector 0 and a score like any other;
different labels of one doc_id make several examples, repeated ones a single one, and of several texts of a labelled
doc_id one teaches; labels or ids that are null teach nothing; without both classes every score is the share of label
1, or 0.5 without labels; where the part that trains would lack a class, all of the sample trains and the temperature is
1; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, batch_of, distinct, groups, grown, kept, mix, squeezed, stored, texts, trimmed, unsqueezed

DIMS, NONZERO, WINDOW = 32, 4, 2
#: Words whose context vectors are broadcast, about 140 bytes each; bytes of text for each slice, and of a batch.
VOCABULARY, SHARE, BATCH = 100_000, 8 << 20, 16 << 20
#: Bytes of text whose words are listed at once, and tokens whose neighbours are added up at once: they bound a worker's
#: memory, and no result depends on them.
PART, TOKENS = 2 << 20, 1 << 18
HIDDEN, SAMPLE, EPOCHS, SEED = 24, 12_000, 40, 11


def hashed(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), "<u8")


def parts(word: bytes) -> tuple[bytes, bytes, bytes]:
    """A token's word, its letter case, and its trailing symbols."""
    text = word.decode("utf-8", "replace")
    n = len(text)
    while n and not (text[n - 1].isalnum() or text[n - 1] == "_"):
        n -= 1
    core = text[:n]
    shape = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3 if core.isdigit() else 4 if not core else 5
    return core.lower().encode("utf-8", "surrogatepass"), b"shape %d" % shape, b"tail " + text[n:].encode("utf-8", "surrogatepass")


def index_parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of index vectors, (keys, NONZERO): one in each part of the dimensions."""
    x, width = mix(keys), DIMS // NONZERO
    shifts = np.arange(NONZERO, dtype=np.uint64)
    places = (x[:, None] >> shifts * np.uint64(8)) % np.uint64(width) + shifts * np.uint64(width)
    return places.astype(np.int64), ((x[:, None] >> np.uint64(40) + shifts) & np.uint64(1)).astype(np.int64) * 2 - 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Unit index vectors."""
    places, signs = index_parts(keys)
    out = np.zeros((len(keys), DIMS))
    np.put_along_axis(out, places, signs / np.sqrt(NONZERO), axis=1)
    return out


class Vectors:
    """Vectors of frequent words by their sorted hashes."""

    def __init__(self, keys: np.ndarray, contexts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.name = keys[order], uuid.uuid4().hex
        self.rows = unit(index_vectors(self.keys) + unit(contexts[order].astype(np.float64))).astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = index_vectors(keys)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.rows[at[known]]
        return out


class Tokens:
    """What a worker knows of tokens: the hash of the word, and with vectors the sum of the token's vectors."""

    def __init__(self, vectors: Vectors | None = None) -> None:
        self.words, self.used, self.vectors = Words(), 0, vectors
        self.keys, self.rows = np.zeros(1 << 14, np.uint64), np.zeros((1 << 14, DIMS if vectors else 0), np.float32)

    def ids(self, bodies: list[bytes]) -> list[np.ndarray]:
        if self.words.full():
            keep = self.words.evict()
            self.keys, self.used = self.keys[keep], len(keep)
            self.rows = self.rows[keep] if self.vectors else self.rows
        each = self.words.ids(bodies)
        fresh, self.words.fresh = self.words.fresh, []
        for a in range(0, len(fresh), 20_000):
            core, shape, tail = zip(*map(parts, fresh[a : a + 20_000]))
            keys = hashed(list(core))
            self.keys = grown(self.keys, self.used, keys)
            if self.vectors:
                sides = dict.fromkeys(zip(shape, tail))  # few different ones
                sides = dict(zip(sides, range(len(sides))))
                beside = index_vectors(hashed([x for x, _ in sides])) + index_vectors(hashed([x for _, x in sides]))
                rows = self.vectors.of(keys) + beside[[sides[x] for x in zip(shape, tail)]]
                self.rows = grown(self.rows, self.used, rows.astype(np.float32))
            self.used += len(keys)
        self.words.count(np.concatenate(each))
        return each


class Batch:
    """The tokens of a batch of texts, taken up in parts, as numbers among the distinct words of their part."""

    def __init__(self) -> None:
        self.size, self.keys, self.words = 0, [], []

    def take(self, coder: Tokens, bodies: list[bytes]) -> None:
        flat = np.concatenate([y for x in coder.ids(bodies) for y in (x, np.full(WINDOW, -1, np.int32))])
        seen = distinct(flat[flat >= 0])
        keys, back = np.unique(coder.keys[seen], return_inverse=True)
        local = np.full(int(seen.max(initial=-1)) + 2, -1, np.int32)  # the last one is that of -1
        local[seen] = back
        self.size += sum(map(len, bodies)) + len(bodies)
        self.keys.append(keys)
        self.words.append(local[flat])

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct keys, the number among them of each token, with WINDOW times -1 behind each text)."""
        keys = distinct(np.concatenate(self.keys))
        for i, own in enumerate(self.keys):
            self.words[i] = np.append(np.searchsorted(keys, own), -1).astype(np.int32)[self.words[i]]
        return keys, np.concatenate(self.words)


def sums_of(keys: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, context sums) of words, given as in Batch.numbered(). No context crosses texts."""
    kind = np.int32 if 2 * WINDOW * len(word) < 1 << 31 else np.int64
    places, signs = np.zeros((NONZERO, len(keys)), np.uint8), np.zeros((NONZERO, len(keys)), np.int8)
    for a in range(0, len(keys), TOKENS):
        places[:, a : a + TOKENS], signs[:, a : a + TOKENS] = (x.T for x in index_parts(keys[a : a + TOKENS]))
    n, total = np.zeros(len(keys), np.int64), np.zeros(len(keys) * DIMS, kind)
    for at in range(0, len(word), TOKENS):
        here = word[at : at + TOKENS]
        n += np.bincount(here[here >= 0], minlength=len(keys))
        for shift in range(1, WINDOW + 1):
            b = word[at + shift : at + shift + TOKENS]
            a = here[: len(b)]
            both = (a >= 0) & (b >= 0)
            a, b = a[both].astype(np.int64), b[both].astype(np.int64)
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    np.add.at(total, x * DIMS + places[k, y], signs[k, y].astype(kind))
    return n, total.reshape(-1, DIMS)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, as many bytes as the largest needs, signs in the lowest bit: small ones compress well."""
    x = x.astype(np.int64)
    z = (x << 1 ^ x >> 63).astype("<u8")
    width = max(1, -(-int(z.max(initial=0)).bit_length() // 8))
    return squeezed(bytes([width]) + np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unplanes(raw: bytes) -> np.ndarray:
    raw = unsqueezed(raw)
    held = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    z = np.zeros((held.shape[1], 8), np.uint8)
    z[:, : raw[0]] = held.T
    z = z.view("<u8").ravel()
    return (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes, without a copy."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows[:1].nbytes)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(key long, n long, sums binary): count and context sums of every word of the whole corpus, in the shared folder."""
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.length("body") + 1), F.lit(0))).first()[0]
    slices = max(1, -(-size // share))
    schema = pa.schema([("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])
    words = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])

    def messages(batch: Batch):
        keys, word = batch.numbered()
        n, sums = sums_of(keys, word)
        at = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)  # keys are in order
        first = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(at))):
            yield pa.RecordBatch.from_pylist([{"slice": int(at[a]), "keys": keys[a:b].tobytes(), "counts": planes(n[a:b]), "sums": planes(sums[a:b].ravel())}], schema=schema)

    def run(batches):
        coder, batch = kept(("quality",), Tokens), Batch()
        for _, bodies in groups(batches, PART):
            batch.take(coder, bodies)
            if batch.size >= BATCH:
                yield from messages(batch)
                batch = Batch()
        if batch.size:
            yield from messages(batch)

    def add(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")]
        keys = distinct(np.concatenate(each))
        n, sums = np.zeros(len(keys), np.int64), np.zeros((len(keys), DIMS), "<i8")
        for own, counts, found in zip(each, table.column("counts"), table.column("sums")):  # a message at a time
            at = np.searchsorted(keys, own)
            n[at] += unplanes(counts.as_py())
            sums[at] += unplanes(found.as_py()).reshape(-1, DIMS)
        cut = range(0, len(keys), 1 << 14)
        return pa.Table.from_batches([batch_of(words, keys[a : a + (1 << 14)].view(np.int64), n[a : a + (1 << 14)], binaries(sums[a : a + (1 << 14)])) for a in cut], words)

    sent = rows.mapInArrow(run, "slice int, keys binary, counts binary, sums binary")
    return stored(sent.groupBy("slice").applyInArrow(add, "key long, n long, sums binary"), "contexts")


def frequent(found: DataFrame, vocabulary: int = VOCABULARY) -> Vectors:
    """Vectors of the most frequent words: as many whole steps of counts as keep to vocabulary."""
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    sizes = sorted(found.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])  # some hundred at most
    total, least = 0, 1 << 30
    for r in sizes:
        total += r["count"]
        if total > vocabulary:
            break
        least = r["step"]
    rows = found.where(step >= least).select("key", "sums").toArrow()  # vocabulary rows at most
    sums = np.frombuffer(b"".join(rows.column("sums").to_pylist()), "<i8").reshape(-1, DIMS)
    return Vectors(rows.column("key").to_numpy().view(np.uint64), sums)


class Pooler:
    def __init__(self, vectors: Vectors) -> None:
        self.coder = kept(("quality", vectors.name), lambda: Tokens(vectors))

    def pooled(self, bodies: list[bytes]) -> np.ndarray:
        """(texts, 3 * DIMS + 1)."""
        each = self.coder.ids(bodies)
        rows = self.coder.rows
        out = np.zeros((len(bodies), 3 * DIMS + 1))
        for i, x in enumerate(each):
            if not len(x):
                continue
            n, total, square, product, last = len(x), np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS), None
            for a in range(0, n, 1 << 16):
                v = rows[x[a : a + (1 << 16)]]
                total += v.sum(axis=0, dtype=np.float64)
                square += np.einsum("ij,ij->j", v, v)
                product += np.einsum("ij,ij->j", v[:-1], v[1:])
                if last is not None:
                    product += last * v[0]
                last = v[-1]
            mean = total / n
            out[i] = np.concatenate([mean, np.sqrt(np.maximum(square / n - mean**2, 0)), product / max(1, n - 1), [np.log1p(n) / 10]])
        return out


class Network:
    """Two layers, with standardised inputs and a temperature; one constant probability if it can't be trained."""

    def __init__(self, constant: float = 0.5) -> None:
        self.constant, self.w1 = constant, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    net = Network(float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        return net
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if y[used].min() == y[used].max():
        held, used = order[:0], order
    net.mean, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    net.w1, net.b1 = rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN)
    net.w2, net.b2, net.temperature = rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), 0.0, 1.0
    z = (x - net.mean) / net.scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.float64(net.b2))]
    t = 0
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for a in range(0, len(used), 128):
            t += 1
            part = used[a : a + 128]
            h = np.tanh(z[part] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -500, 500)))
            d = (p - y[part]) / len(part)
            dh = d[:, None] * net.w2 * (1 - h**2)
            grads = (z[part].T @ dh + 1e-4 * net.w1, dh.sum(axis=0), h.T @ d + 1e-4 * net.w2, d.sum())
            new = []
            for value, grad, s in zip((net.w1, net.b1, net.w2, net.b2), grads, state):
                s[0] = 0.9 * s[0] + 0.1 * grad
                s[1] = 0.999 * s[1] + 0.001 * grad**2
                new.append(value - 0.01 * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = new
    if len(held):
        logits = net.logits(x[held])
        loss = lambda temp: np.mean(np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / temp))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def pooled_sample(labelled: DataFrame, vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of (doc_id, body, quality) rows."""
    held = labelled.sparkSession.sparkContext.broadcast(vectors)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        pooler = Pooler(held.value)
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                x = pooler.pooled([b.as_py() for b in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    rows = labelled.mapInArrow(run, "doc_id long, y int, x array<double>").collect()  # SAMPLE rows at most, some 800 bytes each
    rows = sorted((r.doc_id, r.y, tuple(r.x)) for r in rows)
    return np.array([r[2] for r in rows]).reshape(len(rows), 3 * DIMS + 1), np.array([r[1] for r in rows], np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Vectors, Network]:
    """Word vectors of all docs, and a network fitted on those of the labelled rows with the least hash of the id."""
    vectors = frequent(contexts(docs))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("y")).distinct()
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / max(1, n))))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # drawn: sample rows at most; of a doc_id with several texts the least one
    rows = stored(texts(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("body").alias("body")).select("doc_id", "body", "y"), "sample")
    return vectors, fit(*pooled_sample(rows, vectors))


def score(docs: DataFrame, vectors: Vectors, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        vectors, net = held.value
        pooler = Pooler(vectors)
        for ids, bodies in groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(net.scores(pooler.pooled(bodies)))], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; labels of held-out ids (CRC-32, remainder 1 of 3) teach nothing."""
    out_of = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    vectors, net = train(docs, labels.where(~out_of(F.col("doc_id"))))
    return score(docs, vectors, net).select("doc_id", out_of(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
