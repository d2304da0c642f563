"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. One map over whole texts gives each document's number of shingles, a digest of its shingle set and a b-bit
   MinHash signature: SYMBOLS minima of BITS bits each.  Documents with equal sets form a class, held from here on by
   its least id; copies are never compared.
2. Signatures are split into CHUNKS chunks.  By pigeonhole, signatures that differ in at most
   2 * CHUNKS - 1 symbols agree in some chunk up to one symbol.  Each allowed error is enumerated: a chunk gives one
   key for each symbol left out.  Pairs that differ in more symbols may share one too, and are kept if they do.
3. Each class is compared with the least class of each of its keys, on full shingle sets, and linked classes are
   joined into components.  This settles groups of copies with as many comparisons as there are members.
4. Keys whose members lie in several components are looked through completely, in blocks of MEMBERS: each pair of
   a key's blocks is a task of its own, which sees ids, signatures and longer sketches (about 250 bytes a class), never
   sets.  It tells which members have a candidate: one of another component whose signature and sketch agree in
   LEAST_SYMBOLS and LEAST_AGREED places, and whose first shared key this is.  The sets of these members alone are
   fetched and compared, again a pair of blocks in a task, which gives just as many links as join their components.
5. Components of all links; the class membership is joined back on the set digest.

A link is lost with a chance of about 1.3e-6 at a similarity of 0.8, and less above: 1.1e-6 for sharing no key, the rest for
signatures and sketches.  Links themselves are exact.  A key of m classes in different components costs m * m / MEMBERS rows
of 250 bytes, whatever the lengths of texts; keys whose classes are in one component cost nothing in step 4.

Full sets are made again from the texts for classes that share a key, never for all documents.

Defined cases: documents without words (or a null text) have no shingles and are components of their own; fewer
words than a shingle has form one shingle; equal rows belong to one component; rows that share a doc_id count
with each of their texts, and get the component of the least id reachable from their own text; rows with a null
doc_id get null component_id and kept; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, distinct, groups, grown, kept, mix, stored, texts, trimmed
from granary.llm.components import components

CHUNKS, WIDTH, BITS = 8, 4, 16
SYMBOLS = CHUNKS * WIDTH
#: Signatures that differ in no more symbols than this share a key for sure; others may.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Classes whose ids may be broadcast (some 50 bytes each), which spares the texts a shuffle; more are joined by one.
MAX_WANTED = 500_000
#: Members of a key's block in step 4.
MEMBERS = 1024
_RNG = np.random.default_rng(20240229)
#: Places of the longer sketches (8 bits each), and how many must agree: a pair of similarity 0.8 agrees in fewer with a
#: chance of about 1e-7.
LONG, LEAST_AGREED = 128, 78
#: Likewise for the signatures' symbols (about 3e-8).
LEAST_SYMBOLS = 12
_A = _RNG.integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, LONG, dtype=np.uint64)
SKETCH = "doc_id long, n long, digest binary, sig binary"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of texts, A-Z lower-cased."""

    def __init__(self, n: int) -> None:
        self.n, self.words, self.hashes, self.used = n, Words(), np.zeros(1 << 14, np.uint64), 0

    def sets(self, bodies: list[bytes]) -> list[np.ndarray]:
        if self.words.full():
            self.hashes = self.hashes[self.words.evict()]
            self.used = len(self.hashes)
        each = self.words.ids([b.lower() for b in bodies])
        fresh, self.words.fresh = self.words.fresh, []
        if fresh:
            raw = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in fresh)
            self.hashes = grown(self.hashes, self.used, np.frombuffer(raw, np.uint64))
            self.used += len(fresh)
        self.words.count(np.concatenate([x for x in each] or [np.zeros(0, np.int32)]))
        return [self._set(self.hashes[x]) for x in each]

    def _set(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        size = min(self.n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
        return distinct(out)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], size: int = SYMBOLS) -> np.ndarray:
    """The b-bit MinHash of each non-empty set: (sets, size) of 16 bits."""
    if not sets:
        return np.zeros((0, size), np.uint16)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), size), np.uint16)
    for k in range(size):
        least = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
        out[:, k] = mix(least) >> np.uint64(64 - BITS)
    return out


def sketched(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        shingler = kept(("neardup", n), lambda: Shingler(n))
        for ids, bodies in groups(batches, 1 << 20):
            sets = shingler.sets(bodies)
            some = [i for i, s in enumerate(sets) if len(s)]
            sigs: list = [None] * len(sets)
            for i, sig in zip(some, signatures([sets[i] for i in some])):
                sigs[i] = sig.tobytes()
            digests = [digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=SKETCH_ARROW)

    return texts(docs, id_col, text_col).mapInArrow(run, SKETCH)


def key_parts(sigs: np.ndarray) -> np.ndarray:
    """(signatures, CHUNKS * WIDTH) keys: for each chunk and each symbol left out, the other symbols and the place."""
    parts = sigs.reshape(len(sigs), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, WIDTH), np.uint64)
    for w in range(WIDTH):
        key = np.zeros((len(sigs), CHUNKS), np.uint64)
        for j in range(WIDTH):
            if j != w:
                key = key << np.uint64(BITS) | parts[:, :, j]
        out[:, :, w] = key
    place = np.arange(CHUNKS * WIDTH, dtype=np.uint64).reshape(CHUNKS, WIDTH)
    return mix(out + (place << np.uint64(48))).reshape(len(sigs), -1)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id) for every key of every class."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = key_parts(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], schema=schema)

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose longer sketches agree in at least LEAST_AGREED places: spares most full sets' way."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("long").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("long").alias("y")), "b").select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in trimmed(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, LONG) for i in (2, 3))
            keep = np.flatnonzero((x == y).sum(axis=1) >= LEAST_AGREED)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_numpy(zero_copy_only=False)[keep]) for i in (0, 1)], schema=schema)

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y") - common).alias("u")).where(100 * F.col("c") >= percent * F.col("u")).select("a", "b")


def agreed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each sketch of x agrees with each of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(x.shape[1]):
        out += x[:, k, None] == y[None, :, k]
    return out


def candidates(p: np.ndarray, q: np.ndarray, sig: np.ndarray, long: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a member of p and one of q whose labels differ, whose sizes allow the similarity, and whose signatures and
    longer sketches agree in enough places."""
    found = []
    for a in range(0, len(p), 128):
        some = p[a : a + 128]
        small, large = np.minimum(n[some][:, None], n[q]), np.maximum(n[some][:, None], n[q])
        fit = (label[some][:, None] != label[q]) & (100 * small >= percent * large)
        if fit.any():
            i, j = np.nonzero(fit & (agreed(sig[some], sig[q]) >= LEAST_SYMBOLS))
            i, j = some[i], q[j]
            near = np.concatenate([np.zeros(0, bool), *((long[i[k : k + 50_000]] == long[j[k : k + 50_000]]).sum(axis=1) >= LEAST_AGREED for k in range(0, len(i), 50_000))])
            found.append((i[near], j[near]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def sketches(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint8).reshape(-1, LONG)
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS), long


def block_members(rows: DataFrame, percent: int) -> DataFrame:
    """Step 4, first look at a pair of a key's blocks: rows (key, low, high, block, id, label, n, sig, long), two blocks at
    most; those of them that have a candidate there whose first shared key is this one: (key, low, high, id)."""
    schema = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("id", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        block, ids, label, n = (table.column(c).to_numpy() for c in ("block", "id", "label", "n"))
        if label.min() == label.max():
            return schema.empty_table()
        low, high, key = (table.column(c)[0].as_py() for c in ("low", "high", "key"))
        sig, long = sketches(table)
        i, j = candidates(np.flatnonzero(block == low), np.flatnonzero(block == high), sig, long, n, label, percent)
        keys = key_parts(sig).view(np.int64)
        mine = np.zeros(len(ids), bool)
        for k in range(0, len(i), 50_000):  # a pair's first shared key alone brings it out
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            first = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == key
            mine[x[first]] = mine[y[first]] = True
        some = ids[mine]
        return pa.Table.from_arrays([pa.array(np.full(len(some), v), f.type) for v, f in zip((key, low, high), schema)] + [pa.array(some)], schema=schema)

    return rows.groupBy("key", "low", "high").applyInArrow(run, "key long, low int, high int, id long")


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Step 4, second look: rows (key, low, high, id, label, n, sig, long, shingles) of those members; exact links (a, b) that
    join their labels, one fewer than the labels that come together: more would tell nothing new."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, label, n = (table.column(c).to_numpy() for c in ("id", "label", "n"))
        all_ = np.arange(len(ids))
        sig, long = sketches(table)
        i, j = candidates(all_, all_, sig, long, n, label, percent)
        i, j = i[i < j], j[i < j]
        flat = np.concatenate([s.values.to_numpy() for s in table.column("shingles")])
        _, code = np.unique(flat, return_inverse=True)
        start = np.cumsum(n) - n
        held = np.zeros(len(flat), bool)
        _, root = np.unique(label, return_inverse=True)
        out: list[tuple[int, int]] = []
        edges = np.searchsorted(i, np.arange(len(ids) + 1)) if (np.diff(i) >= 0).all() else None
        if edges is None:
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            edges = np.searchsorted(i, np.arange(len(ids) + 1))
        for x in np.unique(i).tolist():
            own = code[start[x] : start[x] + n[x]]
            held[own] = True
            for a in range(edges[x], edges[x + 1], 256):
                ys = j[a : min(a + 256, edges[x + 1])]
                ys = ys[root[ys] != root[x]]
                if not len(ys):
                    continue
                total = np.cumsum(n[ys])
                places = np.arange(total[-1]) + np.repeat(start[ys] - total + n[ys], n[ys])
                common = np.add.reduceat(held[code[places]].astype(np.int64), total - n[ys])
                for y in ys[100 * common >= percent * (n[x] + n[ys] - common)].tolist():
                    if root[y] != root[x]:
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                        root[root == root[y]] = root[x]
            held[own] = False
        return pa.Table.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def dealt(rows: DataFrame) -> DataFrame:
    """rows of keys, with block, for each pair (low, high) of the key's blocks that theirs is in."""
    blocks = F.ceil(F.col("members") / MEMBERS).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "label", "n", "sig", "long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketch = stored(sketched(docs, n, id_col, text_col), "sketch")
    return resolved(sketch, docs, n, percent, id_col, text_col)


def resolved(sketch: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    real = sketch.where("n > 0 AND doc_id IS NOT NULL")
    # an id with several texts is linked to itself through a class of each
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    keys = keyed(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("rep")).where("members > 1")
    held = stored(keys.join(shared, "key"), "keys")
    wanted = held.select("id").distinct()
    # sets of the classes that share a key; a class's text is that of any row with its digest
    few = stored(classes.join(wanted, "id").select(F.col("id").alias("doc_id"), "digest"), "wanted")
    again = texts(docs, id_col, text_col).join(F.broadcast(few) if few.count() <= MAX_WANTED else few, "doc_id")
    sets = stored(shingled(again, n), "sets")

    stars = held.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    first = stored(linked(alike(stars, sets), sets, percent), "links")
    roots = components(first)
    members = held.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "members", F.coalesce("root", "id").alias("label"))
    open_keys = members.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    rest = stored(members.join(open_keys, "key", "left_semi"), "open")
    about = classes.select("id", "n", "sig").join(sets.select("id", "long"), "id").join(rest.select("id").distinct(), "id")
    met = stored(block_members(dealt(rest.join(about, "id")), percent), "met")
    label_of = rest.select("id", "label").distinct()
    looked = met.join(label_of, "id").join(classes.select("id", "n", "sig"), "id").join(sets, "id").select("key", "low", "high", "id", "label", "n", "sig", "long", "shingles")
    more = block_links(looked, percent)
    both = first.unionByName(more).unionByName(same_ids(real, classes))
    final = components(both)

    named = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    # documents without shingles have no class and don't take part in the join
    some = sketch.where("n > 0").select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", "n", "root")
    whole = some.unionByName(sketch.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("root")))
    component = F.coalesce("root", "doc_id")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def same_ids(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id but not a text (none where ids are unique)."""
    twice = real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    ends = real.join(twice, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest")
    return ends.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def shingled(rows: DataFrame, n: int) -> DataFrame:
    """(id, shingles, long): full sets and longer sketches of those rows (doc_id, body, digest) whose set has the digest."""
    kind = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("shingles", kind), ("long", pa.binary())])

    def run(batches):
        shingler = kept(("neardup", n), lambda: Shingler(n))
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = shingler.sets(part.column(1).to_pylist())
                wanted = part.column(2).to_pylist()
                keep = [i for i, s in enumerate(sets) if len(s) and digest(s) == wanted[i]]
                ids = part.column(0).to_pylist()
                longs = [x.tobytes() for x in signatures([sets[i] for i in keep], LONG).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([sets[i].view(np.int64) for i in keep], kind), pa.array(longs, pa.binary())], schema=schema)

    return rows.select("doc_id", "body", "digest").mapInArrow(run, "id long, shingles array<long>, long binary")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, columns and types as they were: of each component the row with the least id
    (one row, where rows repeat an id). Rows without a doc_id are kept."""
    found = stored(near_duplicates(docs, n, percent, id_col, text_col), "found")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    if gone.count() <= MAX_WANTED:  # else the texts are joined by a shuffle
        gone = F.broadcast(gone)
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if twice.take(1):
        once = out.join(twice, F.col(id_col).cast("long") == F.col("__twice"), "left_anti")
        again = out.join(twice, F.col(id_col).cast("long") == F.col("__twice"), "left_semi").dropDuplicates([id_col])
        out = once.unionByName(again)
    return out
