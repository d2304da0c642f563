"""Language-model scores from a log-frequency Bloom filter.

Counting.  Words (with text ends) and n-grams up to ORDER of the training rows are counted by tasks, batch by batch, under
64-bit hashes.  Every hash belongs to one of a number of slices that grows with the table (SHARE bytes of text each, or down
to half of it, as the number is a power of two).  A batch sends each slice its distinct hashes, as differences, and their
counts; the slice adds them up, so a frequent
word or n-gram costs a batch one entry, and no task sees more than a slice.  Exact counts c of all words, their sum N and
their number V come from there.

The filter.  All words and n-grams are entered in their slice's filter, those seen once too.  A count c is quantised
to the level q(c) = 1 + floor(log_b c), and the n-gram is entered once for each level from 1 to q(c), so a count is read
by probing levels until one is missing.  A slice's filter has the same number of bits for each entry: nothing is left out.

Probability.  A level promises a count of at least least(l) and at most most(l).  With the strength K,
    p(w)     = (least(w) + 1) / (N + V + 1),
    p(w | h) = (least(h w) + K p(w | h')) / (most(h) + K),    h' being h without its first word,
which sums to 1 at most over words, as the counts of h w sum up to that of h at most, but for the filter's false positives
(some per cent of what is not there).  An unseen history leaves p(w | h').

Scoring.  A batch of texts asks each slice for the counts of its distinct words and the levels of its distinct words
and n-grams; the answers meet the batch's token numbers again by the batch's own number.  Nothing is broadcast or
gathered on the driver but N and V.

Base.  Sums of log10((c + 1) / (N + V + 1)) take the exact counts.  Two of a billion words share their 64-bit hash with a
chance of some per cent; the n-grams of a slice, some million, are told apart by 32 bits, so that one in some thousand that
is not there takes another's level, less than by the filter itself.

Defined cases: a null text counts as empty (one token, its end); rows of a null doc_id are training rows; repeated
rows train each on its own and get equal scores; without training rows N = V = 0 and every c is 0; other columns
are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import distinct, groups, let_go, mix, small_batches, squeezed, stored, tokens, unsqueezed

#: Bytes of text for each slice, of a training batch and of a batch that is scored.
SHARE, TRAIN_BYTES, SCORE_BYTES = 8 << 20, 16 << 20, 16 << 20
#: Bytes of text whose words are listed at once, and tokens or keys that are worked on at once: they bound a worker's
#: memory, and no result depends on them.
PART, BLOCK = 2 << 20, 1 << 18
HASHES, BITS_PER_ENTRY, BASE, STRENGTH, ORDER = 4, 9, 1.5, 4.0, 3
#: The end of a text as a token: no word holds a space.
END = " "
_C = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
#: Set in the filter's keys of words.
_WORD = np.uint64(1 << 40)


def levels(counts: np.ndarray) -> np.ndarray:
    """The level of each count of 1 or more."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def least(level: np.ndarray) -> np.ndarray:
    """The least count of a level (0 for level 0)."""
    return np.where(level > 0, np.ceil(BASE ** (np.asarray(level, np.float64) - 1) - 1e-9), 0.0)


def most(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level (0 for level 0)."""
    return np.where(level > 0, least(np.asarray(level) + 1) - 1, 0.0)


class Filter:
    """A Bloom filter of (key, level) entries."""

    def __init__(self, bits: np.ndarray, size: int) -> None:
        self.bits, self.size = bits, size

    @classmethod
    def of(cls, keys: np.ndarray, q: np.ndarray, bits: int = BITS_PER_ENTRY) -> Filter:
        """The filter of keys with their levels, with so many bits for each entry."""
        size = max(64, -(-bits * int(q.sum()) // 8) * 8)
        flags = np.zeros(size, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            at = np.flatnonzero(q >= level)
            for a in range(0, len(at), BLOCK):
                x, step = cls.seeds(keys[at[a : a + BLOCK]], level)
                for i in range(HASHES):
                    flags[cls.bit(x, step, i, size)] = 1
        return cls(np.packbits(flags, bitorder="little"), size)

    @staticmethod
    def seeds(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(keys.astype(np.uint64) + np.uint64(level * 0xA24BAED4963EE407 & (1 << 64) - 1))
        return x, (x << np.uint64(32) | x >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def bit(x: np.ndarray, step: np.ndarray, i: int, size: int) -> np.ndarray:
        """The i-th bit's number: the upper half of a hash, scaled to the size (below 2**32)."""
        return ((x + np.uint64(i) * step >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The numbers of those keys that are in at the level."""
        x, step = self.seeds(keys, level)
        at = np.arange(len(keys))
        for i in range(HASHES):  # most that are absent drop out at the first bit
            bit = self.bit(x[at], step[at], i, self.size)
            at = at[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        return at

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes until one is missing."""
        out = np.zeros(len(keys), np.uint8)
        for a in range(0, len(keys), BLOCK):
            at, level, here = np.arange(min(BLOCK, len(keys) - a)), 1, keys[a : a + BLOCK]
            while len(at):
                at = at[self.has(here[at], level)]
                out[a + at] = level
                level += 1
        return out


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), "<u8")


def firsts(sizes: np.ndarray) -> np.ndarray:
    """Whether each token is the first of its text."""
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def last_tokens(first: np.ndarray, a: int, n: int) -> np.ndarray:
    """The last tokens, from a on in a block, of n-grams within texts."""
    low, end = max(n - 1, a), min(len(first), a + BLOCK)
    across = np.zeros(max(0, end - low), bool)
    for k in range(n - 1 if len(across) else 0):
        across |= first[low - k : end - k]
    return low + np.flatnonzero(~across)


def grams(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, n: int):
    """Keys of the n-grams within texts, in order of their last tokens, a block at a time. keys: of words; ids: the word of
    each token; sizes: the tokens of each text."""
    first = firsts(sizes)
    for a in range(0, len(ids), BLOCK):
        at, low = last_tokens(first, a, n), max(0, a - n + 1)
        if len(at):
            key = full = keys[ids[low : a + BLOCK]]
            for k in range(1, n):
                key = mix(mix(key[:-1]) + full[k:] * _C)
            yield key[at - low - n + 1]


def gram_codes(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, orders, bits: int) -> np.ndarray:
    """The codes of all n-grams of some orders, one order after another."""
    out, used = np.empty(sum(int(np.maximum(sizes - n + 1, 0).sum()) for n in orders), np.uint64), 0
    for n in orders:
        for found in grams(keys, ids, sizes, n):
            out[used : used + len(found)] = codes(found, bits)
            used += len(found)
    return out


def codes(keys: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of keys: the number of the slice, of so many bits, and 32 bits more, in the keys' order."""
    return keys >> np.uint64(32 - bits)


def cuts(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, from, to) of sorted codes, for slices that have some."""
    first = [np.zeros(min(1, len(found)), np.int64)]
    for a in range(1, len(found), BLOCK):
        at = found[a - 1 : a + BLOCK] >> np.uint64(32)
        first.append(a + np.flatnonzero(at[1:] != at[:-1]))
    first = np.concatenate(first)
    return (found[first] >> np.uint64(32)).astype(np.int64), first, np.append(first[1:], len(found))


def placed(found: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """The value of each code, given those of the distinct codes in order."""
    part, out, used = np.empty(len(found), np.uint8), np.empty(len(found), values.dtype), 0
    for a in range(0, len(found), BLOCK):
        part[a : a + BLOCK] = found[a : a + BLOCK] >> np.uint64(28 + bits)
    for k in range(16):
        at = np.flatnonzero(part == k)
        order = np.argsort(found[at])
        at, here = at[order], found[at[order]]
        place = used + np.cumsum(np.diff(here, prepend=here[:1]) != 0)
        used = int(place[-1]) + 1 if len(at) else used
        if used <= len(values):
            out[at] = values[place]
    if used != len(values):
        raise ValueError(f"{used} n-grams, {len(values)} answers")
    return out


def runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted numbers, and how often each is there."""
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found)))


def small(values: np.ndarray) -> bytes:
    """Numbers from 0, most of them below 255: a byte each, and eight more for each of the others."""
    large = values[values >= 255]
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    at = np.flatnonzero(out == 255)
    out[at] = np.frombuffer(raw, "<i8", len(at), n)
    return out


def packed(found: np.ndarray) -> bytes:
    """Sorted codes of one slice: their lower 32 bits as differences, byte by byte as the upper ones are mostly small."""
    step = np.diff(found & _LOW, prepend=np.uint64(0)).astype("<u4")
    return squeezed(step.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    """The lower 32 bits of the codes."""
    held = np.frombuffer(unsqueezed(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(held.reshape(4, -1).T).view("<u4").ravel().astype(np.uint64))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first, dtype=np.int64) if len(first) else values.astype(np.int64)


def level_of_sums(keys: list[np.ndarray], values: list[np.ndarray], pieces: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of several sorted arrays of 32-bit keys, and the levels of the sums of their values."""
    ends = [np.searchsorted(k, np.arange(pieces + 1, dtype=np.uint64) * np.uint64((1 << 32) // pieces)) for k in keys]
    out = []
    for i in range(pieces):
        found, n = summed(*(together([x[e[i] : e[i + 1]] for x, e in zip(each, ends)], kind) for each, kind in ((keys, np.uint32), (values, np.uint8))))
        out.append((found, levels(n).astype(np.uint8)))
    return np.concatenate([f for f, _ in out]), np.concatenate([q for _, q in out])


class Batch:
    """Texts of a batch, taken up in parts, as numbers among the distinct words of their part."""

    def __init__(self) -> None:
        self.bytes, self.docs, self.keys, self.ids, self.sizes = 0, [], [], [], []

    def take(self, docs: list, bodies: list[bytes]) -> None:
        words, numbers, sizes = tokens([b.lower() for b in bodies])
        keys, back = np.unique(word_keys([*words, END.encode()]), return_inverse=True)
        back = back.astype(np.int32)
        ids = np.full(len(numbers) + len(bodies), back[-1], np.int32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(sizes + 1) - 1] = False  # each text's end
        ids[inside] = back[numbers]
        self.bytes += sum(map(len, bodies))
        for held, more in ((self.keys, keys), (self.ids, ids), (self.sizes, sizes + 1)):
            held.append(more)
        self.docs += docs

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the distinct words of texts, the number among them of each token, and the tokens of each text."""
        keys = distinct(np.concatenate(self.keys))
        self.ids = [np.searchsorted(keys, own).astype(np.int32)[ids] for own, ids in zip(self.keys, self.ids)]
        return keys, np.concatenate(self.ids), np.concatenate(self.sizes)


def in_batches(batches, size: int):
    """Batches of about size bytes, and at least one text."""
    held = Batch()
    for docs, bodies in groups(batches, min(PART, size)):
        held.take(docs, bodies)
        if held.bytes >= size:
            yield held
            held = Batch()
    if held.docs:
        yield held


def rows_of(docs: DataFrame, trained, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, train)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), F.coalesce(trained, F.lit(True)).alias("train"))


#: What slices send and get, as bytes of arrays: kind is one of the letters below.
KINDS = "slice int, kind string, batch long, n long, v long, a binary, b binary, c binary"
COUNTS, GRAMS, MODEL, PROBES, TEXTS, FOUND = "CGMPTF"
SCHEMA = pa.schema([("slice", pa.int32()), ("kind", pa.string()), ("batch", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), *((x, pa.binary()) for x in "abc")])


def message(slice_: int, kind: str, *parts: bytes, batch: int = 0, n: int = 0, v: int = 0) -> pa.RecordBatch:
    row = [slice_, kind, batch, n, v, *parts, *[b""] * (3 - len(parts))]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA)], schema=SCHEMA)


def table_of(messages: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(messages, SCHEMA)


def together(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def word_entries(keys: np.ndarray, slice_bits: int) -> np.ndarray:
    """The filter's keys of words."""
    return codes(keys, slice_bits) & _LOW | _WORD


def counted(rows: DataFrame, slice_bits: int, order: int, bits: int) -> DataFrame:
    """Each slice's word keys, their counts and the filter, from training rows. Tasks count before anything is shuffled."""

    def run(batches):
        for batch in in_batches(batches, TRAIN_BYTES):
            keys, ids, sizes = batch.numbered()
            c = np.bincount(ids, minlength=len(keys))
            for s, a, b in zip(*cuts(codes(keys, slice_bits))):
                yield message(s, COUNTS, keys[a:b].tobytes(), small(c[a:b]))
            for n in range(2, order + 1):
                found = gram_codes(keys, ids, sizes, [n], slice_bits)
                found.sort()
                for s, a, b in zip(*cuts(found)):
                    some, times = runs(found[a:b])
                    yield message(s, GRAMS, packed(some), squeezed(small(times)))

    def add(table: pa.Table) -> pa.Table:
        words, counts, both, times = [], [], [], []
        for r in table.select(["kind", "a", "b"]).to_pylist():
            if r["kind"] == COUNTS:
                words.append(np.frombuffer(r["a"], "<u8"))
                counts.append(unsmall(r["b"], len(words[-1])))
            else:
                both.append(unpacked(r["a"]).astype(np.uint32))
                n = unsmall(unsqueezed(r["b"]), len(both[-1]))
                times.append(n.astype(np.min_scalar_type(n.max(initial=0))))
        keys, c = summed(together(words, np.uint64), together(counts, np.int64))
        found, q = level_of_sums(both, times)
        del both, times
        held = Filter.of(np.concatenate([word_entries(keys, slice_bits), found]), np.concatenate([levels(c), q]), bits)
        return table_of([message(table.column("slice")[0].as_py(), MODEL, keys.tobytes(), small(c), held.bits.tobytes(), n=int(c.sum()), v=len(keys))])

    return rows.where("train").select("doc_id", "body").mapInArrow(run, KINDS).groupBy("slice").applyInArrow(add, KINDS)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key from sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Fitted:
    """N, V, the bits of a slice's number and the order of a model whose slices are in a table."""

    def __init__(self, counts: DataFrame, slice_bits: int, order: int) -> None:
        self.counts, self.slice_bits, self.order = counts, slice_bits, order
        self.total, self.distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        let_go(counts.sparkSession)  # the counting's shuffle, before scoring makes its own


def log_probabilities(total: int, distinct: int, ids: np.ndarray, word_level: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 p of each token. ids: word numbers; word_level: by word number; found: for each n from 2 the last tokens of
    the n-grams and their levels."""
    p = (least(word_level) + 1)[ids] / float(total + distinct + 1)
    history = most(word_level)[ids]  # of the (n - 1)-gram that ends at each token
    for at, level in found:
        p[at] = (least(level) + STRENGTH * p[at]) / (history[at - 1] + STRENGTH)
        history = np.zeros(len(ids))
        history[at] = most(level)
    return np.log10(np.minimum(p, 1.0))


def log_sums(total: int, distinct: int, ids: np.ndarray, sizes: np.ndarray, word_level: np.ndarray, levels_: np.ndarray, order: int) -> np.ndarray:
    """The sum of log10 p of each text. levels_: of the n-grams, one order after another; tokens are taken in blocks."""
    first, logs = firsts(sizes), np.empty(len(ids))
    used = np.cumsum([0] + [int(np.maximum(sizes - n + 1, 0).sum()) for n in range(2, order + 1)])
    before = [(np.zeros(0, np.int64), levels_[:0])] * (order - 1)
    for a in range(0, len(ids), BLOCK):
        low, end, found = max(0, a - 1), min(len(ids), a + BLOCK), []  # the token before the block is a history
        for k in range(order - 1):
            at = last_tokens(first, a, k + 2)
            level = levels_[used[k] : used[k] + len(at)]
            used[k] += len(at)
            at, level = np.concatenate([before[k][0], at]), np.concatenate([before[k][1], level])
            keep = at == end - 1
            before[k] = at[keep], level[keep]
            found.append((at - low, level.astype(np.int64)))
        logs[a:end] = log_probabilities(total, distinct, ids[low:end], word_level, found)[a - low :]
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


def fit(docs: DataFrame, trained, share: int = SHARE, order: int = ORDER, bits: int = BITS_PER_ENTRY, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """The model of the rows for which the column trained is not false; share: bytes of text for each slice, bits: of the
    filter for each entry. On both no result depends but for the filter's false positives."""
    rows = rows_of(docs, trained, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.length("body") + 1), F.lit(0))).first()[0]
    slice_bits = (max(1, -(-size // share)) - 1).bit_length()
    return Fitted(stored(counted(rows, slice_bits, order, bits), "counts"), slice_bits, order)


def score(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, base_score, score."""
    slice_bits, total, kinds, order = model.slice_bits, model.total, model.distinct, model.order
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def ask(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in in_batches(batches, SCORE_BYTES):
            keys, ids, sizes = batch.numbered()
            both = gram_codes(keys, ids, sizes, range(2, order + 1), slice_bits)
            both.sort()
            of_words, of_both = ({s: (a, b) for s, a, b in zip(*cuts(k))} for k in (codes(keys, slice_bits), both))
            for s in sorted(of_words.keys() | of_both.keys()):
                (a, b), (c, d) = of_words.get(s, (0, 0)), of_both.get(s, (0, 0))
                yield message(s, PROBES, keys[a:b].tobytes(), packed(runs(both[c:d])[0]), batch=number)
            del both
            # byte by byte of the numbers, as the upper ones are mostly 0
            planes = squeezed(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
            sink = pa.BufferOutputStream()  # ids may be null
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(batch.docs, pa.int64()), pa.array(sizes)], names=["doc_id", "n"]))
            yield message(number % (1 << slice_bits), TEXTS, sink.getvalue().to_pybytes(), planes, batch=number)
            number += 1

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [r for r in rows if r["kind"] == MODEL]
        keys = np.frombuffer(own[0]["a"], "<u8") if own else np.zeros(0, np.uint64)
        c = unsmall(own[0]["b"], len(keys)) if own else np.zeros(0, np.int64)
        bits = np.frombuffer(own[0]["c"], np.uint8) if own else None
        read = Filter(bits, 8 * len(bits)).read if own else lambda k: np.zeros(len(k), np.uint8)
        out = []
        for r in rows:
            if r["kind"] == TEXTS:
                out.append(message(-1, TEXTS, r["a"], r["b"], batch=r["batch"]))
            elif r["kind"] == PROBES:
                words = np.frombuffer(r["a"], "<u8")
                counts = squeezed(small(looked_up(keys, c, words)) + small(read(word_entries(words, slice_bits))))
                out.append(message(r["slice"], FOUND, r["a"], counts, squeezed(small(read(unpacked(r["b"])))), batch=r["batch"]))
        return table_of(out)

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])  # the texts first, then answers as keys are in order
        texts = pa.ipc.open_stream(rows[0]["a"]).read_all()
        sizes = texts.column("n").to_numpy()
        ids = np.ascontiguousarray(np.frombuffer(unsqueezed(rows[0]["b"]), np.uint8).reshape(4, -1).T).view("<i4").ravel()
        words, counts, word_levels, gram_levels = [], [], [], []
        for r in rows[1:]:
            words.append(np.frombuffer(r["a"], "<u8"))
            raw, n = unsqueezed(r["b"]), len(words[-1])
            counts.append(unsmall(raw, n))
            word_levels.append(np.frombuffer(raw, np.uint8)[n + 8 * int((counts[-1] >= 255).sum()) :][:n].astype(np.int64))
            gram_levels.append(np.frombuffer(unsqueezed(r["c"]), np.uint8))
        keys, c, level, of_gram = together(words, np.uint64), together(counts, np.int64), together(word_levels, np.int64), together(gram_levels, np.uint8)
        del rows, words, counts, word_levels, gram_levels
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat((c > 0)[ids], starts, dtype=np.int64), np.add.reduceat(np.log10((c + 1) / float(total + kinds + 1))[ids], starts)]
        level_of = placed(gram_codes(keys, ids, sizes, range(2, order + 1), slice_bits), of_gram, slice_bits)
        sums.append(log_sums(total, kinds, ids, sizes, level, level_of, order))
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), pa.array(sizes), *map(pa.array, sums)], schema=schema)

    rows = rows_of(docs, F.lit(True), id_col, text_col).select("doc_id", "body").mapInArrow(ask, KINDS)
    answers = rows.unionByName(model.counts).groupBy("slice").applyInArrow(answer, KINDS)
    return answers.groupBy("batch").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ids whose CRC-32 leaves 2 of
    7 are held out of training."""
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = fit(docs, ~out_of)
    out = score(docs, model)
    return out.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
