"""Language identification with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features (hashed into a fixed table); labels are languages with
learned transitions, and forward-backward gives every word of a code-switched text its posterior.  A document's
scores are the mean posteriors of its words; words without a letter don't count.  Words of more than CUT characters, as
texts without spaces have, are cut into successive words, all of which count.

The model is fitted by the gradient of the conditional likelihood on a bounded sample of labelled rows: PER_LANG documents
of each language (fewer where there are over DOCUMENTS / PER_LANG languages), drawn by a hash of the id, a span of at most
SPAN words from each; spans of different languages are joined into code-switched training sequences.  Everything else is a
map over whole texts: nothing is shuffled.

Forward-backward runs over all words of a group of documents at once: sequences are cut into blocks, the blocks'
transfer matrices are multiplied in step, the block ends are chained, and the words' vectors are then made for one
group of blocks after another.  Blocks grow with the group, so that matrices and vectors keep to ROOM numbers however
long a text is and however many languages there are; a text's own share is 4 bytes a word.

Defined cases: a null text or one without a letter gets lang_pred 'und' and score 0; without labelled rows all do;
ties go to the language that sorts first; repeated rows get equal results; rows of a null doc_id are scored and, in
languages(), never learned from; other columns are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, groups, grown, kept, mix, small_batches, texts, trimmed

#: Labelled documents of each language and words of each that are learned from at most; documents in all.
PER_LANG, SPAN, DOCUMENTS = 400, 120, 25_600
#: More languages are an error: the model's size, TABLE numbers a language, is bounded by it.
MAX_LANGS = 2048
TABLE = 1 << 15
#: Words of a block at least; numbers in the transfer matrices of a group of texts, and in a group of blocks.
BLOCK, ROOM = 64, 1 << 21
#: Characters of a word.
CUT = 40
LONG, LONG_BYTES = re.compile(rf"[^ ]{{{CUT}}}(?=[^ ])"), re.compile(rb"[^ ]{%d}" % (CUT + 1))
EDGE = re.compile(r"^\W+|\W+$")
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double"


#: A-Z lower-cased; ASCII characters become spaces but for letters, digits, apostrophes and hyphens.
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 or c in b"'-" else 32 for c in range(256))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of words' features, one word after another, and how many each has: the word itself, affixes of 1 to 4
    characters, character pairs and triples, its characters beyond ASCII and their script blocks; none without a letter."""
    cores = [(w if w.isalnum() else EDGE.sub("", w)).lower() for w in words]
    some = np.array([i for i, c in enumerate(cores) if c.isalpha() or LETTER.search(c)], np.int64)
    cores = [cores[i] for i in some]
    code = np.frombuffer("".join([f"<{c}>" for c in cores]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(c) for c in cores], np.int64)
    end = np.cumsum(size + 2)
    start, word, n = end - size - 2, np.repeat(np.arange(len(cores)), size + 2), len(code)
    slots, owner = [np.array([crc32(c.encode("utf-8", "surrogatepass")) for c in cores], np.uint64)], [np.arange(len(cores))]

    def add(kind: int, at: np.ndarray, of: np.ndarray, length: int, shift: int = 0) -> None:
        """Features of the length characters from each of the places at."""
        h = np.full(len(at), kind, np.uint64)
        for j in range(length):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (code[at + j] >> np.uint64(shift)))
        slots.append(h)
        owner.append(of)

    for length in (2, 3):
        at = np.flatnonzero(word[: max(0, n - length + 1)] == word[length - 1 :])
        add(length, at, word[at], length)
    for length in (1, 2, 3, 4):
        long_enough = np.flatnonzero(size >= length)
        add(10 + length, start[long_enough] + 1, long_enough, length)
        add(20 + length, end[long_enough] - 1 - length, long_enough, length)
    odd = np.flatnonzero(code > 0x7F)
    add(30, odd, word[odd], 1)
    add(31, odd, word[odd], 1, 6)
    of = np.concatenate(owner)
    sizes = np.zeros(len(words), np.int64)
    sizes[some] = np.bincount(of, minlength=len(cores))
    return (np.concatenate(slots) % np.uint64(TABLE)).astype(np.int64)[np.argsort(of, kind="stable")], sizes


def spaced(body: bytes) -> bytes:
    """body in words between spaces; words of more than CUT characters are cut into successive words of CUT."""
    body = body.translate(SPACED)
    return LONG.sub(r"\g<0> ", body.decode("utf-8", "replace")).encode() if LONG_BYTES.search(body) else body


def swept(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, move: np.ndarray, block: int | None = None):
    """Forward-backward over sequences laid one after another, group of blocks by group: yields (seq, start, size, ahead,
    back) with the sequence, first word and size of each block, and the scaled forward and backward vectors of its words,
    (block, blocks, k), 0 beyond a block's size. rows: exponentials of the words' log-potentials, each up to a factor; ids:
    the row of each word; move: log-potentials of transitions.

    At any time there are the transfer matrices of all blocks, which grow to keep to ROOM, and a group's vectors."""
    k = rows.shape[1]
    if block is None:
        block = BLOCK
        while -(-lengths // block).sum() * k * k > ROOM and block < lengths.max():
            block *= 2
    m = np.exp(move - move.max())
    n_blocks = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    slots = int(first[-1])
    if not slots:
        return
    seq = np.repeat(np.arange(len(lengths)), n_blocks)
    depth = np.arange(slots) - first[seq]
    start = (np.cumsum(lengths) - lengths)[seq] + depth * block
    size = np.minimum(block, lengths[seq] - depth * block)
    enter, leave = np.full((slots, k), 1.0 / k), np.ones((slots, k))
    deepest = int(n_blocks.max())
    if deepest > 1:
        # transfer matrices of the blocks of longer sequences, the fullest blocks first
        many = np.flatnonzero(n_blocks[seq] > 1)
        many = many[np.argsort(-size[many], kind="stable")]
        power = np.empty((len(many), k, k))
        of = np.zeros(slots, np.int64)
        of[many] = np.arange(len(many))
        for t in range(block):
            n = int(np.searchsorted(-size[many], -t, "left"))
            g = rows[ids[start[many[:n]] + t]]
            if t:
                step = (power[:n].reshape(-1, k) @ m).reshape(n, k, k) * g[:, None, :]
            else:
                step = np.where(depth[many[:n], None, None] == 0, np.eye(k), m) * g[:, None, :]
            power[:n] = step / step.sum(axis=(1, 2), keepdims=True)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(deepest + 1))
        for d in range(1, deepest):  # chains block ends; at most the blocks of the longest text
            at = by_depth[edges[d] : edges[d + 1]]
            now = np.einsum("ni,nij->nj", enter[at - 1], power[of[at - 1]])
            enter[at] = now / now.sum(axis=1, keepdims=True)
        for d in range(deepest - 2, -1, -1):
            at = by_depth[edges[d] : edges[d + 1]]
            at = at[depth[at] + 1 < n_blocks[seq[at]]]
            now = np.einsum("nij,nj->ni", power[of[at + 1]], leave[at + 1])
            leave[at] = now / now.sum(axis=1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    together = max(1, ROOM // (block * k))
    for a in range(0, slots, together):
        some = order[a : a + together]
        longest = int(size[some[0]])
        ahead, back, e = (np.zeros((longest, len(some), k)) for _ in range(3))
        counts = np.searchsorted(-size[some], -np.arange(longest), "left")
        now, fresh = enter[some], depth[some] == 0
        for t, n in enumerate(counts.tolist()):
            e[t, :n] = rows[ids[start[some[:n]] + t]]
            come = now[:n] @ m
            if not t:
                come[fresh[:n]] = now[:n][fresh[:n]]
            come *= e[t, :n]
            come /= come.sum(axis=1, keepdims=True)
            ahead[t, :n] = now[:n] = come
        now = leave[some]
        for t in range(longest - 1, -1, -1):
            n = int(counts[t])
            back[t, :n] = now[:n]
            come = (now[:n] * e[t, :n]) @ m.T
            now[:n] = come / come.sum(axis=1, keepdims=True)
        yield seq[some], start[some], size[some], ahead, back


def both_ways(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, move: np.ndarray, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The forward and backward vectors of all words, in their order."""
    out = np.empty((2, len(ids), rows.shape[1]))
    for _, start, size, ahead, back in swept(rows, ids, lengths, move, block):
        t, b = np.nonzero(np.arange(len(ahead))[:, None] < size)
        out[0, start[b] + t], out[1, start[b] + t] = ahead[t, b], back[t, b]
    return out[0], out[1]


def scaled(emit: np.ndarray) -> np.ndarray:
    return np.exp(emit - emit.max(axis=1, keepdims=True))


def posteriors(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray, block: int | None = None) -> np.ndarray:
    """Word posteriors by forward-backward. emit: log-potentials of all words, sequences one after another; move:
    log-potentials of transitions."""
    if not len(emit):
        return emit.copy()
    ahead, back = both_ways(scaled(emit), np.arange(len(emit)), lengths, move, block)
    out = ahead * back
    return out / out.sum(axis=1, keepdims=True)


def means(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The mean posterior of each sequence's words (0 without words)."""
    out = np.zeros((len(lengths), rows.shape[1]))
    for seq, _, size, ahead, back in swept(rows, ids, lengths, move):
        post = ahead * back
        total = post.sum(axis=2, keepdims=True)
        np.add.at(out, seq, np.divide(post, total, out=np.zeros_like(post), where=total > 0).sum(axis=0))
    return out / np.maximum(lengths, 1)[:, None]


class Crf:
    def __init__(self, langs: list[str], weights: np.ndarray, move: np.ndarray) -> None:
        self.langs, self.weights, self.move = langs, weights, move


def pair_posteriors(e: np.ndarray, ahead: np.ndarray, back: np.ndarray, move: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The posterior of each pair of labels of the words before nxt and at nxt: (pairs, k, k)."""
    both = ahead[nxt - 1][:, :, None] * np.exp(move - move.max())[None] * (e[nxt] * back[nxt])[:, None, :]
    return both / both.sum(axis=(1, 2), keepdims=True)


def fit(spans: list[tuple[str, list[str]]], epochs: int = 4, rate: float = 0.4, seed: int = 7) -> Crf | None:
    """A CRF from labelled word spans, by AdaGrad on the conditional likelihood of code-switched sequences: each
    holds one to four spans' parts of different documents."""
    langs = sorted({lang for lang, words in spans if words})
    if not langs:
        return None
    rng, k = np.random.default_rng(seed), len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    distinct = sorted({w for _, words in spans for w in words})
    flat, sizes = features(distinct)
    known = dict(zip(distinct, np.split(flat, np.cumsum(sizes)[:-1])))
    coded = []
    for lang, words in spans:
        words = [w for w in words if len(known[w])]  # as in a prediction
        if words:
            coded.append((number[lang], words))
    weights, move = np.zeros((TABLE, k)), np.eye(k) * 2.0
    sums, sums_move = np.full((TABLE, k), 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        order, at, sequences = rng.permutation(len(coded)), 0, []
        while at < len(order):
            take = order[at : at + int(rng.integers(1, 5))]
            at += len(take)
            words, labels = [], []
            for j in take:
                lang, span = coded[j]
                a = int(rng.integers(0, max(1, len(span) // 2))) if len(take) > 1 else 0
                part = span[a : a + int(rng.integers(5, 60))] if len(take) > 1 else span
                words += part
                labels += [lang] * len(part)
            if words:
                sequences.append((words, labels))
        for i in range(0, len(sequences), 16):
            group = sequences[i : i + 16]
            slots = [known[w] for words, _ in group for w in words]
            sizes = np.array([len(x) for x in slots])
            flat = np.concatenate(slots)
            owner = np.repeat(np.arange(len(slots)), sizes)
            emit = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes)
            labels = np.array([x for _, ls in group for x in ls])
            lengths = np.array([len(words) for words, _ in group])
            e = scaled(emit)
            ahead, back = both_ways(e, np.arange(len(e)), lengths, move)
            post = ahead * back
            grad = -post / post.sum(axis=1, keepdims=True)
            grad[np.arange(len(labels)), labels] += 1
            order_ = np.argsort(flat, kind="stable")
            at_first = np.flatnonzero(np.diff(flat[order_], prepend=-1))
            used = flat[order_][at_first]
            step = np.add.reduceat(grad[owner[order_]], at_first) - 1e-3 * weights[used]
            sums[used] += step**2
            weights[used] += rate * step / np.sqrt(sums[used])
            # transitions: seen pairs less expected ones, from the pair posteriors
            inner = np.ones(len(labels), bool)
            inner[np.cumsum(lengths) - lengths] = False
            nxt = np.flatnonzero(inner)
            if len(nxt):
                step = -pair_posteriors(e, ahead, back, move, nxt).sum(axis=0)
                np.add.at(step, (labels[nxt - 1], labels[nxt]), 1)
                step /= len(nxt)
                sums_move += step**2
                move += 0.1 * step / np.sqrt(sums_move)
    return Crf(langs, weights.astype(np.float32), move)


def train(labelled: DataFrame, per_lang: int = PER_LANG, span: int = SPAN, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """Fits on at most per_lang rows of each language, and about documents rows in all, those with the least hash of the id;
    every label is learned, and more than MAX_LANGS of them are refused. Rows whose text or label is null are no sample."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    per_lang = max(4, min(per_lang, documents // len(counts)))
    # three times the wanted number are drawn, so that limit() below has enough
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 3.0 * per_lang / r["count"])) for r in counts], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    plain = F.lower(F.regexp_replace("text", "[\\x00-&(-,./:-@\\[-`{-\\x7F]+", " "))
    words = F.split(F.trim(F.regexp_replace(plain, f"([^ ]{{{CUT}}})(?=[^ ])", "$1 ")), " ")
    spanned = drawn.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", words.alias("words"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("words") - span + 1)) + 1
    spanned = spanned.select("lang", "h", "doc_id", F.slice("words", at.cast("int"), span).alias("words"))
    most = 4 * per_lang * len(counts)  # about three quarters of it are drawn
    by_lang: dict[str, list] = {}
    for x in spanned.orderBy("h", "doc_id", F.xxhash64("words")).limit(most).collect():
        by_lang.setdefault(x.lang, []).append((x.lang, list(x.words)))
    return fit([y for lang in sorted(by_lang) for y in by_lang[lang][:per_lang]])


class Emissions:
    """What a worker knows of words: the exponentials of their log-potentials by number, NaN for words without a letter."""

    def __init__(self, model: Crf) -> None:
        self.model, self.words, self.used = model, Words(), 0
        self.rows = np.zeros((1 << 14, len(model.langs)))

    def of(self, bodies: list[bytes]) -> list[np.ndarray]:
        """The word numbers of each text."""
        if self.words.full():
            self.rows = self.rows[self.words.evict()]
            self.used = len(self.rows)
        each = self.words.ids([spaced(b) for b in bodies])
        fresh, self.words.fresh = self.words.fresh, []
        for a in range(0, len(fresh), 20_000):
            flat, sizes = features([w.decode("utf-8", "replace") for w in fresh[a : a + 20_000]])
            rows = np.full((len(sizes), len(self.model.langs)), np.nan)
            some = sizes > 0
            if len(flat):
                rows[some] = scaled(np.add.reduceat(self.model.weights[flat].astype(np.float64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])))
            self.rows = grown(self.rows, self.used, rows)
            self.used += len(rows)
        self.words.count(np.concatenate(each))
        return each


def emissions(model: Crf) -> Emissions:
    """The worker's, kept over its tasks with the same broadcast model."""
    known = kept(("langid", id(model)), lambda: Emissions(model))
    if known.model is not model:  # another model at the same address
        known.__init__(model)
    return known


def scored(known: Emissions, bodies: list[bytes]):
    """(language number, score) of each text, None without letters."""
    each = known.of(bodies)
    lettered = [x[~np.isnan(known.rows[x, 0])] for x in each]
    lengths = np.array([len(x) for x in lettered])
    for n, mean in zip(lengths.tolist(), means(known.rows, np.concatenate(lettered), lengths, known.model.move)):
        best = int(mean.argmax())
        yield (best, min(1.0, float(mean[best]))) if n else None


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (mean posterior of the best language)."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(model)  # TABLE x languages numbers at most
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        crf = held.value
        for ids, bodies in groups(batches, 1 << 20):
            found = list(scored(emissions(crf), bodies))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["und" if x is None else crf.langs[x[0]] for x in found]), pa.array([0.0 if x is None else x[1] for x in found])], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Crf | None, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns and types as they were, whose text has a language with at least min_score; all rows
    where no model could be learned, as nothing speaks against them."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        known = emissions(held.value)
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                found = scored(known, [(b or "").encode() for b in part.column(at).to_pylist()])
                yield part.filter(pa.array([x is not None and x[1] >= min_score for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; held-out rows (CRC-32 of the id, remainder 1 of 3) teach nothing."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    out = identify(docs, train(docs.where(F.coalesce(fold != 1, F.lit(False)))))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
