"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over each document's word windows.

The benchmark's windows are normalised, hashed and broadcast; windows of a document whose words are all known
benchmark words are hashed, looked up and then verified word by word.  Documents are never shuffled.  The
broadcasts are bounded: a benchmark of more than MAX_WINDOWS windows is dealt into blocks of parts of items, and workers hold
one block at a time, through which they pass larger groups of documents before the next is loaded.

Defined cases: null or empty texts have no words; items without words are ignored, and so are items whose id or
text is null; items with equal windows all count; repeated rows are scanned each on its own; an empty benchmark
finds nothing; other columns are not read by scan() and are carried unchanged by cleaned().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ALNUM, groups, kept, looked_up, small_batches, stored, texts, trimmed

#: Windows in one broadcast, about 120 bytes each in a worker; windows of a part of an item.
MAX_WINDOWS, PART = 500_000, 1000
#: Bytes of documents in a group: where there is one block, and where there are several.
GROUP, LARGE_GROUP = 1 << 19, 1 << 25
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_P = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


class Windows:
    """Windows of a block of items: word numbers, and for each length the hashes, words and items of its windows."""

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        found: dict[int, dict[tuple, set[int]]] = {}
        for item, body in items:
            words = body.translate(ALNUM).split()
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size, k = min(n, len(ids)), len(self.items)
            self.items.append(item)
            for i in range(len(ids) - size + 1):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(k)
        self.by_size = []
        for size, windows in sorted(found.items()):
            rows = np.array(list(windows), np.int32).reshape(len(windows), size)
            seed = 1
            while len(np.unique(keys := hashed(rows, seed))) < len(rows):
                seed += 1  # until no two windows share a hash
            order = np.argsort(keys)
            owners = [np.array(sorted(x), np.int32) for x in windows.values()]
            self.by_size.append((size, seed, keys[order], rows[order], [owners[i] for i in order]))

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Which words are hit, and (position, items) of each window found, in word numbers with 0 for unknown words."""
        hit, found = np.zeros(len(ids) + 1, np.int32), []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, seed, keys, rows, owners in self.by_size:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            windows = ids[at[:, None] + np.arange(size)]
            key = hashed(windows, seed)
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            sure = np.flatnonzero((keys[where] == key) & (rows[where] == windows).all(axis=1))
            for p, w in zip(at[sure].tolist(), where[sure].tolist()):
                found.append((p, owners[w]))
            np.add.at(hit, at[sure], 1)
            np.add.at(hit, at[sure] + size, -1)
        return np.cumsum(hit)[:-1] > 0, found


def hashed(rows: np.ndarray, seed: int) -> np.ndarray:
    """A polynomial hash of each row of word numbers, modulo 2**64."""
    out = np.full(len(rows), seed, np.uint64)
    for j in range(rows.shape[1]):
        out = out * np.uint64(_P) + rows[:, j].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def blocks(benchmark: DataFrame, n: int, max_windows: int, item_col: str, text_col: str):
    """Broadcasts of the benchmark's windows, max_windows each at most. Windows are dealt, not items: of an item with more
    windows each part (with the n - 1 words behind it, so that no window is lost) is in some block."""
    spark = benchmark.sparkSession
    words = F.filter(F.split(F.regexp_replace(F.col(text_col), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), " "), lambda w: w != "")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    part = max(1, min(PART, max_windows))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)), F.lit(part))
    parts = items.select("item", "words", F.explode(starts).alias("start")).select("item", "start", F.slice("words", F.col("start") + 1, F.lit(part + n - 1)).alias("words"))
    parts = parts.select("item", "start", F.array_join("words", " ").cast("binary").alias("body"), F.greatest(F.lit(1), F.size("words") - n + 1).alias("n"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    if total <= max_windows:
        of_block = [parts] if total else []
    else:
        numbered = stored(parts.withColumn("row", F.monotonically_increasing_id()), "benchmark")
        # blocks of half the bound on average; a block beyond it is cut in two until it keeps it
        of_block, count = [], -(-2 * total // max_windows)
        dealt = [(count, k) for k in range(count)]
        sizes = {}
        while dealt:
            for c in {c for c, _ in dealt}:
                at = F.pmod(F.xxhash64("row"), F.lit(c))
                sizes[c] = {r["b"]: (r["n"], r["rows"]) for r in numbered.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}  # one row a block
            again = []
            for c, k in dealt:
                size, rows = sizes[c].get(k, (0, 0))
                if size > max_windows and rows > 1:
                    again += [(2 * c, k), (2 * c, k + c)]
                elif size:
                    of_block.append(numbered.where(F.pmod(F.xxhash64("row"), F.lit(c)) == k))
            dealt = again
    for one in of_block:
        rows = [(r.item, bytes(r.body)) for r in one.select("item", "body").collect()]  # max_windows windows at most
        yield spark.sparkContext.broadcast(Windows(sorted(rows), n))


def batch_hits(windows: Windows, bodies: list[bytes]):
    """For each text: number of words, which are hit (None: none), items found."""
    each = [looked_up(windows.vocab, b.translate(ALNUM)) for b in bodies]
    sizes = [len(x) for x in each]
    gap = np.zeros(1, np.int32)  # between documents: no window crosses it
    flat = np.concatenate([y for x in each for y in (x, gap)])
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    hit, found = windows.scan(flat)
    items: dict[int, set[int]] = {}
    for p, owners in found:
        items.setdefault(int(np.searchsorted(starts, p, "right")) - 1, set()).update(owners.tolist())
    for k, n in enumerate(sizes):
        yield n, hit[starts[k] : starts[k] + n] if k in items else None, {windows.items[i] for i in items.get(k, ())}


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Word intervals [start, end) of the hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def all_hits(sets: list, bodies: list[bytes]) -> list[list]:
    """[number of words, which are hit (None: none), items] of each text, over all blocks; of several, each is let go
    before the next is loaded."""
    out: list[list] = [[0, None, set()] for _ in bodies]
    for b in sets:
        for row, (words, hit, items) in zip(out, batch_hits(b.value, bodies)):
            row[0] = words
            if hit is not None:
                row[1] = hit if row[1] is None else row[1] | hit
            row[2] |= items
        if len(sets) > 1:
            vars(b).pop("_value", None)  # what the worker keeps of a broadcast; were it elsewhere, only memory would tell
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, hits (word intervals inside occurrences, end exclusive), items (ids, as
    sorted strings, whose windows occur)."""
    sets = list(blocks(benchmark, n, max_windows, item_col, item_text_col))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", kind), ("items", pa.list_(pa.string()))])

    def run(batches):
        for ids, bodies in groups(batches, GROUP if len(sets) < 2 else LARGE_GROUP):
            total = all_hits(sets, bodies) if sets else [[len(b.translate(ALNUM).split()), None, ()] for b in bodies]
            hits = [[] if hit is None else [{"start": a, "end": b} for a, b in runs(hit)] for _, hit, _ in total]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in total], pa.int64()), pa.array(hits, kind), pa.array([sorted(r[2]) for r in total], pa.list_(pa.string()))], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def cut(body: bytes, hit: np.ndarray) -> bytes:
    """body without its hit passages, a line break in the place of each."""
    words = [m.span() for m in WORD.finditer(body.lower())]  # bytes.lower changes A-Z alone
    out, at = [], 0
    for a, b in runs(hit):
        out += [body[at : words[a][0]], b"\n"]
        at = words[b - 1][1]
    return b"".join([*out, body[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, max_windows: int = MAX_WINDOWS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, columns and types as they were, without contamination: a document of which at least drop_share of the
    words are hit is removed, other hit passages are cut out of the text (which is looked through again, until none is
    left), clean documents stay as they are."""
    sets = list(blocks(benchmark, n, max_windows, item_col, item_text_col))
    if not sets:
        return docs
    at = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        kept(("decontamination",), list)  # nothing of its own, but other operators' memory is let go
        for batch in trimmed(batches):
            old = batch.column(at).to_pylist()
            keep, new, rest = [True] * len(old), list(old), list(range(len(old)))
            first = True
            while rest:
                bodies = [(new[i] or "").encode() for i in rest]
                again = []
                for i, body, (words, hit, _) in zip(rest, bodies, all_hits(sets, bodies)):
                    if hit is None:
                        continue
                    if first and hit.sum() >= drop_share * words:
                        keep[i], new[i] = False, None
                    else:
                        new[i] = cut(body, hit).decode("utf-8", "replace")
                        again.append(i)
                rest, first = again, False
            columns = [pa.array(new, f.type) if j == at else c for j, (c, f) in enumerate(zip(batch.columns, batch.schema))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = scan(docs, benchmark, n)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
