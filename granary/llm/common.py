"""What the training-data operators share: word lists per worker, tables in the shared folder, row keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts longer than this are cut at white space before their words are listed, to bound memory.
CHUNK = 1 << 20
#: A worker forgets words when their number or their bytes pass these bounds.
MAX_WORDS, MAX_WORD_BYTES = 150_000, 24 << 20
#: Rows of an Arrow batch where the session has Spark's default of 10,000, which is large for whole texts.
BATCH_ROWS = 1000
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: A-Z lower-cased; every ASCII character that is neither a digit nor a letter becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; on a cluster it is
    an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of the tables that stored() has made in this process.
_MADE: list[str] = []


def let_go(spark: SparkSession) -> None:
    """Has executors delete shuffles that nothing can read any more, such as those that written tables were made of: Spark
    does so once the driver has collected its garbage, by itself every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    let_go(spark)
    path = f"{shared_dir(spark).rstrip('/')}/granary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored() once nothing reads it any more."""
    path = getattr(df, "_granary_path", None)
    if path in _MADE:
        _MADE.remove(path)
        _delete(df.sparkSession, path)


def made() -> int:
    """A mark for clean_up(): tables made from here on."""
    return len(_MADE)


def clean_up(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the tables that stored() has made in this process since a mark, but one: for callers that have written
    their results, or the table that they go on from."""
    path = getattr(but, "_granary_path", None)
    gone = [p for p in _MADE[since:] if p != path]
    _MADE[since:] = [p for p in _MADE[since:] if p == path]
    for p in gone:
        _delete(spark, p)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of whole texts, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, body binary): UTF-8 bytes of each whole text, null as empty; other columns are left unread."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def pieces(body: bytes) -> list[bytes]:
    """body cut at white space into parts of about CHUNK bytes (one part for usual texts)."""
    if len(body) <= CHUNK:
        return [body]
    out, at = [], 0
    while at < len(body):
        m = _GAP.search(body, min(at + CHUNK, len(body)))
        end = m.start() if m else len(body)
        out.append(body[at:end])
        at = end
    return out


def tokens(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words in order of sight, which of them each word is, number of words of each text) of texts in UTF-8, laid
    one after another. Words stand between ASCII white space."""
    split = pc.ascii_split_whitespace(pa.array(bodies, pa.large_binary()).cast(pa.large_string(), safe=False))
    coded, ends = split.values.dictionary_encode(), split.offsets.to_numpy()
    words, numbers = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
    if b"" in words:  # before white space at a text's start, and after it at the end
        empty = words.index(b"")
        keep = numbers != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        numbers = numbers[keep]
        numbers = numbers - (numbers > empty)
        del words[empty]
    return words, numbers, np.diff(ends).astype(np.int64)


class Words(dict):
    """Numbers distinct words from 0 in order of sight; fresh holds those not yet seen by the operator, which keeps what
    it knows of a word under its number. A worker may keep one over many tasks."""

    def __init__(self, most: int | None = None) -> None:
        super().__init__()
        self.most = MAX_WORDS if most is None else most
        self.fresh: list[bytes] = []
        self.bytes = 0
        self.seen = np.zeros(1 << 14, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        self.bytes += len(word)
        return n

    def full(self) -> bool:
        return len(self) > self.most or self.bytes > MAX_WORD_BYTES

    def evict(self) -> np.ndarray:
        """Forgets words seen once, and the rarer half beyond that; the old numbers of those kept, in their new order.
        To be called with no fresh words, before new ones are numbered."""
        words, seen = list(self), self.seen[: len(self)]
        keep = np.flatnonzero(seen > 1)
        most = self.most // 3
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[:most]])
        self.clear()
        kept = [words[i] for i in keep.tolist()]
        if sum(map(len, kept)) > MAX_WORD_BYTES // 2:
            kept, keep = [], keep[:0]
        self.update(zip(kept, range(len(kept))))
        self.bytes = sum(map(len, kept))
        self.seen = seen[keep] // 2 + 1
        return keep

    def ids(self, bodies: list[bytes]) -> list[np.ndarray]:
        """The number of each word between ASCII white space, of each text."""
        words, numbers, sizes = tokens(bodies)
        mine = np.array(list(map(self.__getitem__, words)), np.int32)
        return np.split(mine[numbers], np.cumsum(sizes)[:-1])

    def count(self, ids: np.ndarray) -> None:
        """Notes that words were seen, for evict()."""
        if len(self.seen) < len(self):
            self.seen = np.concatenate([self.seen, np.zeros(2 * len(self) - len(self.seen), np.int64)])
        self.seen[: len(self)] += np.bincount(ids, minlength=len(self))


#: What a worker keeps over its tasks: one operator's knowledge at a time, so that stages don't add up.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """The worker's object for key, made anew unless it is the one kept; another one is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. (By a sort: numpy's own way without counts takes many times longer where most are distinct.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def looked_up(table: dict, body: bytes) -> np.ndarray:
    """Each word's value in table, 0 for those outside it."""
    found = [np.array(list(map(table.get, w, repeat(0))), dtype=np.int32) for w in map(bytes.split, pieces(body))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def trimmed(batches):
    """batches, with memory that an earlier task on this worker has left given back first, and its own at the end."""
    give_back()
    yield from batches
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def groups(batches, size: int = 1 << 19):
    """(ids, bodies) lists of about size bytes, and at least one row, from Arrow batches of texts()."""
    ids, bodies, total = [], [], 0
    for batch in trimmed(batches):
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = body.as_py()
            ids.append(i)
            bodies.append(body)
            total += len(body)
            if total >= size:
                yield ids, bodies
                ids, bodies, total = [], [], 0
    if ids:
        yield ids, bodies


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in wrapped unsigned arithmetic."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with more put behind its first used rows; room doubles, so appends stay cheap."""
    need = used + len(more)
    if need > len(held):
        bigger = np.zeros((max(need, 2 * len(held)), *held.shape[1:]), held.dtype)
        bigger[:used] = held[:used]
        held = bigger
    held[used:need] = more
    return held


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
