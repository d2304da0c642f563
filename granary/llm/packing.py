"""Packing by power-of-two decomposition.

Each document is tokenised, closed with an end id and cut into pieces whose lengths are powers of two: full
pieces of max_len first, then the binary digits of the rest in falling order.  A piece is a sequence of its own,
so no sequence crosses documents and none is padded; equal lengths share a bucket, from which a training
loader draws batches of one length.  The work is a map over documents: nothing is shuffled.

Ids are those of the tokenizer's plain call: the string of a special token in a text becomes that token's id.

Defined cases: a null or empty text gives the one piece that holds the end id; repeated rows are packed each
on its own; a null doc_id is carried along; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, groups, grown, kept, texts

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Stands between words while many are encoded at once; its pre-token always has one id of its own.
MARK = "\x01"


#: Words that a worker remembers.
MAX_WORDS = 400_000
#: Words of these characters, if lower-case, go the short way: Latin letters and ASCII marks but apostrophes.
SIMPLE = re.compile(r"[a-zà-öø-ɏªµºß!-&(-/:-@\[-`{-~]+")
LETTERS = re.compile(r"[^\W\d_]+")


def byte_characters() -> dict[int, int]:
    """The characters that stand for the bytes of a byte-level vocabulary: visible ones for themselves, the rest in
    order from U+0100; the space stays."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)} | {32: 32}


class WordIds:
    """Token ids of whole texts from the ids of their distinct words.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its
    words one after another; each distinct word is encoded once, and remembered by the worker. For a vocabulary of
    lower-cased words with word ends, simple words are cut into letter runs and marks here, as its pre-tokenizer
    does, and need no normalising; all other words, and other tokenizers, take the whole way."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens in a text become their ids, as the tokenizer has it by default
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_bytes = [t.encode().lower() for t in self.special]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.quick = self._quick(path) if self.mark is not None else None
        self.words, self.ids, self.used = Words(MAX_WORDS), np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _quick(self, path: str):
        """The same model behind a split at white space, if that gives the same ids on a trial: each character that
        simple words may have, alone, twice, and beside a letter and a mark."""
        from tokenizers import Tokenizer, pre_tokenizers

        quick = Tokenizer.from_file(path)
        quick.normalizer, quick.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.characters = byte_characters()
        alphabet = [chr(i) for i in range(33, 0x250) if SIMPLE.fullmatch(chr(i)) and chr(i) == chr(i).lower()]
        trial = ["naïveté,", "(übung)", "a,b"] + [w for c in alphabet for w in (c, c + c, f"th{c}ng", f"{c}ing", f"thing{c}", f"({c}", f"{c}.")]
        self.quick = quick
        same = self._quick_ids(trial)[0].tolist() == [x for w in trial for x in self.tokenizer.encode(w, add_special_tokens=False).ids]
        return quick if same else None

    def _cut(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids without marks, and how many stand before each."""
        ids = np.array(ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _quick_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of simple words, and how many each has."""
        text = LETTERS.sub(r" \g<0> ", f" {MARK} ".join([*words, ""])).encode().decode("latin-1").translate(self.characters)
        return self._cut(self.quick.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _whole_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words."""
        encode = lambda x: self.tokenizer.encode_batch_fast(x, add_special_tokens=False)
        if self.mark is None or any(MARK in w for w in words):
            lists = [e.ids for e in encode(words)]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        return self._cut(encode([f" {MARK} ".join([*words, ""])])[0].ids)

    def _learn(self) -> None:
        fresh, self.words.fresh = [w.decode("utf-8", "replace") for w in self.words.fresh], []
        first = len(self.words) - len(fresh)
        simple = np.array([self.quick is not None and SIMPLE.fullmatch(w) is not None and w == w.lower() and not any(t in w for t in self.special) for w in fresh], bool)
        self.starts = grown(self.starts, first, np.zeros(len(fresh), np.int64))
        self.lengths = grown(self.lengths, first, np.zeros(len(fresh), np.int64))
        for which, coded in ((np.flatnonzero(simple), self._quick_ids), (np.flatnonzero(~simple), self._whole_ids)):
            for at in range(0, len(which), 4000):
                part = which[at : at + 4000]
                ids, lengths = coded([fresh[i] for i in part.tolist()])
                self.starts[first + part] = self.used + np.cumsum(lengths) - lengths
                self.lengths[first + part] = lengths
                self.ids = grown(self.ids, self.used, ids)
                self.used += len(ids)

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words laid one after another, and how many each has."""
        lengths = self.lengths[words]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.arange(total[-1]) + np.repeat(self.starts[words] - total[:-1], lengths)], lengths

    def _forget(self) -> None:
        self.ids, self.lengths = self._gather(self.words.evict())
        self.starts, self.used = np.cumsum(self.lengths) - self.lengths, len(self.ids)

    def lowered(self, body: bytes) -> bytes:
        """A-Z lower-cased, as the tokenizer does itself, for fewer distinct words; not where that could make the string
        of a special token, nor where combining marks (U+0300 to U+036F) occur: letters are composed before."""
        low = body.lower()
        return body if b"\xcc" in body or b"\xcd" in body or any(t in low for t in self.special_bytes) else low

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if self.words.full():
            self._forget()
        each = self.words.ids([self.lowered(b) for b in bodies])
        if self.words.fresh:
            self._learn()
        words = np.concatenate(each)
        self.words.count(words)
        ids, lengths = self._gather(words)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum([len(x) for x in each])])])


def cuts(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: powers of two in falling order."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id (unique: partition and number within it, the same when a task is run again), offset."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches):
        coder, number = kept(("packing", tokenizer_path), lambda: WordIds(tokenizer_path)), TaskContext.get().partitionId() << 40
        for doc_ids, bodies in groups(batches):
            ids, counts = coder.encode(bodies)
            raw, last, at = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little"), 0
            out: list[list] = [[], [], [], [], []]
            for doc, n in zip(doc_ids, counts.tolist()):
                whole = raw[4 * at : 4 * (at + n)] + last
                at, start = at + n, 0
                for length in cuts(n + 1, max_len):
                    for column, value in zip(out, (doc, start, length, whole[4 * start : 4 * (start + length)], n + 1)):
                        column.append(value)
                    start += length
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, ARROW)), pa.array(np.arange(number, number + n), pa.int64()), pa.array(np.zeros(n, np.int64))], schema=ARROW)
            number += n

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("length").alias("bucket"))
