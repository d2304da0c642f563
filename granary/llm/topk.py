"""Exact top-k inner products by MaxScore over dimension postings.

A vector's integer components are impacts.  Dimension d has two posting lists in a shard: rows with a positive component
and rows with a negative one, each in order of falling impact.  For a query, its term d has the list of the query's sign;
the term's bound is |q_d| times the list's first impact, and rows outside the list can only lose by the term.  With the
terms in order of falling bounds, those at the end whose bounds together stay under the query's k-th best score so far
are non-essential: a row in none of the other lists can't get in.  The lists of the essential terms are traversed and
their products added up; rows whose sum and the other bounds stay competitive are probed for what they lose by the
essential terms, then for the non-essential terms in steps, and the survivors' exact scores raise the threshold.

Few queries (QUERIES, a checked size) are broadcast, and each task searches its rows in shards.  More queries are dealt
into blocks and rows into tiles of TILE rows: a tile's rows meet a block's queries in one task, by a join on both numbers.
Each task or tile keeps k rows for each query, and the lists are merged by a window of k rows.  No row is sampled or left
out: results are exact.

Sums are taken in doubles while these are exact, in 64-bit integers while they can't overflow, and else in integers of
any size; scores beyond the range of a long come out as its limits.

Defined cases: vectors that are null, or hold a null or non-finite component (also after scaling), take no part, nor do
rows without an id; empty vectors have the score 0 with each other; vectors of other lengths than the query's are no
candidates for it; ties go to the smaller id; a query is no candidate of its own (every row with its id is passed over);
equal ids with several vectors each take part, as queries and as candidates; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, trimmed

#: Queries of a broadcast, and of a block; rows of a tile, and of a shard; queries that pass a shard at once.
QUERIES, TILE, SHARD, TOGETHER = 2048, 1 << 16, 4096, 128
SCHEMA = "query bigint, query_id bigint, vec_id bigint, score bigint"
ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the vectors that take part. Doubles from 2**52 on have no fraction."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * scale).alias("x"))
    ok = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return rows.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform("x", whole).alias("v"))


def exact(rows: np.ndarray, other: float) -> np.ndarray:
    """rows in a type in which inner products with vectors of components up to other are exact."""
    size = float(np.abs(rows).max(initial=0)) * other * max(1, rows.shape[1])
    if size < 2.0**53:
        return rows.astype(np.float64)
    if size < 2.0**62:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape)


class Best:
    """The k best (score, -id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows = k, [([], []) for _ in range(n)]

    def floor(self, q: int):
        """The score to reach, None while any will do."""
        scores = self.rows[q][0]
        return scores[-1] if len(scores) == self.k else None

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        both = sorted(zip([-int(s) for s in scores], ids.tolist())) if len(ids) <= 4 * self.k else None
        if both is None:
            order = np.argsort(-scores, kind="stable")
            cut = scores[order[self.k - 1]]
            at = np.flatnonzero(scores >= cut)
            both = sorted(zip([-int(s) for s in scores[at]], ids[at].tolist()))
        held = [(-s, i) for s, i in zip(*self.rows[q])]
        merged = sorted(held + both[: self.k])[: self.k]
        self.rows[q] = ([-s for s, _ in merged], [i for _, i in merged])


class Shard:
    """Rows with the posting lists of every dimension and sign. Lists of more than an eighth of the rows are held dense,
    as the impacts of all rows (0 outside the list), the others as rows and impacts in order of falling impact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, self.sides = ids, rows, []
        for sign in (1, -1):
            impacts = np.maximum(sign * rows, 0).T.copy()
            n = (impacts > 0).sum(axis=1)
            dense = np.flatnonzero(8 * n > len(rows))
            lists = []
            for d in np.flatnonzero((n > 0) & (8 * n <= len(rows))).tolist():
                at = np.flatnonzero(impacts[d] > 0)
                at = at[np.argsort(-impacts[d, at], kind="stable")]
                lists.append((d, at, impacts[d, at]))
            self.sides.append((sign, impacts.max(axis=1, initial=0), dense, np.ascontiguousarray(impacts[dense]), lists))

    def search(self, first: int, query_ids: np.ndarray, queries: np.ndarray, best: Best, step: int = 8) -> None:
        """Searches for queries, numbered from first, with components in the type of the rows."""
        bounds = sum(np.maximum(sign * queries, 0) * top for sign, top, *_ in self.sides)
        order = np.argsort(-bounds, axis=1, kind="stable")
        size = bounds.shape[1]
        left = np.zeros((len(queries), size + 1), self.rows.dtype)  # left[:, j]: bounds of the terms j and after
        if size:
            left[:, :-1] = np.cumsum(np.take_along_axis(bounds, order, axis=1)[:, ::-1], axis=1)[:, ::-1]
        floors = [best.floor(first + q) for q in range(len(queries))]
        essential = np.array([size if f is None else int((left[q, :-1] >= f).sum()) for q, f in enumerate(floors)], np.int64)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(size), order.shape), axis=1)
        weights = np.where(place < essential[:, None], queries, np.zeros_like(queries))  # of the essential terms alone
        gained = np.zeros((len(queries), len(self.ids)), self.rows.dtype)
        for sign, _, dense, impacts, lists in self.sides:
            w = np.maximum(sign * weights, 0)
            if len(dense):
                gained = gained + w[:, dense] @ impacts
            for d, rows, falling in lists:
                asking = np.flatnonzero(w[:, d] > 0)
                if len(asking):
                    gained[np.ix_(asking, rows)] += w[asking, d][:, None] * falling
        # exact sums of the essential terms: what was gained, less what is lost where a row's sign is another
        exactly = weights @ self.rows.T
        for q, floor in enumerate(floors):
            n = int(essential[q])
            # with no threshold, or one of 0 or less, rows in no list may get in
            seen = self.ids != query_ids[q]
            if floor is not None:
                seen &= gained[q] + left[q, n] >= floor
                seen &= exactly[q] + left[q, n] >= floor
                if floor > 0:
                    seen &= gained[q] > 0
            at = np.flatnonzero(seen)
            score, j = exactly[q, at], n
            while j < size and len(at):
                some = order[q, j : j + step]
                score = score + self.rows[np.ix_(at, some)] @ queries[q, some]
                j += len(some)
                if floor is not None:
                    keep = score + left[q, j] >= floor
                    at, score = at[keep], score[keep]
            if len(at):
                best.add(first + q, self.ids[at], score)


class Searcher:
    """The k best rows of each of a block of queries: by_size has (numbers, ids, vectors) of the queries of a length."""

    def __init__(self, by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> None:
        self.queries, self.k = by_size, k
        self.best = {n: Best(len(ids), k) for n, (_, ids, _) in by_size.items()}
        self.pending: dict[int, list] = {}

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(sizes).tolist():
            if n not in self.queries:
                continue
            which = np.flatnonzero(sizes == n)
            for a in range(0, len(which), SHARD):
                some = which[a : a + SHARD]
                self.pending.setdefault(n, []).append((ids[some], matrix(column.take(pa.array(some)), n)))
                if sum(len(p[0]) for p in self.pending[n]) >= SHARD:
                    self.flush(n)

    def flush(self, n: int) -> None:
        parts = self.pending.pop(n, [])
        if not parts:
            return
        ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, query_ids, queries = self.queries[n]
        shard = Shard(ids, exact(rows, float(np.abs(queries).max(initial=0))))
        asked = queries.astype(shard.rows.dtype) if shard.rows.dtype != object else exact(queries, float("inf"))
        for a in range(0, len(query_ids), TOGETHER):
            shard.search(a, query_ids[a : a + TOGETHER], asked[a : a + TOGETHER], self.best[n])

    def found(self) -> pa.Table:
        """(query, query_id, vec_id, score)."""
        for n in list(self.pending):
            self.flush(n)
        out: list[list] = [[], [], [], []]
        for n, (numbers, ids, _) in sorted(self.queries.items()):
            for number, query_id, (scores, rows) in zip(numbers.tolist(), ids.tolist(), self.best[n].rows):
                out[0] += [number] * len(rows)
                out[1] += [query_id] * len(rows)
                out[2] += rows
                out[3] += [max(-MOST - 1, min(MOST, s)) for s in scores]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=ARROW)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def by_size(numbers: np.ndarray, ids: np.ndarray, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries by their length, for Searcher."""
    sizes, out = column.value_lengths().to_numpy(zero_copy_only=False), {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = numbers[at], ids[at], matrix(column.take(pa.array(at)), n)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = QUERIES, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query row with all other rows."""
    rows = quantised(vectors, scale, id_col, vec_col)
    asked = quantised(queries, scale, id_col, vec_col)
    count = asked.count()
    hits = broadcast_hits(rows, asked, k) if count <= block else tiled_hits(rows, asked, k, -(-count // block), tile)
    w = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def broadcast_hits(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each task, for few queries."""
    table = asked.toArrow().combine_chunks()
    ids = table.column("vec_id").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(by_size(np.arange(len(ids)), ids, pa.concat_arrays(table.column("v").chunks) if len(ids) else pa.array([], pa.list_(pa.float64()))))

    def run(batches):
        searcher = Searcher(held.value, k)
        for batch in trimmed(batches):
            searcher.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
        yield from searcher.found().to_batches()

    return rows.mapInArrow(run, SCHEMA)


def tiled_hits(rows: DataFrame, asked: DataFrame, k: int, blocks: int, tile: int) -> DataFrame:
    """The k best rows of each tile of rows, for queries in so many blocks."""
    tiles = max(1, -(-rows.count() // tile))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # queries get numbers, so that equal ids with several vectors stay apart
    numbered = stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    asking = numbered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).select("query", "vec_id", "v", "block", every(tiles).alias("tile"))
    asked_of = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int")).select("vec_id", "v", "tile", every(blocks).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t: pa.concat_arrays(t.column("v").chunks) if t.num_rows else pa.array([], pa.list_(pa.float64()))
        if not left.num_rows or not right.num_rows:
            return ARROW.empty_table()
        searcher = Searcher(by_size(right.column("query").to_numpy(), right.column("vec_id").to_numpy(), column(right)), k)
        searcher.add(left.column("vec_id").to_numpy(), column(left))
        return searcher.found()

    return asked_of.groupBy("tile", "block").cogroup(asking.groupBy("tile", "block")).applyInArrow(run, SCHEMA)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The search for the rows whose vec_id is divisible by every."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)


#: DuckDB SQL for nearest(). (Fixed text: the same arithmetic by brute force.)
NEAREST_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
