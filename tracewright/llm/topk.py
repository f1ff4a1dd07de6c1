"""Exact top-k inner-product search by no-random-access aggregation over sorted component lists."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.negatives import score_columns

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 512
#: Lists are read to these shares of their depths; at each the bounds are compared.
DEPTHS = (0.2, 0.4, 0.6, 0.8, 1.0)
#: A query's reading stops when at most this many times k candidates can still be among its best.
RESOLVED = 16
#: Sums of products below this are whole in double precision; beyond, scores are added up as Python integers.
WHOLE = 2.0**53


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component; vectors null or holding null, NaN or infinite components, or one that the scale makes infinite, go."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    # F.floor would give longs, which the largest components leave.
    whole = lambda x: x.cast("double") * scale
    floored = lambda x: F.when(F.abs(whole(x)) < WHOLE, F.floor(whole(x)).cast("double")).otherwise(whole(x))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floored).alias("v"))


def _pack(size: int):
    """Rows into blocks of at most `size` vectors of one length, within each partition: no shuffle, no unbounded group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(length: int) -> pa.RecordBatch:
            rows = held.pop(length)
            ids = np.array([r[0] for r in rows], np.int64)
            values = np.array([r[1] for r in rows], np.float64).reshape(len(rows), length)
            small = values.astype(np.int32) if not length or np.abs(values).max() < 2**31 else values
            return pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "block": pa.array([pickle.dumps((ids, small), 5)], pa.binary())})

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(row[1]), []).append(row)
                if len(held[len(row[1])]) == size:
                    yield block(len(row[1]))
        for length in list(held):
            yield block(length)

    return run


class SortedLists:
    """A block's candidates as one list per component, sorted by value; each is read from the end that a query's sign makes best."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order].astype(np.float64)
        self.n, self.d = self.values.shape
        self.largest = float(np.abs(self.values).max(initial=0))
        self.columns = np.ascontiguousarray(self.values.T, np.float32 if self.largest < 1e15 else np.float64)
        by_value = np.argsort(self.columns, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.columns, by_value, axis=1)
        self.place = np.empty((self.d, self.n), np.int32)
        np.put_along_axis(self.place, by_value, np.arange(self.n, dtype=np.int32)[None, :], axis=1)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the block's up to k best candidates among those that can reach its floor.

        All lists are read to one depth after another. A candidate's bounds are the sum of what has
        been read of it plus, for each list where it hasn't been met, the list's worst entry or
        the one read last. A query is done when no more than RESOLVED * k candidates can reach its
        k-th lower bound and its floor; those are resolved exactly.
        """
        out: list[tuple[np.ndarray, list[int]]] = [(np.empty(0, np.int64), [])] * len(query_ids)
        first, last_own = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        open_ = np.arange(len(query_ids))
        single = self.largest < 1e15 and float(np.abs(queries).max(initial=0)) < 1e15
        q = queries.astype(np.float32 if single else np.float64)
        # Bounds are in single precision, or in double precision for large components, kept apart by more than its error.
        slack = 1e-5 * (np.abs(q) @ np.abs(self.columns).max(axis=1)) + 0.5
        for depth in DEPTHS:
            t = -(-int(self.n * depth * 1000) // 1000) if depth < 1 else self.n
            t = max(1, min(self.n, t))
            high, low = self.place >= self.n - t, self.place < t
            x = q[open_]
            up, down = np.where(x >= 0, x, 0), np.where(x < 0, x, 0)
            read = up @ np.where(high, self.columns, 0) + down @ np.where(low, self.columns, 0)
            high, low = high.astype(np.float32), low.astype(np.float32)

            def unmet(high_entry: np.ndarray, low_entry: np.ndarray) -> np.ndarray:
                """What the lists where a candidate hasn't been met add at these entries."""
                a, b = up * high_entry, down * low_entry
                return (a.sum(axis=1) + b.sum(axis=1))[:, None] - a @ high - b @ low

            upper = read + unmet(self.sorted[:, self.n - t], self.sorted[:, t - 1])
            lower = read + unmet(self.sorted[:, 0], self.sorted[:, -1])
            for row, i in enumerate(open_):
                lower[row, first[i] : last_own[i]] = upper[row, first[i] : last_own[i]] = -np.inf
            kth = np.partition(lower, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.full(len(open_), -np.inf)
            least = np.maximum(kth - slack[open_], floors[open_] - 1e-12 * np.abs(floors[open_], where=np.isfinite(floors[open_]), out=np.zeros(len(open_))) - 0.5)
            alive = upper + slack[open_][:, None] >= least[:, None]
            done = (alive.sum(axis=1) <= RESOLVED * k) | (t == self.n)
            for row in np.flatnonzero(done):
                i = open_[row]
                some = np.flatnonzero(alive[row] & (upper[row] > -np.inf))
                scores = self.exact(some, queries[i])
                best = sorted(range(len(some)), key=lambda j: (-scores[j], self.ids[some[j]]))[:k]
                out[i] = self.ids[some[best]], [scores[j] for j in best]
            open_ = open_[~done]
            if not len(open_):
                break
        return out


    def exact(self, some: np.ndarray, query: np.ndarray) -> list[int]:
        """The inner products of candidates with a query, whatever their size."""
        own = self.values[some]
        if not own.size or float((np.abs(query.astype(np.float64)) * np.abs(own).max(axis=0)).sum()) < WHOLE:
            return [int(x) for x in own @ query.astype(np.float64)]
        q = [int(x) for x in query.tolist()]
        return [sum(a * int(b) for a, b in zip(q, row)) for row in own.tolist()]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Both tables hold vec_id and embedding. A query's candidates are the vectors of its length with
    another vec_id; queries with none give no rows. Rows of equal vec_id each take part; rows
    with a null vec_id, and null or non-finite vectors, take none. Scores are exact for components of any size; those beyond
    64 bits are compared exactly and returned as the nearest long. Empty tables give no rows.

    Query blocks meet candidate blocks by an equi-join on the vector length, the query block's
    number and one of a few groups of candidate blocks, so a task holds one block of each whatever
    the tables' sizes and the work spreads over more tasks than there are query blocks.
    """
    cast = scaled(vectors.where("vec_id is not null"), scale)
    asked = scaled(queries.where("vec_id is not null"), scale).dropDuplicates(["vec_id", "v"])
    total = asked.count()
    n_blocks = max(1, -(-total // query_block))
    groups = max(1, vectors.sparkSession.sparkContext.defaultParallelism * 2)
    dealt = asked.repartition(n_blocks, F.xxhash64("vec_id"))
    q = dealt.mapInArrow(_pack(query_block), "length int, block binary").withColumn("qb", F.pmod(F.xxhash64("block"), F.lit(n_blocks)).cast("int")).withColumnRenamed("block", "q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = cast.mapInArrow(_pack(candidate_block), "length int, block binary").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumnRenamed("block", "c")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}
        lists_of: tuple[bytes, SortedLists] | None = None
        for batch in batches:
            for q_block, c_block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q_ids, q_values = pickle.loads(q_block)
                if lists_of is None or lists_of[0] != c_block:
                    lists_of = c_block, SortedLists(*pickle.loads(c_block))
                lists = lists_of[1]
                # What this task has found so far is a floor: k candidates at least are known to reach it.
                known = floors.setdefault(xxhash.xxh3_128_digest(q_block), np.full((len(q_ids), k), -np.inf))
                out: list[tuple[np.ndarray, np.ndarray]] = []
                found_scores: list[int] = []
                for i, (ids, scores) in enumerate(lists.top(q_ids, q_values, k, known[:, 0])):
                    known[i] = np.sort(np.concatenate((known[i], np.array([float(x) for x in scores]))))[-k:]
                    out.append((np.full(len(ids), q_ids[i]), ids))
                    found_scores += scores
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)), *score_columns(found_scores)], ["query_id", "vec_id", "score", "wide"])

    pairs = c.join(q.hint("merge"), ["length", "qb", "g"]).select("q", "c")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long, wide string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
