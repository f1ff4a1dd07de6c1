"""Hard-negative mining: exact integer inner products of many candidates by one wide multiplication per anchor component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import scratch_path

#: Candidates that a task holds at once, and candidates (fields) of one wide integer.
CHUNK, FIELDS = 65536, 2048
LONG = (1 << 63) - 1


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<double>) of the rows that take part: no null in vec_id, label or vector, finite components of which 256 times is finite too."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


class Packed:
    """Candidates of one length as one wide integer per component, with a field for each candidate.

    Fields hold components less the smallest one, so they're never negative; an anchor's components get a
    bias too. A field's sum of products is the inner product plus terms that are known: the bias times
    the candidate's sum, and the shift times the anchor's biased sum.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels = ids, labels
        self.n, self.d = values.shape
        low, high = (float(values.min()), float(values.max())) if values.size else (0.0, 0.0)
        self.low, self.high = int(low), int(high)
        self.plain = max(-low, high) < 2.0**62
        self.ints = values.astype(np.int64) if self.plain else np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
        self.sums = self.ints.sum(axis=1) if self.d else np.zeros(self.n, np.int64)
        self.label_range = (labels.min(), labels.max())
        self._wide: dict[int, list[int]] = {}

    def wide(self, width: int) -> list[int]:
        """The wide integer of each component, with fields of `width` bytes."""
        if width not in self._wide:
            shifted = self.ints - self.low
            if width <= 8:
                fields = [np.ascontiguousarray(shifted[:, j].astype(f"<u{width}")).tobytes() for j in range(self.d)]
            else:
                fields = [b"".join(int(x).to_bytes(width, "little") for x in shifted[:, j]) for j in range(self.d)]
            self._wide[width] = [int.from_bytes(x, "little") for x in fields]
        return self._wide[width]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products with an anchor, exact: int64, or Python integers where they don't fit."""
        bias = max(0, -min(anchor, default=0))
        biased = [a + bias for a in anchor]
        total = sum(biased)
        most = max(total * (self.high - self.low), self.high - self.low)
        small = self.plain and most < 1 << 63 and sum(map(abs, anchor)) * max(abs(self.low), abs(self.high)) < 1 << 62
        width = (4 if most < 1 << 32 else 8) if small else -(-max(most, 1).bit_length() // 8) + 8
        product = 0
        for a, w in zip(biased, self.wide(width)):
            product += a * w
        data = product.to_bytes(width * self.n, "little")
        if small:
            # Modulo 2^64: the terms may be beyond it, the result isn't.
            fields = np.frombuffer(data, f"<u{width}").astype(np.uint64)
            known = np.uint64(-self.low * total % (1 << 64)) + self.sums.astype(np.uint64) * np.uint64(bias % (1 << 64))
            return (fields - known).astype(np.int64)
        fields = (int.from_bytes(data[i * width : (i + 1) * width], "little") for i in range(self.n))
        out = np.empty(self.n, object)
        out[:] = [f + self.low * total - bias * int(s) for f, s in zip(fields, self.sums)]
        return out


def best(some: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k highest scores among the places `some`, ties to the smaller id."""
    if scores.dtype == object:
        return sorted(((int(scores[i]), int(ids[i])) for i in some), key=lambda x: (-x[0], x[1]))[:k]
    own = scores[some]
    if len(some) > k:
        least = np.partition(own, len(some) - k)[len(some) - k]
        some = some[own >= least]
        own = scores[some]
    order = np.lexsort((ids[some], -own))[:k]
    return list(zip(own[order].tolist(), ids[some][order].tolist()))


def _blocks(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], fields: int) -> dict[int, list[Packed]]:
    """Held rows (ids, labels, lengths, flat components) as packed blocks by length, each of neighbouring labels."""
    out: dict[int, list[Packed]] = {}
    ids, labels, sizes = (np.concatenate([r[i] for r in rows]) for i in range(3))
    flat, ends = np.concatenate([r[3] for r in rows]), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        own = own[np.argsort(labels[own], kind="stable")]
        for a in range(0, len(own), fields):
            at = own[a : a + fields]
            out.setdefault(d, []).append(Packed(ids[at], labels[at], flat[(ends[at] - d)[:, None] + np.arange(d)]))
    return out


def _held(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, v = (batch.column(c) for c in ("vec_id", "label", "v"))
    return ids.to_numpy(), labels.to_numpy(), np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64), np.floor(np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)


def score_columns(scores: list[int]) -> list[pa.Array]:
    """Scores as longs, clamped, and where they are beyond a long also as digits that sort as numbers do."""
    return [pa.array([max(-LONG, min(LONG, s)) for s in scores], pa.int64()), pa.array([None if abs(s) < LONG else f"{s + 10**120:0122d}" for s in scores], pa.string())]


def _search(uri: str, found, names: tuple[str, ...], scale: int, chunk: int, fields: int):
    """For mapInArrow over candidates: the anchors at `uri`, read in turn, against each chunk of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(rows: list) -> Iterator[pa.RecordBatch]:
            blocks = _blocks(rows, fields)
            fs, path = FileSystem.from_uri(uri)
            for anchors in dataset.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=1024, batch_readahead=1, fragment_readahead=1):
                out = [x for a in anchors.to_pylist() for x in found(a, [int(c * scale // 1) for c in a["v"]], blocks.get(len(a["v"]), []))]
                if out:
                    *keys, scores = zip(*out)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), *score_columns(list(scores))], names=[*names, "score", "wide"])

        rows: list = []
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                if held + part.num_rows > chunk:
                    yield from searched(rows)
                    rows, held = [], 0
                rows.append(_held(part, scale))
                held += part.num_rows
        if held:
            yield from searched(rows)

    return run


def mine_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = 256, chunk: int = CHUNK, fields: int = FIELDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the best positives of each anchor, the best negatives near them.

    vectors: vec_id, label, embedding; anchors: a condition on vec_id. A row's score is its integer inner
    product with the anchor, of components floor(scale * x); higher first, ties to the smaller vec_id. An anchor's
    positives are its first rows of the same label under another vec_id, a positive's negatives the first rows
    of another label whose score is at most the positive's and at least low[0] / low[1] of it.
    Only vectors of the anchor's length count; a null vec_id, label or vector, and null or non-finite components
    take no part; repeated rows each count, repeated anchors once; scores beyond 64 bits are compared exactly and
    returned as the nearest long. Empty tables give no rows, and further columns are ignored.

    Candidates are dealt evenly and stay where they are; a task packs some and reads the anchors, a written
    table, in turn. So the shuffles are one of the candidates and one of a few rows per anchor and task.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    groups = max(spark.sparkContext.defaultParallelism, -(-rows.count() // chunk))

    def stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    uri, asked = stored(rows.where(anchors).distinct().withColumn("akey", F.xxhash64("vec_id", "label", "v")), "anchors")
    dealt = rows.repartition(groups)

    def own_label(a: dict, v: list[int], blocks: list[Packed]):
        top: list[tuple[int, int]] = []
        for b in blocks:
            if b.label_range[0] <= a["label"] <= b.label_range[1]:
                some = np.flatnonzero((b.labels == a["label"]) & (b.ids != a["vec_id"]))
                if len(some):
                    top += best(some, b.scores(v), b.ids, positives)
        return [(a["akey"], i, s) for s, i in sorted(top, key=lambda x: (-x[0], x[1]))[:positives]]

    order = (F.desc("score"), F.desc("wide"), F.col("vec_id"))
    near = dealt.mapInArrow(_search(uri, own_label, ("akey", "vec_id"), scale, chunk, fields), "akey long, vec_id long, score long, wide string")
    near = near.withColumn("p_no", F.row_number().over(Window.partitionBy("akey").orderBy(*order))).where(F.col("p_no") <= positives)
    gathered = near.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("p_no", "vec_id", "score", "wide"))).alias("positives"))  # some each
    paired_uri, paired = stored(asked.join(gathered, "akey"), "positives")

    def other_label(a: dict, v: list[int], blocks: list[Packed]):
        bounds = []
        for p in a["positives"]:
            high = int(p["wide"]) - 10**120 if p["wide"] else p["score"]
            bounds.append((p["p_no"], -(-high * low[0] // low[1]), high))
        bounds = [b for b in bounds if b[1] <= b[2]]
        top: dict[int, list[tuple[int, int]]] = {b[0]: [] for b in bounds}
        for b in blocks if bounds else []:
            if b.label_range[0] == b.label_range[1] == a["label"]:
                continue
            scores = b.scores(v)
            inside = np.flatnonzero((b.labels != a["label"]) & (scores >= min(x[1] for x in bounds)) & (scores <= max(x[2] for x in bounds)))
            for no, least, most in bounds if len(inside) else []:
                own = scores[inside]
                top[no] += best(inside[(own >= least) & (own <= most)], scores, b.ids, negatives)
        return [(a["akey"], no, i, s) for no, found in top.items() for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:negatives]]

    hard = dealt.mapInArrow(_search(paired_uri, other_label, ("akey", "p_no", "vec_id"), scale, chunk, fields), "akey long, p_no long, vec_id long, score long, wide string")
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("akey", "p_no").orderBy(*order))).where(F.col("rank") <= negatives)
    pairs = paired.select("akey", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("akey", "anchor_id", F.col("p.p_no").cast("long").alias("p_no"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return pairs.join(hard, ["akey", "p_no"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
