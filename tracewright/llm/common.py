"""Shared pieces of the training-data operators: scratch tables, words, connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java pattern: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs a reread and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that returns freed memory to the system at its end.

    Python workers stay for later tasks and stages, and what a task has freed would stay with each of them.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def as_text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's doc_id and text: rows that are equal in both are the same row."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def words_of(data: bytes) -> list[bytes]:
    """ASCII-lower-cased words; bytes.split() splits at exactly space and \\x09-\\x0D."""
    return data.lower().split()


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_ODD = 0x9E3779B97F4A7C15
#: Texts are hashed in pieces of at most so many bytes, whatever the length of a text or of a word.
PIECE_BYTES = 1 << 20
#: Of each byte what it adds to its word: nothing if it is a space.
_VALUES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)
_powers = _inverses = np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, at least n of them; n is at most PIECE_BYTES."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 256)
        _powers, _inverses = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_sums(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and polynomial sums of a piece's words; with `inside`, what continues a word at the piece's first byte counts as starting there."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    if inside:
        first[0] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    # By the place in the piece; a word's sum is taken back to its own start.
    powers, inverses = _powers_to(len(data))
    values = _VALUES[data]
    values *= powers[: len(data)]
    return starts, np.add.reduceat(values, starts) * inverses[starts]


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text's bytes starts, and its 64-bit hash: polynomials of its bytes, scrambled.

    A text is read in pieces, and a word that goes on in the next piece adds up over them, so beyond 16
    bytes a word memory is bounded by the piece.
    """
    if 0 < len(data) <= PIECE_BYTES:
        own, values = _word_sums(data, False)
        return own, mixed(values)
    starts: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    length = 0  # of the word that the last piece ended in
    for a in range(0, len(data), PIECE_BYTES):
        piece = data[a : a + PIECE_BYTES]
        own, values = _word_sums(piece, length > 0)
        if length:
            with np.errstate(over="ignore"):
                sums[-1][-1] += values[0] * np.uint64(pow(_ODD, length, 1 << 64))
            spaces = _SPACE[piece]
            length = length + len(piece) if not spaces.any() else 0
            own, values = own[1:], values[1:]
        if len(own):
            starts.append(own + a)
            sums.append(values)
        if not length and not _SPACE[piece[-1]]:
            length = len(piece) - int(own[-1])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), mixed(np.concatenate(sums))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of a text's words, in order."""
    return hashed_words(data)[1]


#: Short texts are hashed together, up to about so many bytes.
TOGETHER = 1 << 16


def word_hashes_of(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """word_hashes of each text, in order; a call of numpy for some texts at a time instead of one for each."""
    some: list[bytes] = []
    size = 0

    def hashed() -> Iterator[np.ndarray]:
        starts, h = hashed_words(np.frombuffer(b" ".join(some), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in some])
        stops = np.searchsorted(starts, ends).tolist()
        yield from (h[a:b] for a, b in zip([0, *stops], stops))

    for text in texts:
        some.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from hashed()
            some, size = [], 0
    if some:
        yield from hashed()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps: each round rewires every node to the smallest
    node of its neighbourhood, with minima pre-aggregated before the shuffle, until no edge
    changes. Minima are written before they're joined, so that a hub's edges are a plain shuffle that
    adaptive execution splits. Self-loops and repeated edges are ignored; no edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return materialize(out.where("a <> b").distinct(), "star-edges")

    # Edges point from the larger node to the smaller one.
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    state = None
    for _ in range(max_rounds):
        after = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state or not after[0]:
            break
        state = after
        current = star(star(current, True), False)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
