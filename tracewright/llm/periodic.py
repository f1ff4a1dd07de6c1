"""Periodic runs of words: tiles per period octave, solved apart from their boundaries' Z-values, stitched per document and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import _SPACE, materialize, row_key, word_hashes_of

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The core of a tile has four boundaries' distances, and at least so many words.
LEAST_CORE = 4096
#: Rows are handed on in batches of about so many bytes.
BATCH_BYTES = 8 << 20
RUNS = "array<struct<start:long,period:long,length:long>>"
SCAN = "kind string, key long, doc_id long, text binary, octave int, tile long, base long, words binary, boundaries binary, periods binary"
FRAGMENT = "key long, doc_id long, period long, start long, end long"


def repeated_boundaries(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, boundaries, periods): where a document's tiles can hold a run with a smallest period in [2^octave, 2^(octave+1)).

    Boundaries are the multiples of 2^octave. A run of four periods q holds a boundary b with all of b .. b + 3q, so the
    2^(octave+1) > q words from b stand again q words later; fingerprints of such stretches come from those of half
    the length. Two such q at one boundary imply, by the periodicity lemma, a common divisor that is a period of both, so
    then neither is a smallest period: a boundary has one candidate or none, and an octave takes time linear in the words.
    """
    n, k = len(words), 0
    prints = words
    while n >= max(LEAST_WORDS, LEAST_PERIODS << k):
        half = 1 << k
        low = prints[:-half]
        prints = (low ^ (low >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + prints[half:]
        m = -(-len(prints) // half)
        if m < 2:
            return
        rows = np.zeros(m * half, np.uint64)
        rows[: len(prints)] = prints
        rows = rows.reshape(m, half)
        same = rows[1:] == rows[:-1, :1]
        if same.any():
            at = np.flatnonzero(same.sum(axis=1) == 1)
            if len(at):
                yield k, at * half, half + same[at].argmax(axis=1)
        k += 1


def tiles_of(words: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(octave, tile, base, words, boundaries, periods) of the overlapping tiles that hold a repeated boundary.

    A tile's core is dealt boundaries; its words reach 2^octave words before and 7 * 2^octave words after them, so a run's
    fragments in neighbouring tiles share at least a period. All boundaries within a run but those near its end are repeated
    ones, so what is farther from any of them holds no part of a run, and a tile is cut there.
    """
    for k, boundaries, periods in repeated_boundaries(words):
        core = max(4 << k, LEAST_CORE)
        tile = boundaries // core
        cuts = np.flatnonzero((np.diff(tile) > 0) | (np.diff(boundaries) > 8 << k)) + 1
        for own in np.split(np.arange(len(boundaries)), cuts):
            a, b = max(0, boundaries[own[0]] - (1 << k)), min(len(words), boundaries[own[-1]] + (7 << k))
            yield k, int(tile[own[0]]), int(a), words[a:b], boundaries[own] - a, periods[own]


def _numbered(words: np.ndarray) -> bytes:
    """Words as numbers within a tile, after a byte with their size."""
    numbers = np.unique(words, return_inverse=True)[1].ravel()
    kind = np.uint16 if numbers.max(initial=0) < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def _prime_divisors(q: int) -> Iterator[int]:
    r = 2
    while r * r <= q:
        if q % r == 0:
            yield r
            while q % r == 0:
                q //= r
        r += 1
    if q > 1:
        yield q


def solved(words: np.ndarray, boundaries: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches of a tile that keep a period, from its boundaries.

    The forward Z-value of a boundary b at shift q tells for how many words from b on the words q apart are equal, the
    backward one for how many before b. Stretches with a smaller period, and those that end inside the tile
    and are too short for a run, aren't returned.
    """
    out = []
    for q in np.unique(periods).tolist():
        own = np.sort(boundaries[periods == q])
        differ = np.flatnonzero(words[:-q] != words[q:])
        edges = np.concatenate(([-1], differ, [len(words) - q]))
        after = np.searchsorted(edges, own, "right").clip(max=len(edges) - 1)
        backward, forward = own - edges[after - 1] - 1, edges[after] - own
        for start, end in sorted({(int(b - z), int(b + y + q)) for b, z, y in zip(own, backward, forward) if y > 0}):
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * q) and start > 0 and end < len(words):
                continue
            root = words[start : start + q]
            if not any((root[: q - q // r] == root[q // r :]).all() for r in _prime_divisors(q)):
                out.append((q, start, end))
    return out


def joined_words(data: bytes, kept: np.ndarray | None = None) -> bytes:
    """A text's words (those kept, or all) joined by one space, some at a time."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if kept is not None:
        starts, ends = starts[kept], ends[kept]
    some = range(0, len(starts), 1 << 16)
    return b" ".join(b" ".join([data[a:b] for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist())]) for i in some)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes, np.ndarray]]:
    for batch in batches:
        keys, ids, texts = (batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))
        yield from zip(keys, ids, texts, word_hashes_of(texts))


def _gathered(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(x) for x in r.values() if isinstance(x, (bytes, list)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_SCAN = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("octave", pa.int32()), ("tile", pa.int64()), ("base", pa.int64()), ("words", pa.binary()), ("boundaries", pa.binary()), ("periods", pa.binary())])
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))
_RESULT = pa.schema([("doc_id", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of documents with repeated boundaries, and these documents' texts."""

    def rows() -> Iterator[dict]:
        for key, doc_id, text, words in _rows(batches):
            some = False
            for k, t, base, part, boundaries, periods in tiles_of(words):
                some = True
                yield {"kind": "tile", "key": key, "doc_id": doc_id, "octave": k, "tile": t, "base": base, "words": _numbered(part), "boundaries": boundaries.astype(np.int64).tobytes(), "periods": periods.astype(np.int64).tobytes()}
            if some:
                yield {"kind": "text", "key": key, "doc_id": doc_id, "text": text}

    return _gathered(rows(), _SCAN)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of documents without repeated boundaries: no runs, all words."""
    return _gathered(({"doc_id": doc_id, "runs": [], "collapsed": joined_words(text)} for _, doc_id, text, words in _rows(batches) if next(repeated_boundaries(words), None) is None), _RESULT)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int | None, int, int, int]] = []
        for key, doc_id, base, words, boundaries, periods in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "base", "words", "boundaries", "periods"))):
            found = solved(np.frombuffer(words, f"<u{words[0]}", offset=1), np.frombuffer(boundaries, np.int64), np.frombuffer(periods, np.int64))
            out += [(key, doc_id, q, base + s, base + e) for q, s, e in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], [], [], []))], names=["key", "doc_id", "period", "start", "end"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                ends = [r["start"] + r["length"] for r in runs]
                dropped = np.zeros(max(ends, default=0) + 1, np.int64)
                for r, end in zip(runs, ends):
                    dropped[r["start"] + r["period"]] += 1
                    dropped[end] -= 1
                inside = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True])).view(np.int8)))
                kept = np.ones(len(inside) // 2, bool)
                kept[: len(dropped) - 1] = np.cumsum(dropped)[:-1][: len(kept)] == 0
                yield {"doc_id": doc_id, "runs": runs, "collapsed": joined_words(text, kept)}

    return _gathered(rows(), _RESULT)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): each document's runs by start and period, and its words without those that a run repeats.

    A run is a stretch of words with smallest period q and length >= max(6, 4 * q) that no neighbouring word extends; a word is left out
    if a run holds it after the run's first q words. docs: doc_id and text; a null text has no words, a null doc_id is carried, rows
    are kept one by one (equal rows give equal results), further columns are ignored and an empty table gives no rows. Words are
    compared by 64-bit hashes.

    Documents without a repeated boundary are done in the first scan. Of the others the tiles are written, dealt out by document,
    octave and place whatever the documents' lengths, and only their texts are shuffled to be collapsed. Only at octaves near
    its own length does a tile hold a whole document.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    scanned = materialize(own.mapInArrow(_scan, SCAN), "tiles")
    tiles = scanned.where("kind = 'tile'").select("key", "doc_id", "octave", "tile", "base", "words", "boundaries", "periods").repartition("key", "octave", "tile", "base")
    fragments = tiles.mapInArrow(_solve, FRAGMENT).distinct()
    by = Window.partitionBy("key", "doc_id", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= F.col("before") - F.col("period"), 0).otherwise(1)
    stitched = fragments.withColumn("before", before).withColumn("no", F.sum(fresh).over(by)).groupBy("key", "doc_id", "period", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long_enough = F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST_WORDS), F.col("period") * LEAST_PERIODS)
    runs = stitched.where(long_enough).groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "period", (F.col("end") - F.col("start")).alias("length")))).alias("runs"))
    found = runs.select(F.col("key").alias("r_key"), F.col("doc_id").alias("r_doc_id"), "runs")
    same = (F.col("key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
    texts = scanned.where("kind = 'text'").select("key", "doc_id", "text").join(found, same, "left").withColumn("runs", F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")))
    schema = f"doc_id long, runs {RUNS}, collapsed string"
    return own.mapInArrow(_plain, schema).unionByName(texts.select("doc_id", "text", "runs").mapInArrow(_collapse, schema))


def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, h, text) of which those with h % 10 = 0 repeat words: with g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), word i >= a is the original a + (i - a) % p."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
                if text and h is not None and h % 10 == 0:
                    space = _SPACE[np.frombuffer(text, np.uint8)]
                    n = len(np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))) // 2
                    if n:
                        g = h // 10
                        a = g % n
                        at = np.arange(n)
                        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
                        text = joined_words(text, at)
                yield {"doc_id": doc_id, "text": text}

    return _gathered(rows(), pa.schema([("doc_id", pa.int64()), ("text", pa.binary())]))
