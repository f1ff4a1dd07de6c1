"""Benchmark decontamination: latent semantic retrieval (distributed randomised SVD of TF-IDF passages), then LCS and answer checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import giving_back, materialize, row_key, word_hashes_of

#: Words are terms by their hash, in so many slots; passages of this many words of all documents span the latent space, of this rank.
SLOTS, PASSAGE, RANK, OVERSAMPLE = 1 << 14, 1024, 40, 8
#: A stretch of a document is a candidate for an item from this latent cosine on.
LEAST_COSINE = 0.3
#: Of an item's words, in order: this share settles it; this share does if its answer is there too.
LCS_ALONE, LCS_WITH_ANSWER, LEAST_ANSWER = 0.75, 0.55, 0.8
ANSWER_WORDS = 5
#: The share of an item's words, rare first, of which stretches are looked up.
LOOKED_UP = 0.6
#: Benchmark text that one search holds at most; more is searched in several passes over the same space.
BLOCK_BYTES = 64 << 20
BLOCK = 512
_SPLIT = bytes(32 if chr(b) in " \t\n\r\x0b\x0c.,;:!?\"'()[]{}|*#<>_-" else b for b in range(256))
FOUND = "doc_id long, row long, item_id long, cosine double, lcs int, item_words int, lcs_share double, answer_share double"


def passage_hashes_of(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's lower-cased words, cut at white space and punctuation."""
    return word_hashes_of(t.lower().encode().translate(_SPLIT) for t in texts)


def passage_hashes(text: str) -> np.ndarray:
    return next(passage_hashes_of([text]))


def slots_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & places.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _blocks(table: np.ndarray) -> pa.RecordBatch:
    """A table's blocks of rows that aren't all zero."""
    at = [k for k in range(-(-len(table) // BLOCK)) if table[k * BLOCK : (k + 1) * BLOCK].any()]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([table[k * BLOCK : (k + 1) * BLOCK].astype(np.float64).tobytes() for k in at], pa.binary())], ["block", "v"])


def _summed(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of the tasks' tables, added up block by block on the executors: rows x width numbers reach the driver."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total = total + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])

    out = np.zeros((rows, width))
    for r in parts.groupBy("block").applyInArrow(add, "block int, v binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["v"]).reshape(-1, width)
    return out


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of each slot over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((SLOTS + 1, 1))
        for batch in batches:
            for h in passage_hashes_of(t.as_py() for t in batch.column(2)):
                df[np.unique(slots_of(h))] += 1
                df[SLOTS] += 1
        yield _blocks(df)

    df = _summed(_texts(docs).mapInArrow(giving_back(run), "block int, v binary"), SLOTS + 1, 1)[:, 0]
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 1


def weights(slots: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's TF-IDF vector of length one: its slots and their weights."""
    if len(slots) < 128:
        t, n = np.unique(slots, return_counts=True)
    else:
        n = np.bincount(slots)
        t = np.flatnonzero(n)
        n = n[t]
    w = n * idf[t]
    return t, w / np.linalg.norm(w)


def latent_basis(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """SLOTS x rank: the leading right singular vectors of the TF-IDF matrix A of all passages of all documents.

    Randomised SVD in one pass: A'A G for a Gaussian G is summed across partitions, so SLOTS x
    (rank + OVERSAMPLE) numbers reach the driver at any size; the vectors are those of the Nystroem approximation of A'A.
    """
    k = rank + OVERSAMPLE
    g = np.random.default_rng(seed).standard_normal((SLOTS, k))
    shared = docs.sparkSession.sparkContext.broadcast((g.astype(np.float32), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, idf = shared.value
        total = np.zeros(g.shape, np.float32)
        for batch in batches:
            for h in passage_hashes_of(t.as_py() for t in batch.column(2)):
                s = slots_of(h)
                for a in range(0, len(s), PASSAGE):
                    t, w = weights(s[a : a + PASSAGE], idf)
                    w = w.astype(np.float32)
                    total[t] += w[:, None] * (w @ g[t])
        yield _blocks(total)

    y = _summed(_texts(docs).mapInArrow(giving_back(run), "block int, v binary"), SLOTS, k)
    core = g.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * max(float(values.max()), 1e-300)
    u = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0] if good.any() else np.zeros((SLOTS, 1))
    return u[:, :rank]


@dataclass
class Items:
    """A block of benchmark items, and for each looked-up term the items that look for it."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    latent: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    posting: np.ndarray
    need: np.ndarray
    vocabulary: list[np.ndarray]
    looked: list[np.ndarray]


def items_of(rows: list, idf: np.ndarray, basis: np.ndarray) -> Items:
    """Items with words; an item's answer is what follows its last 'answer:', or else its last ANSWER_WORDS words.

    Whatever stretch passes the checks for an item of n words holds LCS_WITH_ANSWER * n of them at least, so
    of any m of its words all but what the other n - m can make up; the m looked up are those that are
    rarest in documents and benchmark, so few stretches hold as many as they `need`.
    """
    ids, words, answers, latent = [], [], [], []
    for item_id, text in sorted(rows):
        h = passage_hashes(text)
        if len(h):
            _, mark, tail = text.lower().rpartition("answer:")
            ids.append(item_id)
            words.append(h)
            answers.append(passage_hashes(tail) if mark else h[-ANSWER_WORDS:])
            t, w = weights(slots_of(h), idf)
            latent.append(w @ basis[t])
    common = Counter(x for h in words for x in set(h.tolist()))
    looked, need = [], []
    for h in words:
        n, counts = len(h), Counter(h.tolist())
        order = sorted(counts, key=lambda x: (math.log(common[x]) - idf[x % SLOTS], x))
        own, m = [], 0
        while m < LOOKED_UP * n:
            own.append(order[len(own)])
            m += counts[own[-1]]
        looked.append(own)
        need.append(max(1, math.ceil(LCS_WITH_ANSWER * n - 1e-9) - (n - m)))
    pairs = sorted((x, i) for i, own in enumerate(looked) for x in own)
    terms, first = np.unique(np.array([x for x, _ in pairs], np.uint64), return_index=True)
    vocabulary = [np.unique(h) for h in words]
    z = np.array(latent).reshape(len(ids), -1)
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return Items(ids, words, answers, z / np.where(norm > 0, norm, 1), terms, np.append(first, len(pairs)), np.array([i for _, i in pairs], np.int64), np.array(need, np.int64), vocabulary, [np.isin(v, np.array(own, np.uint64)) for v, own in zip(vocabulary, looked)])


def stretches(h: np.ndarray, items: Items, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, start, stop) of a document's words: within them, one and a half times an item's length holds as many of its looked-up words as it needs."""
    at = np.minimum(np.searchsorted(items.terms, h), len(items.terms) - 1)
    place = np.flatnonzero(items.terms[at] == h)
    if not len(place):
        return []
    at = at[place]
    many = items.first[at + 1] - items.first[at]
    pos = np.repeat(place, many)
    inner = np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
    item = items.posting[np.repeat(items.first[at], many) + inner]
    order = np.argsort(item, kind="stable")
    item, pos = item[order], pos[order]
    last = np.arange(len(item)) + items.need[item] - 1
    inside = np.minimum(last, len(item) - 1)
    ok = np.flatnonzero((last < len(item)) & (item[inside] == item) & (2 * (pos[inside] - pos) < 3 * lengths[item]))
    out: list[tuple[int, int, int]] = []
    for j in ok.tolist():
        i, a, b = int(item[j]), int(pos[j]), int(pos[inside[j]]) + 1
        n = int(lengths[i])
        a, b = max(0, a - n), min(len(h), b + n)
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = i, out[-1][1], max(b, out[-1][2])
        else:
            out.append((i, a, b))
    return out


def search(docs: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Each document's best match with each item that passes the checks (FOUND)."""
    held = docs.sparkSession.sparkContext.broadcast((items, idf, basis.astype(np.float32)))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int32()), ("item_words", pa.int32()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis = held.value
        lengths = np.array(list(map(len, items.words)), np.int64)
        for batch in batches:
            out = []
            hashes = passage_hashes_of(t.as_py() for t in batch.column(2))
            for doc_id, row, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes):
                for i, start, stop in stretches(h, items, lengths):
                    n, own, answer = int(lengths[i]), items.words[i], items.answers[i]
                    best = None
                    # Twice the item's length at a time, half of it apart: each stretch of one and a half times its length is whole in one.
                    step, at = max(1, n // 2), np.minimum(np.searchsorted(items.vocabulary[i], h[start:stop]), len(items.vocabulary[i]) - 1)
                    among = items.vocabulary[i][at] == h[start:stop]
                    counts = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(np.column_stack((among, among & items.looked[i][at])), axis=0)))
                    first = np.arange(0, max(1, stop - start - 2 * n + step), step)
                    inside = counts[np.minimum(first + 2 * n, len(among))] - counts[first]
                    for a in first[(inside[:, 0] >= LCS_WITH_ANSWER * n - 1e-9) & (inside[:, 1] >= items.need[i])].tolist():
                        part, hits = h[start + a : min(stop, start + a + 2 * n)], np.flatnonzero(among[a : a + 2 * n])
                        if not len(hits):
                            continue
                        # The passage is the item's length around the middle of the item's words.
                        mid = int(hits[(len(hits) - 1) // 2] + hits[len(hits) // 2]) // 2
                        t, w = weights(slots_of(part[max(0, mid - n // 2 - 1) : mid + n // 2 + 2]), idf)
                        z = w @ basis[t]
                        cosine = float(z @ items.latent[i]) / max(float(np.linalg.norm(z)), 1e-12)
                        if cosine < LEAST_COSINE:
                            continue
                        held_words = part[hits]  # other words, none of which is the answer's, add nothing
                        size = lcs_length(own, held_words)
                        share, answered = size / n, lcs_length(answer, held_words) / len(answer) if len(answer) else 0.0
                        if share >= LCS_ALONE or (share >= LCS_WITH_ANSWER and answered >= LEAST_ANSWER):
                            best = max(best or (0,), (size, answered, cosine, share))
                    if best:
                        out.append((doc_id, row, items.ids[i], min(1.0, best[2]), best[0], n, best[3], best[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return _texts(docs).mapInArrow(giving_back(run), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row, item_id, cosine, lcs, item_words, lcs_share, answer_share): documents that hold a benchmark item; row is the row_key.

    Whole texts are searched, for items of any length, verbatim or paraphrased: stretches that hold
    enough of an item's words to pass the checks at all, of these the candidates by cosine in a
    latent space of all documents' passages, then the words of the item found in order, and its answer.
    One row per item and different (doc_id, text). Null and empty texts and items match nothing; items of
    equal id are items of their own, reported once; other columns aren't read; an empty table gives an empty result. The space
    is learnt once; items are searched in one pass for each block_bytes of benchmark text.
    """
    spark = docs.sparkSession
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return spark.createDataFrame([], FOUND)
    idf = inverse_frequencies(docs)
    basis = latent_basis(docs, idf)
    n_blocks, out = -(-size // block_bytes), None
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()  # about block_bytes
        items = items_of([(r["item_id"], r["text"]) for r in rows], idf, basis)
        if items.ids:
            part = search(docs, items, idf, basis)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], FOUND)
    best = F.max(F.struct("lcs_share", "lcs", "answer_share", "cosine", "item_words")).alias("m")
    return materialize(out, "bench-found").groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", F.round("m.cosine", 4).alias("cosine"), "m.lcs", "m.item_words", F.round("m.lcs_share", 4).alias("lcs_share"), F.round("m.answer_share", 4).alias("answer_share"))
