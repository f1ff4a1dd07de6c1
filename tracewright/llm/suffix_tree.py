"""LM scoring with a probabilistic suffix tree over the characters of the word stream, beside a word-unigram base."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import as_text_bytes, give_back, giving_back, materialize, scratch_path, words_of

#: Symbols are 6 bits: the most frequent bytes have one each, the others share OTHER; END closes a text.
BITS, SPACE, OTHER, END = 6, 0, 62, 63
MASK = (1 << BITS) - 1
DEPTH = 7
#: A context may become a state if it occurs this often, whatever the size of the corpus.
LEAST_COUNT = 2
#: A state's divergence from its suffix, in nats over all its occurrences, beyond which it is kept.
DIVERGENCE = 12.0
#: Word counts up to this many rows are loaded by each worker (16 bytes a row); beyond it they're joined.
BROADCAST_WORDS = 8_000_000
#: The tree is loaded by each worker up to this many rows (12 bytes a row); beyond it, it's joined.
BROADCAST_STATES = 24_000_000
PIECE = 1 << 18
#: Texts are scored together, up to about so many symbols at a time and fewer than 2^16 texts: the more, the more of their grams are equal.
TOGETHER = 1 << 21
#: Ends the name under which a worker holds the tree's nodes.
DESCENTS = "#nodes"
#: Contexts of up to BASE symbols are one dense table; longer ones are dealt over tasks by their last NEAR symbols.
BASE, NEAR = 2, 3
#: Marks a context's row in the tree's table; its depth is in the three bits below.
STATE = 1 << 52


def held_out(doc_id) -> bool:
    """crc32 of the doc_id as text, mod 5, is 1; a null doc_id counts as the text ''."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words)


class Numbers(dict):
    """Numbers from 0 on for different keys, in the order in which they're first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


_loaded: dict[str, tuple[np.ndarray, np.ndarray] | Descents] = {}


def unload() -> None:
    """Drop the tables that an earlier scoring has left in this worker."""
    if _loaded:
        _loaded.clear()
        give_back()


def training(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that needs no table: workers stay for later queries, with the last one's tree in memory."""

    def wrapped(batches: Iterator) -> Iterator:
        unload()
        yield from run(batches)

    return giving_back(wrapped)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h long, c long): training tokens by the hash of the word, the end token's under the hash of a newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            nonlocal counts, ends
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(w) for w in counts), np.uint64, len(counts))
            c = np.fromiter(counts.values(), np.int64, len(counts))
            if ends:
                h, c = np.append(h, np.uint64(digest(b"\n"))), np.append(c, ends)
            counts, ends = Counter(), 0
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not held_out(doc_id):
                    counts.update(words_of(text.as_py()))
                    ends += 1
                if len(counts) > 1_000_000:
                    yield flush()
        yield flush()

    rows = docs.select("doc_id", as_text_bytes().alias("t")).mapInArrow(training(run), "h long, c long")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


def byte_symbols(docs: DataFrame) -> np.ndarray:
    """The symbol of each byte, from the training texts' byte counts; ties to the smaller byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not held_out(doc_id):
                    data = np.frombuffer(text.as_py().lower(), np.uint8)
                    total += np.bincount(data, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["b", "n"])

    found = docs.select("doc_id", as_text_bytes().alias("t")).mapInArrow(training(run), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    counts = np.zeros(256, np.int64)
    for r in found:
        counts[r["b"]] = r["n"]
    counts[[*range(9, 14), 32]] = 0  # white space separates words and becomes SPACE
    symbols = np.full(256, OTHER, np.uint8)
    for k, b in enumerate([int(b) for b in np.lexsort((np.arange(256), -counts)) if counts[b] > 0][: OTHER - 1]):
        symbols[b] = k + 1
    symbols[32] = SPACE
    return symbols


def coded(words: list[bytes], symbols: np.ndarray) -> np.ndarray:
    """A text's symbols: its words, SPACE between them, then END."""
    return np.append(symbols[np.frombuffer(stream(words), np.uint8)], np.uint8(END)).astype(np.int64)


def grams(s: np.ndarray, depth: int) -> np.ndarray:
    """For each place, the depth symbols before it (SPACE before the start) and its own, as one number."""
    padded = np.concatenate((np.zeros(depth, np.int64), s))
    out = np.zeros(len(s), np.int64)
    for k in range(depth + 1):
        out = (out << BITS) | padded[k : k + len(s)]
    return out


def turned(g: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n symbols with the symbols in the other order."""
    out = np.zeros(len(g), np.int64)
    for k in range(n):
        out = (out << BITS) | ((g >> BITS * k) & MASK)
    return out


def turned_grams(s: np.ndarray, depth: int) -> np.ndarray:
    """grams() with each place's own symbol first, then those before it from the nearest on: sorted, all their suffixes are too."""
    padded = np.concatenate((np.zeros(depth, np.int64), s))
    out = np.zeros(len(s), np.int64)
    for k in range(depth, -1, -1):
        out <<= BITS
        out |= padded[k : k + len(s)]
    return out


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def summed_counts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From (gram << 16 | count), which it sorts in place: the same with a row for each gram, and grams and counts of what is beyond 16 bits."""
    packed.sort()
    first = np.flatnonzero(np.concatenate(([True], packed[1:] ^ packed[:-1] > 0xFFFF)))
    n = np.add.reduceat(packed.astype("<u8", copy=False).view(np.uint16)[::4], first, dtype=np.int64)
    keys = packed[first] >> np.uint64(16)
    over = np.flatnonzero(n > 0xFFFF)
    return (keys << np.uint64(16)) | np.minimum(n, 0xFFFF).astype(np.uint64), keys[over].astype(np.int64), n[over] - 0xFFFF


def near_symbols() -> Column:
    """The last NEAR symbols of a gram's context: all that a task needs to grow the contexts that end in them."""
    return F.shiftright("g", BITS).bitwiseAND(F.lit((1 << BITS * NEAR) - 1))


def gram_counts(docs: DataFrame, symbols: np.ndarray, depth: int = DEPTH, every: bool = False) -> DataFrame:
    """(near long, g long, n long): training counts of each context of `depth` symbols with the symbol after it.

    Dealt by `near`. With `every`, grams of held-out texts alone are there too, with a count of 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # a number for a gram and its count: sorting needs no room beside them
        over: list[tuple[np.ndarray, np.ndarray]] = []
        pending: dict[int, list[np.ndarray]] = {0: [], 1: []}
        size = 0

        def merge() -> None:
            if held:
                packed = np.concatenate(held)
                held.clear()
                packed, *more = summed_counts(packed)
                held.append(packed)
                if len(more[0]):
                    over.append(tuple(more))

        def fold() -> None:
            nonlocal pending, size
            for training, some in pending.items():
                if some:
                    keys, n = np.unique(np.concatenate(some), return_counts=True)
                    n *= training
                    if len(at := np.flatnonzero(n > 0xFFFF)):
                        over.append((keys[at], n[at] - 0xFFFF))
                    held.append(keys.astype(np.uint64) << np.uint64(16) | np.minimum(n, 0xFFFF).astype(np.uint64))
            pending, size = {0: [], 1: []}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for at in range(0, len(held[0]) if held else 0, 200_000):
                part = held[0][at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array((part >> np.uint64(16)).astype(np.int64)), pa.array((part & np.uint64(0xFFFF)).astype(np.int64))], ["g", "n"])
            for keys, n in over:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["g", "n"])
            held.clear(), over.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                training = not held_out(doc_id)
                if not training and not every:
                    continue
                g = grams(coded(words_of(text.as_py()), symbols), depth)
                pending[int(training)].append(g)
                size += len(g)
                if size > 1_000_000:
                    fold()
                    if sum(map(len, held)) > 6_000_000:
                        merge()
                        if len(held[0]) > 4_500_000:
                            yield from flush()
        fold()
        yield from flush()

    rows = docs.select("doc_id", as_text_bytes().alias("t")).mapInArrow(training(run), "g long, n long")
    return rows.withColumn("near", near_symbols()).repartition("near").groupBy("near", "g").agg(F.sum("n").alias("n"))


@dataclass
class Base:
    """Contexts of up to BASE symbols: counts, and the smoothed probabilities of the next symbol after each."""

    counts: list[np.ndarray]
    smooth: list[np.ndarray]

    def log10(self, used: np.ndarray, divergence: float, least: int) -> np.ndarray:
        """log10 probabilities by context of BASE symbols, after its longest kept suffix; `used` contexts have longer ones."""
        keep = [np.ones(len(p), bool) for p in self.smooth]
        for k in range(BASE, 0, -1):
            c, parent = self.counts[k], np.tile(self.smooth[k - 1], (1 << BITS, 1))
            total = c.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(c > 0, c * np.log(c / total / parent), 0).sum(axis=1)
            keep[k] = (gain >= divergence) & (total[:, 0] >= least)
            longer = used if k == BASE else np.flatnonzero(keep[k + 1])
            keep[k][longer & ((1 << BITS * k) - 1)] = True
        best = self.smooth[0]
        for k in range(1, BASE + 1):
            best = np.where(keep[k][:, None], self.smooth[k], np.tile(best, (1 << BITS, 1)))
        return np.log10(best)


def base_of(docs: DataFrame, symbols: np.ndarray) -> Base:
    """The dense table, from training counts of at most 64^3 grams."""
    width = 1 << BITS * (BASE + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        pending: list[np.ndarray] = []

        def fold() -> None:
            nonlocal total
            if pending:
                total += np.bincount(np.concatenate(pending), minlength=width)
                pending.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not held_out(doc_id):
                    pending.append(grams(coded(words_of(text.as_py()), symbols), BASE))
                    if sum(map(len, pending[-64:])) > PIECE or len(pending) >= 1000:
                        fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    found = docs.select("doc_id", as_text_bytes().alias("t")).mapInArrow(training(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # 64^3 rows at most
    flat = np.zeros(width)
    flat[found.column("g").to_numpy()] = found.column("n").to_numpy()
    counts = [flat.reshape(1 << BITS * BASE, 1 << BITS)]
    for k in range(BASE - 1, -1, -1):
        counts.insert(0, counts[0].reshape(1 << BITS, 1 << BITS * k, 1 << BITS).sum(axis=0))
    smooth = []
    for k, c in enumerate(counts):
        parent = np.tile(smooth[-1], (1 << BITS, 1)) if k else np.full((1, 1 << BITS), 1 / (1 << BITS))
        a = np.maximum(1, (c > 0).sum(axis=1, keepdims=True))
        smooth.append((c + a * parent) / (c.sum(axis=1, keepdims=True) + a))
    return Base(counts, smooth)


def grown(g: np.ndarray, n: np.ndarray, parent: np.ndarray, depth: int, divergence: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, value) of the contexts beyond BASE symbols, sorted, from all grams of some groups `near`; keys have their symbols turned.

    As in `grow`. A kept context's own row has the log10 weight that it and its suffixes beyond BASE
    leave to unseen symbols, with STATE in its key; a row of it and a symbol seen after it has the log10
    probability less that weight, so an unseen symbol's is a context's row plus the longest suffix's row of it.
    """
    summed = {}
    n = n.astype(np.float64)
    for k in range(depth, BASE, -1):
        g = g & ((1 << BITS * (k + 1)) - 1)
        order = np.argsort(g)
        g = g[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        g, n = g[first], np.add.reduceat(n[order], first)
        summed[k] = g, n
    levels, before = [], None
    for k in range(BASE + 1, depth + 1):
        keys, counts = summed.pop(k)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] >> BITS != keys[:-1] >> BITS)))
        ctx, of = keys[first] >> BITS, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        total, a = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))).astype(float)
        if before is None:
            p, weight = parent[(keys >> BITS) & ((1 << BITS * BASE) - 1), keys & MASK], np.zeros(len(ctx))
        else:
            p = before[1][np.searchsorted(before[0], keys & ((1 << BITS * k) - 1))]
            weight = before[3][np.searchsorted(before[2], ctx & ((1 << BITS * (k - 1)) - 1))]
        gain = np.add.reduceat(counts * np.log(counts / total[of] / p), first)
        p = (counts + a[of] * p) / (total + a)[of]
        weight = weight + np.log10(a / (total + a))
        before = keys, p, ctx, weight
        levels.append([k, keys, np.log10(p) - weight[of], ctx, weight, of, (gain >= divergence) & (total >= least)])
    out = []
    for i in range(len(levels) - 1, -1, -1):
        k, keys, values, ctx, weight, of, keep = levels[i]
        if i:
            levels[i - 1][6][np.searchsorted(levels[i - 1][3], ctx[keep] & ((1 << BITS * (k - 1)) - 1))] = True
        out += [(turned(keys[keep[of]], k + 1) | k << 48, values[keep[of]]), (turned(ctx[keep], k) | k << 48 | STATE, weight[keep])]
    keys, values = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def log10_of(g: np.ndarray, keys: np.ndarray, values: np.ndarray, base: np.ndarray, parent: np.ndarray, depth: int, n_other: int) -> np.ndarray:
    """log10 probability of each turned gram's symbol after the longest kept suffix of its context; fast if they're sorted."""
    context, sym = g & ((1 << BITS * depth) - 1), g >> BITS * depth
    near = turned(context >> BITS * (depth - BASE), BASE)
    out = base[near, sym].astype(np.float64)
    seen, level, left = np.log10(parent)[near, sym], np.zeros(len(g), np.int8), np.arange(len(g))

    def found(low: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(keys, [low, low + (1 << 48)])
        if a == b or not len(wanted):
            return np.zeros(len(wanted), bool), np.empty(0)
        # Of equal neighbours one is looked up.
        first = np.flatnonzero(np.concatenate(([True], wanted[1:] != wanted[:-1])))
        many, wanted = np.diff(np.append(first, len(wanted))), wanted[first] | low
        at = a + np.minimum(np.searchsorted(keys[a:b], wanted), b - a - 1)
        hit = keys[at] == wanted
        return np.repeat(hit, many), np.repeat(values[at[hit]], many[hit])

    for k in range(BASE + 1, depth + 1):
        # A symbol's row is there only if its context's is, so contexts are looked up where a symbol has none.
        hit, x = found(k << 48, g[left] >> BITS * (depth - k))
        seen[left[hit]] = x
        miss = np.flatnonzero(~hit)
        hit[miss] = found(k << 48 | STATE, context[left[miss]] >> BITS * (depth - k))[0]
        left = left[hit]
        level[left] = k
    for k in range(BASE + 1, depth + 1):
        at = np.flatnonzero(level == k)
        out[at] = seen[at] + found(k << 48 | STATE, context[at] >> BITS * (depth - k))[1]
    return np.where(sym == OTHER, out - math.log10(n_other), out)


class Descents:
    """The tree's rows as nodes that lead to their children: a step down is a bit of a mask and a count of the bits before it.

    A row of k + 1 symbols is there only if its first k are, so from the sorted rows the children of a
    node stand together. Rows of contexts (STATE) have nodes of their own, to which those of symbols lead.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, base: np.ndarray, parent: np.ndarray, depth: int, n_other: int):
        self.depth, self.base, self.parent = depth, base.ravel(), np.log10(parent).ravel()
        self.other = math.log10(n_other)
        n = int(np.searchsorted(keys, STATE))
        self.values, self.weights = values[:n], values[n:]
        self.roots, self.nodes, _ = self._tree(keys[:n], 0, 1)
        self.context_roots, self.contexts, _ = self._tree(keys[n:], STATE, 0)
        self.context_of = np.empty(n, np.int32)
        for k in range(BASE + 1, depth + 1):
            a, b = (int(x) for x in np.searchsorted(keys[:n], [k << 48, k + 1 << 48]))
            for i in range(a, b, PIECE):  # so that there is room for a piece's numbers only beside the tree
                own = slice(i, min(i + PIECE, b))
                self.context_of[own] = np.searchsorted(keys[n:], keys[own] & ((1 << BITS * k) - 1) | k << 48 | STATE)

    def _tree(self, keys: np.ndarray, mark: int, more: int) -> tuple[tuple, tuple, int]:
        """Masks and first children of the roots (all of BASE + more symbols, the last first) and of the nodes above the deepest level."""
        bounds = [int(x) for x in np.searchsorted(keys, [mark | k << 48 for k in range(BASE + 1, self.depth + 2)])]
        roots = np.zeros(1 << BITS * (BASE + more), np.uint64), np.zeros(1 << BITS * (BASE + more), np.int32)
        inner = np.zeros(bounds[-2], np.uint64), np.zeros(bounds[-2], np.int32)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for start in range(a, b, PIECE):  # as above; a node's children may stand in several pieces
                own = keys[start : min(start + PIECE, b)] & ((1 << 48) - 1)
                up = own >> BITS
                first = runs(up)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (own & MASK).astype(np.uint64), first)
                if i:
                    lo = bounds[i - 1]
                    at = lo + np.searchsorted(keys[lo:a], up[first] | mark | BASE + i << 48)
                    masks, firsts = inner
                else:
                    at = turned(up[first], BASE + more)
                    masks, firsts = roots
                firsts[at] = np.where(masks[at] > 0, firsts[at], start + first)
                masks[at] |= bits
        return roots, inner, bounds[-1]

    @staticmethod
    def _down(tree: tuple[np.ndarray, np.ndarray], node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which nodes have a child by that symbol, which have none, and the children."""
        mask, symbol = tree[0][node], symbol.astype(np.uint64)
        hit = (mask >> symbol & np.uint64(1)).astype(bool)
        there = np.flatnonzero(hit)
        before = np.bitwise_count(mask[there] & ((np.uint64(1) << symbol[there]) - np.uint64(1)))
        return there, np.flatnonzero(~hit), tree[1][node[there]] + before

    def log10_of(self, s: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol from place `depth` on after the longest kept suffix of the symbols before it."""
        return self.of_grams(turned_grams(s.astype(np.int64), self.depth)[self.depth :])

    def of_grams(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each turned gram's symbol after the longest kept suffix of its context; fast if they're sorted.

        Neighbours that begin alike take the steps of what they share together.
        """
        begun, many = [g], []
        for _ in range(BASE + 1, self.depth):
            up = begun[-1] >> BITS
            first = runs(up)
            begun.append(up[first])
            many.append(np.diff(np.append(first, len(up))))
        now = begun.pop()
        own, near = now >> BITS * (BASE + 1), turned(now >> BITS, BASE)
        root = near << BITS | own
        seen, state = np.full(len(now), -1, np.int32), np.full(len(now), -1, np.int32)
        left, loose = np.arange(len(now)), np.empty(0, np.int64)
        for k in range(BASE + 1, self.depth + 1):
            symbol = now & MASK
            there, lost, child = self._down(self.roots if k == BASE + 1 else self.nodes, root if k == BASE + 1 else seen[left], symbol[left])
            # Where the symbol has no row, its context may still have one.
            if k == BASE + 1:
                at, of = left[lost], near[lost]
            else:
                at, of = np.concatenate((loose, left[lost])), np.concatenate((state[loose], self.context_of[seen[left[lost]]]))
            left = left[there]
            seen[left] = child
            found, _, context = self._down(self.context_roots if k == BASE + 1 else self.contexts, of, symbol[at])
            loose = at[found]
            state[loose] = context
            if begun:
                going, held = np.zeros(len(now), bool), np.zeros(len(now), bool)
                going[left], held[loose] = True, True
                again = np.repeat(np.arange(len(now), dtype=np.int32), many.pop())
                seen, state, root = seen[again], state[again], root[again]
                left, loose, now = np.flatnonzero(going[again]), np.flatnonzero(held[again]), begun.pop()
        known = seen >= 0
        at = np.flatnonzero(known & (state < 0))
        state[at] = self.context_of[seen[at]]
        out = self.base[root]
        at = np.flatnonzero(state >= 0)
        out[at] = np.where(known[at], self.values[seen[at]], self.parent[root[at]]) + self.weights[state[at]].astype(np.float64) if len(self.values) else out[at]
        out[root & MASK == OTHER] -= self.other
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probabilities of fewer than 2^16 texts, each with `depth` times SPACE before its symbols.

        Each different gram is looked up once, in sorted order: grams are sorted with their text's number below them.
        """
        every, lengths = np.concatenate(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        text, total = np.repeat(np.arange(len(texts), dtype=np.uint16), lengths), np.zeros(len(texts))
        inside = np.ones(len(every), bool)
        starts = np.cumsum(lengths) - lengths
        for k in range(self.depth):
            inside[starts + k] = False
        for a in range(self.depth, len(every), TOGETHER):
            b = a + TOGETHER
            packed = turned_grams(every[a - self.depth : b].astype(np.int64), self.depth)[self.depth :].view(np.uint64)
            packed <<= np.uint64(16)
            packed |= text[a:b]
            packed = packed[inside[a:b]]
            packed.sort()
            g = (packed >> np.uint64(16)).astype(np.int64)
            first = runs(g)
            many, g = np.diff(np.append(first, len(g))), g[first]
            logs = np.concatenate([self.of_grams(g[i : i + PIECE]) for i in range(0, len(g), PIECE)] or [np.empty(0)])
            total += np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), np.repeat(logs, many), len(texts))
        return total


def tree_rows(counts: DataFrame, parent: np.ndarray, depth: int, divergence: float, least: int, scorer=None) -> DataFrame:
    """The tree's rows (key, value), or with a scorer every gram with its log10 probability, group by group of `near`."""
    held = counts.sparkSession.sparkContext.broadcast(parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            if size:
                g, n = (np.concatenate(x) for x in zip(*parts))
                own = n > 0
                keys, values = grown(g[own], n[own], held.value, depth, divergence, least) if own.any() else (np.empty(0, np.int64), np.empty(0, np.float32))
                if scorer:
                    keys, values = g, scorer(g, keys, values)
                for at in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(values[at : at + 200_000].astype(np.float32))], ["key", "value"])

        for batch in batches:
            near, g, n = (c.to_numpy() for c in batch.columns)
            start = 0
            if size >= 250_000:
                # Groups are whole: a chunk ends where `near` changes.
                last = (parts[-1][0][-1] >> BITS) & ((1 << BITS * NEAR) - 1)
                start = int(np.searchsorted(near, last, "right"))
                if start < len(near):
                    parts.append((g[:start], n[:start]))
                    yield from chunk()
                    parts, size = [], 0
                else:
                    start = 0
            parts.append((g[start:], n[start:]))
            size += len(g) - start
        yield from chunk()

    return counts.sortWithinPartitions("near").select("near", "g", "n").mapInArrow(training(run), "key long, value float")


def kept_grams(counts: DataFrame, depth: int, p_min: float) -> DataFrame:
    """(d, ctx, sym, n) of every context of 0..depth symbols that makes up p_min of all training symbols."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    level = counts.select(F.shiftright("g", BITS).alias("ctx"), F.col("g").bitwiseAND(F.lit(MASK)).alias("sym"), "n")
    everything = F.sum("n").over(Window.partitionBy("ctx"))  # at most 64 rows a context
    out = None
    for d in range(depth, -1, -1):
        if d < depth:
            # Each level is summed from the one before, in the partitions that the window needs too.
            shorter = level.select(F.col("ctx").bitwiseAND(F.lit((1 << BITS * d) - 1)).alias("ctx"), "sym", "n")
            level = materialize((shorter.groupBy("ctx", "sym").agg(F.sum("n").alias("n")) if d < 3 else shorter.repartition("ctx").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))), "lm-level")
        part = level.withColumn("all", everything).where(F.col("all") >= max(1.0, p_min * total)).select(F.lit(d).alias("d"), "ctx", "sym", "n")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class SuffixTree:
    """States, by number: child[state, symbol before the context] and log10 probabilities of the next symbol."""

    child: np.ndarray
    log10: np.ndarray
    depth: int

    def states(self, s: np.ndarray) -> np.ndarray:
        """For each place, the state of the longest kept suffix of the symbols before it."""
        padded = np.concatenate((np.zeros(self.depth, np.int64), s))
        now = np.zeros(len(s), np.int64)
        best = now
        for k in range(1, self.depth + 1):
            now = self.child[now, padded[self.depth - k : self.depth - k + len(s)]]
            best = np.where(now >= 0, now, best)
            now = np.where(now >= 0, now, len(self.child) - 1)
        return best

    def score(self, s: np.ndarray) -> float:
        return math.fsum(float(self.log10[self.states(s[max(0, a - self.depth) : a + PIECE])[min(a, self.depth) :], s[a : a + PIECE]].sum(dtype=np.float64)) for a in range(0, len(s), PIECE))


def grow(rows: dict[str, np.ndarray], symbols: np.ndarray, depth: int = DEPTH, divergence: float = DIVERGENCE) -> SuffixTree:
    """The tree from the rows (d, ctx, sym, n) of kept_grams.

    A context is kept if n * KL(next symbol after it || after its suffix) reaches `divergence`, or
    if a longer kept context ends in it. A state's distribution mixes its counts with its suffix's:
    (n(sym) + a * P(sym | suffix)) / (n + a) with a = the number of different next symbols (at least
    1), and the root's with the uniform one. OTHER's share is divided among the bytes it stands for.
    """
    n_other = max(1, 256 - 6 - int(((symbols != OTHER) & (symbols != SPACE)).sum()))
    d, ctx, sym, n = (np.asarray(rows[c]) for c in ("d", "ctx", "sym", "n"))
    contexts: list[np.ndarray] = []
    smooth: list[np.ndarray] = []
    keep: list[np.ndarray] = []
    for k in range(depth + 1):
        at = d == k
        own = np.unique(ctx[at]) if at.any() or k else np.zeros(1, np.int64)
        counts = np.zeros((len(own), MASK + 1), np.float32)
        counts[np.searchsorted(own, ctx[at]), sym[at]] = n[at]
        # A context's suffix is as frequent as it is, so it is there.
        parent = smooth[k - 1][np.searchsorted(contexts[k - 1], own & ((1 << BITS * (k - 1)) - 1))] if k else np.full((1, MASK + 1), 1 / (MASK + 1), np.float32)
        total = counts.sum(axis=1, dtype=np.float64)[:, None]
        a = np.maximum(1, (counts > 0).sum(axis=1))[:, None]
        smooth.append(((counts + a * parent) / (total + a)).astype(np.float32))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(counts > 0, counts * np.log(counts / total / parent), 0).sum(axis=1)
        keep.append(gain >= divergence if k else np.ones(1, bool))
        contexts.append(own)
    for k in range(depth, 1, -1):
        suffixes = np.unique(contexts[k][keep[k]] & ((1 << BITS * (k - 1)) - 1))
        keep[k - 1][np.searchsorted(contexts[k - 1], suffixes)] = True
    first = np.cumsum([0, *(int(x.sum()) for x in keep)])
    kept = [c[x] for c, x in zip(contexts, keep)]
    child = np.full((first[-1] + 1, MASK + 1), -1, np.int32)  # the last row has no children
    for k in range(1, depth + 1):
        up = first[k - 1] + np.searchsorted(kept[k - 1], kept[k] & ((1 << BITS * (k - 1)) - 1))
        child[up, kept[k] >> BITS * (k - 1)] = np.arange(first[k], first[k + 1])
    log10 = np.log10(np.concatenate([p[x] for p, x in zip(smooth, keep)]))
    log10[:, OTHER] -= np.float32(math.log10(n_other))
    return SuffixTree(child, log10, depth)


def loaded(uri: str, columns: tuple[str, str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The two columns written at `uri`, by the first; read once by a Python worker, which holds a table of each kind."""
    if uri not in _loaded:
        for other in [u for u in _loaded if u.rsplit("-", 1)[0].rsplit("/", 1)[-1] == uri.rsplit("-", 1)[0].rsplit("/", 1)[-1]]:
            del _loaded[other]
        fs, path = FileSystem.from_uri(uri)
        found = dataset.dataset(path, filesystem=fs, format="parquet")
        keys, values = (np.empty(rows, found.schema.field(c).type.to_pandas_dtype()) for c in columns)
        at = 0
        for batch in found.to_batches(columns=list(columns), batch_readahead=1, fragment_readahead=1):
            keys[at : at + len(batch)], values[at : at + len(batch)] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at += len(batch)
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        _loaded[uri] = keys, values
    return _loaded[uri]


def counts_of(h: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each hash by a table sorted by its keys, 0 for those that it lacks; asked for in sorted order, near places follow one another."""
    out = np.zeros(len(h), np.int64)
    if len(keys):
        order = np.argsort(h)
        at = np.minimum(np.searchsorted(keys, h[order]), len(keys) - 1)
        hit = keys[at] == h[order]
        out[order[hit]] = counts[at[hit]]
    return out


def descents(uri: str, rows: int, *more) -> Descents:
    """The tree written at `uri` as nodes, made once by a Python worker, which holds one tree."""
    if uri + DESCENTS not in _loaded:
        for other in [u for u in _loaded if u.endswith(DESCENTS)]:
            del _loaded[other]
        keys, values = loaded(uri, ("key", "value"), rows)
        del _loaded[uri]
        _loaded[uri + DESCENTS] = Descents(keys, values, *more)
        del keys, values
        give_back()
    return _loaded[uri + DESCENTS]


def score_documents(docs: DataFrame, depth: int = DEPTH, least_count: int = LEAST_COUNT, divergence: float = DIVERGENCE, broadcast_words: int = BROADCAST_WORDS, broadcast_states: int = BROADCAST_STATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Trains on the rows that aren't held out and scores all. `score` is the log10 probability that
    the suffix tree gives the text's words, as bytes, separated by one space and closed by an end
    symbol; `base_score` is the smoothed word-unigram model's. Null and empty texts are the end token alone. Rows of
    equal doc_id are rows of their own. With no training rows all counts are zero and the tree is
    uniform. An empty table gives an empty result.

    Counts are summed over the whole corpus on Spark, and the tree is grown there too, by the last
    NEAR symbols of its contexts: the driver holds only the dense table of BASE symbols. Tree and
    word counts are tables in the shared folder. Each worker reads them up to broadcast_states and
    broadcast_words rows; beyond, they're joined to each document's grams and words.
    """
    if not BASE < depth <= DEPTH:
        raise ValueError(f"depth must be {BASE + 1} to {DEPTH}")
    spark = docs.sparkSession
    words_at = scratch_path(spark, "lm-words")
    word_counts(docs).write.parquet(words_at)
    words = spark.read.schema("h long, c long").parquet(words_at)
    v, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    symbols = byte_symbols(docs)
    n_other = max(1, 256 - 6 - int(((symbols != OTHER) & (symbols != SPACE)).sum()))
    base = base_of(docs, symbols)
    parent = base.smooth[BASE]
    tree_at = scratch_path(spark, "lm-tree")
    tree_rows(gram_counts(docs, symbols, depth), parent, depth, divergence, least_count).write.parquet(tree_at)
    tree = spark.read.schema("key long, value float").parquet(tree_at)
    states = tree.count()
    shortest = tree.where((F.col("key") >= STATE | BASE + 1 << 48) & (F.col("key") < STATE | BASE + 2 << 48))
    used = shortest.select(F.shiftright("key", BITS).bitwiseAND(F.lit((1 << BITS * BASE) - 1)).alias("c")).distinct().toArrow().column("c").to_numpy()  # 64^2 rows at most
    known_base = base.log10(turned(used, BASE), divergence, least_count)
    dense = spark.sparkContext.broadcast((known_base, parent))
    few = states <= broadcast_states
    floor = total + 0.5 * (v + 1)
    small = v <= broadcast_words

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
        """The words of some rows' texts at a time, and the place of the first row."""
        some, size, start = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            data = text.as_py()
            if some and (size + len(data) > TOGETHER or len(some) >= 0xFFFF):
                yield start, some
                some, size, start = [], 0, i
            some.append(words_of(data))
            size += len(data)
        if some:
            yield start, some

    def tree_scores(texts: list[list[bytes]]) -> list[float]:
        before = np.zeros(depth, np.uint8)
        return descents(tree_at, states, *dense.value, depth, n_other).scores([np.concatenate((before, coded(t, symbols).astype(np.uint8))) for t in texts]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        numbers = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("row", pa.int64()), ("pairs", numbers), ("grams", numbers)])
        for batch in batches:
            if few:  # read before any words are held
                descents(tree_at, states, *dense.value, depth, n_other)
            doc_ids, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, texts in grouped(batch):
                n = len(texts)
                scores = tree_scores(texts) if few else [0.0] * n
                grams_of = [None] * n
                if not few:
                    grams_of = [[{"h": a, "tf": b} for a, b in zip(*(x.tolist() for x in np.unique(grams(coded(t, symbols), depth), return_counts=True)))] for t in texts]
                # Each different word of these texts has a number and is hashed and looked up once; no word is a newline.
                number = Numbers()
                ends = np.cumsum([len(t) + 1 for t in texts])
                word = np.fromiter(map(number.__getitem__, chain.from_iterable(chain(t, (b"\n",)) for t in texts)), np.int32, ends[-1])
                starts = np.append(0, ends[:-1])
                h = np.fromiter(map(digest, number), np.uint64, len(number)).astype(np.int64)
                known, base, pairs = [None] * n, [None] * n, [None] * n
                if small:
                    c = counts_of(h, *loaded(words_at, ("h", "c"), v))
                    known = np.add.reduceat((c > 0)[word], starts, dtype=np.int64).tolist()
                    base = np.add.reduceat(np.log10((c + 0.5) / floor)[word], starts).tolist()
                else:
                    for i, (a, b) in enumerate(zip(starts, ends)):
                        own, tf = np.unique(word[a:b], return_counts=True)
                        pairs[i] = [{"h": x, "tf": y} for x, y in zip(h[own].tolist(), tf.tolist())]
                ids = doc_ids[at : at + n]
                columns = ids, map(held_out, ids), ends - starts, known, [total] * n, base, scores, rows[at : at + n], pairs, grams_of
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)

    def joined_scores(texts: DataFrame) -> DataFrame:
        """(row, score): each text's different grams joined to the log10 probability of each gram of the corpus."""
        scorer = lambda g, keys, values: log10_of(turned(g, depth + 1), keys, values, *dense.value, depth, n_other)
        logs = tree_rows(gram_counts(docs, symbols, depth, every=True), parent, depth, divergence, least_count, scorer)
        held = texts.select("row", F.explode("grams").alias("p")).select("row", F.col("p.h").alias("key"), "p.tf")
        return held.join(logs, "key").groupBy("row").agg(F.sum(F.col("tf") * F.col("value").cast("double")).alias("score"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text_bytes().alias("t"), F.monotonically_increasing_id().alias("row"))
    scored = rows.mapInArrow(giving_back(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, row long, pairs array<struct<h:long,tf:long>>, grams array<struct<h:long,tf:long>>")
    if not small or not few:
        scored = materialize(scored, "lm-scored")
    every = scored
    if not small:
        looked = scored.select("row", F.explode("pairs").alias("p")).select("row", "p.h", "p.tf").join(words, "h", "left")
        c = F.coalesce("c", F.lit(0))
        sums = looked.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(float(floor)))).alias("base_score"))
        scored = scored.drop("n_known", "base_score").join(sums, "row")
    if not few:
        scored = scored.drop("score").join(joined_scores(every), "row")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
