"""Substring deduplication: suffix automata of reference shards give each document's matching statistics against all smaller doc_ids."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import _SPACE, hashed_words, materialize, mixed, row_key, word_hashes_of
from tracewright.llm.periodic import joined_words

#: Words of a window, and of the part of it that chooses its shard.
WINDOW, SEED = 13, 3
#: Words that are cut together, and bytes of text for each shard.
BLOCK_WORDS, SHARD_BYTES = 1 << 19, 4 << 20
#: A shard that holds more than so many bytes of segments is cut into its windows, which are dealt anew.
HEAVY_BYTES = 16 * SHARD_BYTES
SPANS = "array<struct<start:long,end:long>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """The automaton of all substrings of the word sequences added so far; a state's only step is kept beside the steps of branching ones."""

    def __init__(self) -> None:
        self.word: list[object] = [None]
        self.to: list[int] = [-1]
        self.more: dict[int, dict] = {}
        self.link, self.length = [-1], [0]

    def step(self, state: int, word: object) -> int:
        """The state after a word, or -1."""
        if self.word[state] == word and self.to[state] >= 0:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(word, -1)

    def _set(self, state: int, word: object, to: int) -> None:
        if self.to[state] < 0 or self.word[state] == word:
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, length: int, link: int) -> int:
        self.word.append(None)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: object, q: int) -> int:
        """The state of `state`'s longest sequence and a word, apart from q, which holds longer ones."""
        clone = self._new(self.length[state] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while state >= 0 and self.step(state, word) == q:
            self._set(state, word, clone)
            state = self.link[state]
        return clone

    def add(self, words: Iterable[object]) -> None:
        last, length, link, step = 0, self.length, self.link, self.step
        for word in words:
            q = step(last, word)
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new, state = self._new(length[last] + 1, 0), last
            while state >= 0 and (q := step(state, word)) < 0:
                self._set(state, word, new)
                state = link[state]
            if state >= 0:
                link[new] = q if length[q] == length[state] + 1 else self._split(state, word, q)
            last = new

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """The union of the maximal spans of `words` that have `least` words or more and stand in a sequence added before, by matching statistics."""
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words, 1):
            while (to := self.step(state, word)) < 0 and state:
                state = self.link[state]
                matched = self.length[state]
            if to >= 0:
                state, matched = to, matched + 1
            if matched >= least:
                # What ends here starts at i - matched, which never moves back.
                if out and i - matched <= out[-1][1]:
                    out[-1] = (out[-1][0], i)
                else:
                    out.append((i - matched, i))
        return out


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all stretches of n hashes, from those of powers of two."""
    out, done, size, power = None, 0, 1, h
    while True:
        if n & size:
            if out is None:
                out, done = power, size
            else:
                k = len(h) - done - size + 1
                out = mixed(out[:k] * _ODD + power[done : done + k]) if k > 0 else np.empty(0, np.uint64)
                done += size
        if done == n:
            return out
        k = len(power) - size
        power = mixed(power[:k] * _ODD + power[size:]) if k > 0 else np.empty(0, np.uint64)
        size *= 2


def segments(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, seed): the windows of a block's words, as stretches of neighbouring windows of one seed.

    A window's seed is the least fingerprint of its stretches of SEED words, so equal windows have equal seeds wherever they stand.
    Windows stay within a piece.
    """
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least, size, want = _grams(h, SEED), 1, WINDOW - SEED + 1
    while size < want:
        shift = min(size, want - size)
        least = np.minimum(least[:-shift], least[shift:])
        size += shift
    valid = piece[:n] == piece[WINDOW - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (piece[1:n] != piece[: n - 1]) | (valid[1:] != valid[:-1])
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.append(firsts, n))
    ok = valid[firsts]
    return firsts[ok], sizes[ok] + WINDOW - 1, least[firsts[ok]]


def _packed(docs: np.ndarray, keys: np.ndarray, who: np.ndarray, at: np.ndarray, what: np.ndarray, contents: list[bytes]) -> bytes:
    """Occurrences (document's place, first word, content's place) and contents as bytes."""
    arrays = (docs.astype("<i8"), keys.astype("<i8"), who.astype("<i4"), at.astype("<i8"), what.astype("<i4"), np.array([len(c) for c in contents], "<i8"))
    return zstandard.compress(struct.pack("<3q", len(docs), len(who), len(contents)) + b"".join(a.tobytes() for a in arrays) + b"".join(contents), 3)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(doc_ids, keys, first words) of occurrences, and the contents, by occurrence."""
    data = zstandard.decompress(data)
    n_docs, n, n_contents = struct.unpack_from("<3q", data)
    offset, out = 24, []
    for kind, size in (("<i8", n_docs), ("<i8", n_docs), ("<i4", n), ("<i8", n), ("<i4", n), ("<i8", n_contents)):
        out.append(np.frombuffer(data, kind, size, offset))
        offset += out[-1].nbytes
    docs, keys, who, at, what, sizes = out
    ends = (offset + np.cumsum(sizes)).tolist()
    contents = [data[b - s : b] for b, s in zip(ends, sizes.tolist())]
    return docs[who], keys[who], at, [contents[i] for i in what.tolist()]


def _dealt(shards: np.ndarray, docs: np.ndarray, keys: np.ndarray, at: np.ndarray, contents: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
    """(shard, packed occurrences, bytes of contents), each shard's equal contents once."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        places: dict[bytes, int] = {}
        what = np.array([places.setdefault(contents[i], len(places)) for i in own.tolist()])
        pairs, who = np.unique(np.stack((docs[own], keys[own])), axis=1, return_inverse=True)
        yield int(shards[own[0]]), _packed(pairs[0], pairs[1], who.ravel(), at[own], what, list(places)), sum(map(len, places))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 50 + sum(len(x) for x in r if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc_id, key, first word, text): documents, those of more than BLOCK_WORDS words in pieces that share a window less a word."""
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            if len(text) < 2 * BLOCK_WORDS:
                yield doc_id, key, 0, text
                continue
            starts, _ = hashed_words(np.frombuffer(text, np.uint8))
            for a in range(0, max(1, len(starts) - WINDOW + 1), BLOCK_WORDS):
                b = a + BLOCK_WORDS + WINDOW - 1
                yield doc_id, key, a, text[starts[a] if a else 0 : starts[b] if b < len(starts) else len(text)]


def _cut(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes, int]]:
            held: list[tuple[int, int, int, bytes]] = []
            size = 0
            for piece in _pieces(batches):
                held.append(piece)
                size += len(piece[3])
                if size >= 6 * BLOCK_WORDS:
                    yield from cut(held)
                    held, size = [], 0
            yield from cut(held)

        def cut(held: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, bytes, int]]:
            if not held:
                return
            data = b" ".join(x[3] for x in held)
            space = _SPACE[np.frombuffer(data, np.uint8)]
            edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            h = np.concatenate(list(word_hashes_of(x[3] for x in held)) or [np.empty(0, np.uint64)])
            from_byte = np.cumsum([0, *(len(x[3]) + 1 for x in held)])
            piece = np.searchsorted(from_byte, starts, "right") - 1
            first_word = np.searchsorted(starts, from_byte)
            firsts, sizes, seeds = segments(h, piece)
            if not len(firsts):
                return
            docs, keys, base = (np.array([x[i] for x in held], np.int64) for i in range(3))
            own = piece[firsts]
            contents = [data[a:b] for a, b in zip(starts[firsts].tolist(), ends[firsts + sizes - 1].tolist())]
            yield from _dealt((mixed(seeds) % np.uint64(n_shards)).astype(np.int64), docs[own], keys[own], firsts - first_word[own] + base[own], contents)

        return _batches(rows(), ["shard", "data", "bytes"], [pa.int64(), pa.binary(), pa.int64()])

    return run


def _repeated(occurrences: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, key, start, end) of a shard's spans that stand in a smaller doc_id.

    Only contents with a window that the shard holds twice can matter; the others are left out first. Documents come by
    doc_id: what they hold is matched against the automaton of all smaller ones, and then added to it.
    """
    docs, keys, at = (np.concatenate([o[i] for o in occurrences]) for i in range(3))
    places: dict[bytes, int] = {}
    what = np.array([places.setdefault(c, len(places)) for o in occurrences for c in o[3]], np.int64)
    contents = list(places)
    order = np.lexsort((docs, what))
    edge = np.flatnonzero(np.diff(what[order], prepend=-1, append=len(contents)))
    several = docs[order][edge[:-1]] != docs[order][edge[1:] - 1]  # contents of more than one doc_id
    h, sizes = [], []
    for x in word_hashes_of(contents):
        h.append(x)
        sizes.append(len(x))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contents)), sizes)
    grams = _grams(np.concatenate(h), WINDOW)
    inside = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :])
    by = inside[np.argsort(grams[inside], kind="stable")]
    equal = grams[by][1:] == grams[by][:-1]
    twice = np.zeros(len(grams), bool)
    twice[by[1:][equal]] = twice[by[:-1][equal]] = True
    hit = np.flatnonzero(twice)
    first, last = np.full(len(contents), -1), np.full(len(contents), -1)
    last[owner[hit]] = hit - (ends - sizes)[owner[hit]]
    first[owner[hit[::-1]]] = hit[::-1] - (ends - sizes)[owner[hit[::-1]]]
    first[several], last[several] = 0, (np.array(sizes) - WINDOW)[several]
    kept = np.flatnonzero(first[what] >= 0)
    kept = kept[np.lexsort((what[kept], docs[kept]))]
    automaton = SuffixAutomaton()
    known: dict[bytes, bytes] = {}
    full: dict[int, list[tuple[int, int]]] = {}
    waiting: dict[int, list[bytes]] = {}
    now = None
    for doc_id, key, start, no in zip(docs[kept].tolist(), keys[kept].tolist(), at[kept].tolist(), what[kept].tolist()):
        if doc_id != now:
            for i, words in waiting.items():
                automaton.add(words)
                if several[i]:
                    full[i] = automaton.spans(words, WINDOW)
            waiting, now = {}, doc_id
        spans = full.get(no)
        if spans is None:
            words = waiting.get(no)
            if words is None:
                a = int(first[no])
                words = waiting[no] = [known.setdefault(w, w) for w in contents[no].split()[a : int(last[no]) + WINDOW]]
            spans = automaton.spans(words, WINDOW)
        for a, b in spans:
            yield doc_id, key, start + int(first[no]) + a, start + int(first[no]) + b


def _windows(occurrences: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]], n_shards: int) -> Iterator[tuple[int, bytes, int]]:
    """Occurrences as those of their windows, dealt by the window."""
    docs, keys, at, contents, prints = [], [], [], [], []
    for d, k, p, segment in occurrences:
        for doc_id, key, start, content in zip(d.tolist(), k.tolist(), p.tolist(), segment):
            words = content.split()
            for i in range(len(words) - WINDOW + 1):
                docs.append(doc_id)
                keys.append(key)
                at.append(start + i)
                contents.append(b" ".join(words[i : i + WINDOW]))
    prints = [x[0] for x in (_grams(h, WINDOW) for h in word_hashes_of(contents))]
    yield from _dealt((np.array(prints, np.uint64) % np.uint64(n_shards)).astype(np.int64), *(np.array(x, np.int64) for x in (docs, keys, at)), contents)


def _solve(heavy: int | None, n_shards: int):
    """Shards, one after another, as spans; a heavy one is handed on as windows."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list = []
            size, now, passed = 0, None, False
            nothing = (None,) * 4

            def done() -> Iterator[tuple]:
                if held:
                    yield from (nothing + x for x in _windows(held, n_shards)) if passed else (x + (None,) * 3 for x in _repeated(held))

            for batch in batches:
                for shard, data, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "data", "bytes"))):
                    if shard != now:
                        yield from done()
                        held, size, now, passed = [], 0, shard, False
                    held.append(_unpacked(data))
                    size += n
                    if heavy is not None and size > heavy:
                        # From here on all of the shard goes on in pieces, what is held and what comes.
                        passed = True
                        yield from done()
                        held, size = [], heavy - SHARD_BYTES
            yield from done()

        return _batches(rows(), ["doc_id", "key", "start", "end", "shard", "data", "bytes"], kinds)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                space = _SPACE[np.frombuffer(text, np.uint8)]
                n = len(np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))) // 2
                change = np.zeros(n + 1, np.int64)
                for s in spans or ():
                    change[s["start"]] += 1
                    change[s["end"]] -= 1
                keep = np.cumsum(change)[:n] == 0
                union = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).view(np.int8))).reshape(-1, 2).tolist()
                yield doc_id, n, n - int(keep.sum()), [{"start": a, "end": b} for a, b in union], joined_words(text, keep)

    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    return _batches(rows(), names, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()])


def drop_repeated(docs: DataFrame, shard_bytes: int = SHARD_BYTES, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): documents without the words of windows that also start in a smaller doc_id.

    A window is 13 consecutive words. docs: doc_id and text; spans are the removed word numbers, end exclusive, kept is the other words
    joined by one space. A null text has no words; a row with a null doc_id is kept whole and removes nothing; rows of one
    doc_id don't remove each other's words; further columns are ignored; an empty table gives no rows.

    Every window's shard follows from its own words, so references and documents are dealt together: the automata of all shards for all
    documents would take work of the square of the corpus. Neighbouring windows of one shard travel as one segment, equal
    segments of a block once. The number of shards follows from the text's bytes, and the work of each is bounded: one that many different
    segments share is cut into its windows, dealt anew by all their words.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // shard_bytes))
    packed, found = "shard long, data binary, bytes long", "doc_id long, key long, start long, end long, shard long, data binary, bytes long"
    dealt = own.where("doc_id is not null").mapInArrow(_cut(n_shards), packed).repartition("shard").sortWithinPartitions("shard")
    first = materialize(dealt.mapInArrow(_solve(heavy_bytes, n_shards), found), "spans")
    windows = first.where("data is not null").select("shard", "data", "bytes").repartition("shard").sortWithinPartitions("shard")
    spans = first.where("data is null").select("doc_id", "key", "start", "end").unionByName(windows.mapInArrow(_solve(None, n_shards), found).select("doc_id", "key", "start", "end"))
    by_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no more than a document's words
    return own.join(by_doc, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, f"doc_id long, n_words long, n_removed long, spans {SPANS}, kept string")
