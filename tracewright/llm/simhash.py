"""SimHash near-duplicate detection with deletion-variant (one-wildcard) segment signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import as_text_bytes, connected_components, giving_back, materialize, mixed, row_key, word_hashes_of, words_of

SEED = 42


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 where it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row; the fingerprint's 64 bits are stored as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text_bytes().alias("t")).mapInArrow(giving_back(run), "doc_id long, fp long")


def segments(max_bits: int, total: int = 64) -> list[tuple[int, int]]:
    """(offset, length) of max_bits // 2 + 1 segments: of at most max_bits differing bits, one segment has at most one."""
    n = max_bits // 2 + 1
    cuts = [total * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(fp: Column, offset: int, length: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << length) - 1))


def fingerprint_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): all pairs of distinct values of `fp` that differ in 1 to max_bits bits.

    The index holds for each segment its value and its one-wildcard variants. A pair whose
    segments differ in exactly bit j meets at variant j, one side holding 0 there and the other 1,
    so each side is indexed once per bit; the join verifies the whole distance before it emits.
    It is a merge join whatever Spark takes the sizes for: an exploded table counts as no larger than
    what it comes from, so a few hundred thousand fingerprints would be broadcast with all their variants.
    """
    fp = F.col("fp")
    segs = segments(max_bits)
    width = max(length for _, length in segs)
    tag = lambda j, key: (F.lit(j << width) + key).cast("long").alias("key")

    exact = fps.select(F.explode(F.array(*[tag(64 + s, _bits(fp, o, n)) for s, (o, n) in enumerate(segs)])).alias("key"), "fp")
    variants = []
    for offset, length in segs:
        for j in range(length):
            bit = F.shiftrightunsigned(fp, offset + j).bitwiseAND(F.lit(1))
            masked = _bits(fp, offset, length).bitwiseAND(F.lit(((1 << length) - 1) & ~(1 << j)))
            variants.append(F.struct(tag(offset + j, masked), bit.cast("boolean").alias("one")))
    wild = fps.select(F.explode(F.array(*variants)).alias("v"), "fp").select("v.key", "v.one", "fp")

    def verified(left: DataFrame, right: DataFrame, more: Column | None = None) -> DataFrame:
        left, right = left.select("key", F.col("fp").alias("a")), right.select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        return left.join(right.hint("merge"), (F.col("key") == F.col("key_b")) & near & (more if more is not None else F.lit(True))).select("a", "b")

    return verified(exact, exact, F.col("a") < F.col("b")).unionByName(verified(wild.where("not one"), wild.where("one")))


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of docs.

    Rows link where their fingerprints differ in at most max_bits bits; component_id is the
    smallest doc_id reachable. Null and empty texts have fingerprint zero and link like any other.
    Rows of equal doc_id are kept and each gets its own text's component; a null doc_id counts as
    larger than any other, so component_id is null only where a component has no other id.
    An empty table gives an empty result; other columns are not read.
    """
    fps = materialize(fingerprints(docs, width), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # Written before they're joined: a large component's or a common text's rows are then a plain shuffle that adaptive execution splits.
    least = materialize(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    classes = materialize(grouped.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near duplicates by similarity of sets of SHINGLE-word shingles; a text's fingerprint finds the closest first.
SIMILARITY, SHINGLE = 0.8, 5
#: Slots of the table of shingle counts that orders shingles from rare to common; it orders, whatever shares a slot.
COUNT_SLOTS = 1 << 20
#: Bits of the parity map of a set: maps of two sets differ in no more bits than the sets in shingles.
PARITY = 256
#: Classes that a task remembers, so that it sends each of them once.
REMEMBERED = 200_000


def text_words(texts: Iterable[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text, a hash of its words in order, as a signed long, and the words' own hashes."""
    for h in word_hashes_of(t.lower() for t in texts):
        whole = xxhash.xxh64_intdigest(h.tobytes(), SEED)
        yield whole - (1 << 64) if whole >> 63 else whole, h


def shingle_set(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The different `width`-word shingles of a text's words, hashed to 64 bits, sorted; fewer words: the whole sequence; none: empty."""
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mixed(total))


def text_classes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, row, class, fp) for each row: texts of the same words are one class; row is the row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, fps = [], []
            for whole, h in text_words(t.as_py() for t in batch.column(2)):
                classes.append(whole)
                fps.append(majority_bits(shingle_set(h, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "row", "class", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), as_text_bytes().alias("t"))
    return rows.mapInArrow(giving_back(run), "doc_id long, row long, class long, fp long")


class Once:
    """Whether a class is met for the first time, as far as a bounded memory goes: copies are left out where they're met."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, c: int) -> bool:
        if c in self.seen:
            return False
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen.add(c)
        return True


def shingle_ranks(docs: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """How common the shingles of each slot are, as the bit length of their count over all documents: COUNT_SLOTS bytes at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once = np.zeros(COUNT_SLOTS, np.int64), Once()
        for batch in batches:
            for whole, h in text_words(t.as_py() for t in batch.column(0)):
                if once(whole):
                    np.add.at(total, (shingle_set(h, width) % np.uint64(COUNT_SLOTS)).astype(np.int64), 1)
        for at in range(0, COUNT_SLOTS, 1 << 14):
            part = total[at : at + (1 << 14)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at >> 14], pa.int32()), pa.array([part.astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, np.int64)
        for batch in parts:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, np.uint32)
        ranks = np.ceil(np.log2(total + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["block", "ranks"])

    blocks = docs.select(as_text_bytes().alias("t")).mapInArrow(giving_back(run), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, ranks binary")
    ranks = np.zeros(COUNT_SLOTS, np.uint8)
    for r in blocks.collect():  # COUNT_SLOTS bytes
        ranks[r["block"] << 14 : (r["block"] + 1) << 14] = np.frombuffer(r["ranks"], np.uint8)
    return ranks


def sketch(shingles: np.ndarray) -> bytes:
    """A parity map of a set, of a power of two of bits and two to four for each shingle."""
    bits = max(PARITY, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """In how many shingles two sets differ at least, by their sketches; the longer is folded to the shorter."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def rare_shingles(docs: DataFrame, ranks: np.ndarray, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(class, n, keys array<long>, parity array<long>, sketch binary) of each class: how many shingles it has, the first of them, rare first, its parity map and its sketch."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            out = []
            for whole, h in text_words(t.as_py() for t in batch.column(0)):
                if len(h) and once(whole):
                    x = shingle_set(h, width)
                    k = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                    first = x[np.lexsort((x, held.value[(x % np.uint64(COUNT_SLOTS)).astype(np.int64)]))[:k]]
                    odd = np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=PARITY) & 1
                    out.append((whole, len(x), first.view(np.int64), np.packbits(odd.astype(bool)).view(np.int64), sketch(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    found = docs.select(as_text_bytes().alias("t")).mapInArrow(giving_back(run), "class long, n int, keys array<long>, parity array<long>, sketch binary")
    return found.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "keys", "parity", "sketch")])


def shared_shingles(rare: DataFrame) -> DataFrame:
    """(key, class, at, pivot, next) of the rare shingles that several classes have: its place in the class's order, and two other classes that have it, if any.

    In an order of its own for each shingle: the first class, and the one that follows.
    """
    index = rare.select("class", F.posexplode("keys").alias("at", "key")).repartition("key")
    by_key = Window.partitionBy("key").orderBy(F.xxhash64("class", "key"), "class")
    placed = index.withColumns({"pivot": F.first("class").over(by_key), "next": F.lead("class").over(by_key)})
    return placed.where((F.col("pivot") != F.col("class")) | F.col("next").isNotNull())


def _apart(left: str, right: str) -> Column:
    """The bits in which two parity maps differ."""
    bits = [F.bit_count(F.col(f"{left}.parity")[i].bitwiseXOR(F.col(f"{right}.parity")[i])) for i in range(PARITY // 64)]
    return sum(bits[1:], bits[0])


def _can_be_similar(similarity: float) -> Column:
    """Sets of n and m shingles of that similarity differ in at most their share of n + m, and their maps in no more bits."""
    return _apart("l", "r") <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("l.n") + F.col("r.n")) + 1e-6


def pivot_pairs(shared: DataFrame, rare: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): classes with the pivot and the next class of each shingle that they share, if they can be similar: twice as many rows as shared has at most."""
    both = shared.select("class", F.explode(F.array("pivot", "next")).alias("other")).where("class <> other")
    met = materialize(both.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct(), "near-met")
    info = rare.select("class", "n", "parity")
    joined = met.join(info.alias("l"), F.col("a") == F.col("l.class")).join(info.alias("r"), F.col("b") == F.col("r.class"))
    return joined.where(_can_be_similar(similarity)).select("a", "b")


def candidate_pairs(shared: DataFrame, rare: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of classes that aren't connected by roots (node, root) yet and can be similar by `similarity`; none is lost.

    All shingles have one order, rare first. Sets of n and m shingles that are similar share one among
    the first n - ceil(similarity * n) + 1 of one and of m so of the other, and at the first one shared the
    rest of both is still long enough for the overlap. An equality join on those shingles meets them; it
    emits a pair only if their parity maps differ in no more bits than similar sets can differ in shingles.
    """
    known = rare.select("class", "n", "parity").join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("comp"), "n", "parity")
    known = materialize(known, "near-known")
    index = shared.select("key", "class", "at").join(known, "class")
    l, r = index.alias("l"), index.alias("r")
    rest = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))
    enough = rest >= F.lit(similarity / (1 + similarity)) * (F.col("l.n") + F.col("r.n")) - 1e-6
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class")) & (F.col("l.comp") != F.col("r.comp")) & enough & _can_be_similar(similarity)
    return l.join(r.hint("merge"), met).select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()


#: Slots of the filter that keeps texts of no candidate pair out of a shuffle: 0.5 MB whatever their number.
SLOTS = 1 << 22


def _wide(packed: bytes) -> np.ndarray:
    """Numbers of five bytes each."""
    x = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return np.column_stack((x, np.zeros((len(x), 3), np.uint8))).view(np.uint64)[:, 0]


def verified_pairs(pairs: DataFrame, rare: DataFrame, docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, one_each: bool = False) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets' Jaccard similarity is `similarity` or more, by the sets of docs' whole texts.

    Sketches, a thirtieth of the sets, leave out pairs that differ too much; the sets of the others are compared,
    by 40 bits of each shingle. With one_each, only the pair of each a with its least b, and of each b with its
    least a: for a first round, after which the others meet again unless they're connected.
    """
    spark = docs.sparkSession

    def met(some: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        side = lambda k: table.select(F.col("class").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns])
        return some.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{k}_{c}" for k in "ab" for c in columns])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (batch.column(2).to_numpy() + batch.column(4).to_numpy()) + 1e-6
            keep = [least_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(3), batch.column(5), most.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = met(pairs, rare, "n", "sketch").mapInArrow(giving_back(near), "a long, b long")
    if one_each:
        close = materialize(close, "near-some")
        close = close.groupBy("a").agg(F.min("b").alias("b")).unionByName(close.groupBy("b").agg(F.min("a").alias("a"))).distinct()
    close = materialize(close, "near-close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    mask = np.zeros(SLOTS // 8, np.uint8)
    block = F.shiftright(F.pmod("class", F.lit(SLOTS)), 15).cast("int")
    for r in wanted.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.pmod("class", F.lit(1 << 15))).alias("bits")).collect():  # SLOTS bits
        mask[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)[: 1 << 12]
    held = spark.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            classes, sets = [], []
            for c, h in text_words(t.as_py() for t in batch.column(0)):
                at = c % SLOTS
                if held.value[at >> 3] >> (at & 7) & 1 and once(c):
                    classes.append(c)
                    sets.append(shingle_set(h, width).view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "s"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _wide(x.as_py()), _wide(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spelled = docs.select(as_text_bytes().alias("t")).mapInArrow(giving_back(run), "class long, s binary")
    sets = materialize(spelled.join(wanted.hint("merge"), "class", "left_semi").groupBy("class").agg(F.first("s").alias("s")), "near-sets")
    return materialize(met(close, sets, "s").mapInArrow(giving_back(compared), "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, group_id) for every row: groups of near duplicates by shingle similarity; row is the row_key.

    Texts of the same words are one class. Classes link where their sets of `width`-word shingles
    are similar by `similarity` or more. First the fingerprint's segments find links of the closest, and
    each class meets two others of every rare shingle that it shares; then shared rare shingles find
    every other candidate between what isn't connected yet, so a large group of near copies doesn't meet
    pair by pair and no group is split. group_id is the least class of a group. Null and empty texts are one class; a text of fewer
    words is one shingle; rows of equal doc_id are rows of their own; an empty table gives an empty result.
    """
    rows = materialize(text_classes(docs, width), "near-classes")
    rare = materialize(rare_shingles(docs, shingle_ranks(docs, width), similarity, width), "near-rare")
    shared = materialize(shared_shingles(rare), "near-shared")
    classes = materialize(rows.groupBy("class").agg(F.first("fp").alias("fp")), "near-fps")
    first = materialize(candidate_links(classes).unionByName(pivot_pairs(shared, rare, similarity)).distinct(), "near-first")
    links = verified_pairs(first, rare, docs, width, similarity, one_each=True)
    more = verified_pairs(candidate_pairs(shared, rare, connected_components(links), similarity), rare, docs, width, similarity)
    roots = connected_components(links.unionByName(more))
    return rows.join(roots, rows["class"] == roots["node"], "left").select("doc_id", "row", F.coalesce("root", "class").alias("group_id"))


def candidate_links(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) classes whose fingerprints are equal or differ in at most max_bits bits: of equal ones each with the least."""
    # Each is written before it's joined more than once: one plan of all of it runs its many stages at once, which the driver has to hold.
    heads = materialize(classes.groupBy("fp").agg(F.min("class").alias("head")), "near-heads")
    near = materialize(fingerprint_links(heads.select("fp"), max_bits).distinct(), "near-fingerprints")
    crossed = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = classes.join(heads, "fp").where("class <> head").select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b"))
    return crossed.unionByName(same).distinct()


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each group the row of the least doc_id stays, null last; ties by the row's hash.

    Of rows that are equal in doc_id and text one stays, whichever. All columns are returned as they are, whatever their names.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    groups = near_duplicates(plain.select(doc_id.alias("doc_id"), text.alias("text")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    groups = materialize(groups, "near-groups")
    kept = materialize(groups.groupBy("group_id").agg(F.min(order).alias("k")).select("k.row"), "near-kept")
    # Rows that go, and those that occur several times, as a map of SLOTS bits: what isn't in it stays without a shuffle.
    doubtful = groups.select("row").join(kept, "row", "left_anti").unionByName(groups.groupBy("row").count().where("count > 1").select("row"))
    slot = F.pmod("row", F.lit(SLOTS))
    block, bit = F.shiftright(slot, 15).cast("int"), F.pmod(slot, F.lit(1 << 15))
    marked = materialize(doubtful.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits")), "near-marked")  # SLOTS bits
    mark = F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(shiftright(pmod(pmod(row, {SLOTS}), 32768), 3) + 1 as int), 1)), 16, 10) as int), cast(pmod(row, 8) as int)) & 1")
    rows = plain.withColumn("row", row_key(doc_id, text)).withColumn("block", block)
    rows = rows.join(F.broadcast(marked), "block", "left").withColumn("doubt", F.coalesce(mark, F.lit(0)) == 1).drop("block", "bits")
    judged = rows.where("doubt").join(kept, "row", "left_semi").dropDuplicates(["row"])
    return rows.where("not doubt").unionByName(judged).drop("row", "doubt").toDF(*docs.columns)
