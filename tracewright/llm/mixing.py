"""Mixing sources to target weights: fixed-length token blocks, multinomial slots, index permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, giving_back, materialize

BLOCK_WORDS, SHARD_SLOTS = 64, 4096
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = 20_231


def row_key() -> Column:
    """A hash that tells documents apart: of doc_id, text, language and source, nulls apart from empty strings."""
    marked = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.xxhash64(marked("doc_id"), marked("text"), marked("lang"), marked("source"))


def sized(docs: DataFrame) -> DataFrame:
    """Each document's number of words; a null text has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn. The level t with
    sum(min(most * size, weight * t)) = share * sum(size) is what resharing the excess by weight
    ends at: sources fill up in the order of most * size / weight, and after the last that fills
    the rest is shared by weight. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy("fills_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.sum("cap").over(filled))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.sum("weight").over(filled))
    )
    # A source is full if at its own level the budget isn't used up yet.
    per = per.withColumn("is_full", F.col("full") + F.col("fills_at") * F.col("open_weight") <= F.col("budget"))
    used = F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(everything), F.lit(0.0))
    left = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything)
    level = F.when(left > 0, (F.col("budget") - used) / left)
    return per.withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))).select("source", "source_size", "weight", "target")


def with_offsets(rows: DataFrame, parts: int) -> DataFrame:
    """Each row's `offset`: the sizes before it in its source, in the order of doc_id and then row_key.

    Two levels, so that no source is gathered in one task: a running sum within (source, slice),
    plus the sum of the source's earlier slices. Slices are ranges of doc_id of about equal counts.
    """
    cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    piece = F.lit(0)
    for c in cuts:
        piece = piece + (F.col("doc_id") >= F.lit(c)).cast("int")
    sliced = rows.withColumn("slice", F.coalesce(piece, F.lit(len(cuts) + 1)))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = sums.withColumn("before", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")).drop("slice_size")
    within = Window.partitionBy("source", "slice").orderBy(F.col("doc_id").isNull(), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("local", F.sum("size").over(within) - F.col("size"))
    joined = local.alias("l").join(before.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.slice") == F.col("b.slice")))
    return joined.select("l.*", (F.col("local") + F.col("before")).alias("offset")).drop("local", "slice")


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: a four-round Feistel network, walked until it lands below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, open_ = np.uint64((1 << half) - 1), np.asarray(index, np.uint64).copy(), np.arange(len(index))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for r in range(4):
            left, right = right, left ^ (_mix64(right ^ np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def hypergeometric_weights(good: int, bad: int, sample: int) -> tuple[int, np.ndarray]:
    """The least count and the weights of it and all that follow, as far as a double can tell them from nothing.

    Weights grow from the mode outwards by the ratios of neighbours, over nine and a half standard deviations on
    both sides: some millions of numbers for 10^12 slots.
    """
    n = good + bad
    mode = (sample + 1) * (good + 1) // (n + 2)
    deviation = math.sqrt(sample * (good / n) * (bad / n) * ((n - sample) / max(1, n - 1)))
    low, high = max(0, sample - bad, mode - int(9.5 * deviation) - 50), min(good, sample, mode + int(9.5 * deviation) + 50)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    return low, np.exp(logs - logs[mode - low])


def draw_hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """One draw, by the generator below its bound of 10^9 and by the weights beyond."""
    if not good or not sample:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    low, weights = hypergeometric_weights(good, bad, sample)
    up_to = np.cumsum(weights)
    return low + min(int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right")), len(weights) - 1)


def split_counts(left_slots: int, right_slots: int, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots go left: a multinomial draw given both sides' sizes and the sources' totals."""
    total, need, out = int(counts.sum()), left_slots, np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        rest = total - c
        out[i] = draw_hypergeometric(c, rest, need, rng)
        total, need = rest, need - int(out[i])
    return out


def shard_draw(shard: int, n_shards: int, slots: np.ndarray, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's multinomial source counts and the counts of all shards before it.

    The draw walks a binary tree over the shards from the root, where each source has its total;
    a node's seed is its place, so each shard's counts come out alike wherever they're drawn, and
    all shards together use exactly the totals.
    """
    low, high, counts, before = 0, n_shards, slots.astype(np.int64), np.zeros(len(slots), np.int64)
    total = int(slots.sum())
    size = lambda a, b: min(total, b * per_shard) - min(total, a * per_shard)
    while high - low > 1:
        mid = (low + high) // 2
        went = split_counts(size(low, mid), size(mid, high), counts, np.random.default_rng([seed, low, high]))
        if shard < mid:
            high, counts = mid, went
        else:
            low, counts, before = mid, counts - went, before + went
    return counts, before


def draw_slots(plan: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block, pass, words) for every slot of every output shard.

    `plan` has one row per source: source_no, source_size, target. A source takes
    floor(target / size) whole passes over its blocks and then permuted blocks until the target is
    met, of the last block only as many words as are missing.
    """
    rows = plan.where("source_size > 0").orderBy("source_no").collect()  # one row per source
    size = np.array([r["source_size"] for r in rows], np.int64)
    want = np.array([round(r["target"]) for r in rows], np.int64)
    number = [r["source_no"] for r in rows]
    blocks = -(-size // block_words)
    passes = want // np.maximum(size, 1)
    extra = want - passes * size
    slots = passes * blocks + -(-extra // block_words)
    n_shards = max(1, -(-int(slots.sum()) // per_shard))
    spark = plan.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                counts, before = shard_draw(shard, n_shards, slots, per_shard, seed)
                out = []
                for i in np.flatnonzero(counts):
                    j = np.arange(before[i], before[i] + counts[i])
                    turn, at = j // blocks[i], j % blocks[i]
                    block = permuted(at, int(blocks[i]), seed * 1_000_003 + number[i] * 101)
                    length = np.minimum(block_words, size[i] - block * block_words)
                    in_last = turn >= passes[i]
                    length = np.where(in_last, np.minimum(length, extra[i] - at * block_words), length)
                    out.append(pd.DataFrame({"source_no": number[i], "block": block, "pass": turn, "words": length}))
                if out:
                    mixed = pd.concat(out, ignore_index=True).sample(frac=1, random_state=(seed + shard) % 2**32)
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(mixed)), **{c: mixed[c].to_numpy() for c in mixed}})

    return spark.range(0, n_shards, 1, min(n_shards, max(2, spark.sparkContext.defaultParallelism))).mapInPandas(giving_back(run), "shard long, slot long, source_no int, block long, pass long, words long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, parts: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix, and its rows' accounts.

    Returns (pieces, accounts). accounts: one row per row of docs: doc_id, tie (row_key),
    source, size, source_no, source_size, target, offset (words before it in its source). pieces: one row per slot and document in it: shard, slot,
    pass, doc_id, tie, offset, source_no, first_word, n_words: words first_word.. of that document.

    A source's words, in the order of doc_id and then row_key, are packed into blocks of block_words
    across document borders. Null texts have no words, null doc_ids come last, rows of equal
    doc_id are separate documents, each with an offset of its own.
    An empty table gives an empty mix. Sources' taken words differ from the targets by less than a
    block. All draws come from the seed and the data, so reruns agree.
    """
    spark = docs.sparkSession
    narrow = sized(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", row_key().alias("tie"))
    narrow = materialize(narrow, "mix-sizes")
    goal = targets(narrow, weights, share, most)
    goal = materialize(goal.withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source"))), "mix-plan")
    parts = parts or max(1, min(64, spark.sparkContext.defaultParallelism * 4))
    placed = with_offsets(narrow, parts)
    accounts = placed.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.doc_id", "p.tie", "p.source", "p.size", "p.offset", "g.source_no", "g.source_size", "g.target")
    accounts = materialize(accounts, "mix-accounts")
    # Every block a document has words in, joined to the slots by the block's index.
    first, last = F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words)
    spread = accounts.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begins = F.greatest(F.col("offset"), F.col("block") * block_words)
    slots = draw_slots(goal, block_words, seed=seed)
    # Slots grow with the corpus, which the planner can't see: they're made from a range of shards.
    joined = spread.join(slots.hint("merge"), ["source_no", "block"])
    ends = F.least(F.col("offset") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = joined.select("shard", "slot", "pass", "doc_id", "tie", "offset", "source_no", (begins - F.col("offset")).alias("first_word"), (ends - begins).alias("n_words")).where("n_words > 0")
    return pieces, accounts


def taken_per_document(pieces: DataFrame, accounts: DataFrame) -> DataFrame:
    """accounts with `taken`: the words the mix takes from each document, repeats counted."""
    key = ["source_no", "offset", "tie"]  # documents with words have offsets of their own
    sums = pieces.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    same: Column = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}"))
    return accounts.alias("a").join(sums.alias("s"), same, "left").select("a.*", F.when(F.col("a.size") > 0, F.coalesce("s.taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, pieces: DataFrame, accounts: DataFrame) -> DataFrame:
    """The mix as documents with docs' columns: one row per document and pass that takes words of it.

    A document taken whole keeps its text; of one taken in part the text is the taken words, in
    their order, joined by spaces, and n_chars its length. Identical rows differ by their offset.
    """
    runs = pieces.groupBy("source_no", "tie", "offset", "pass").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    runs = runs.join(accounts.where("size > 0").select("source_no", "tie", "offset", "size"), ["source_no", "tie", "offset"])
    text_at, own = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.withColumn("_tie", row_key()).dropDuplicates(["_tie"]).toDF(*own, "_tie")  # columns by place: extra ones may have any name
    joined = keyed.join(runs, keyed["_tie"] == runs["tie"]).select(*own, "n_words", "size", "runs")  # in the partitions of the deduplication
    whole, text = F.col("n_words") == F.col("size"), f"c{text_at}"
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("_words", (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")))), " ")
    cut = joined.withColumn("_words", F.when(~whole, words)).withColumn(text, F.when(whole, F.col(text)).otherwise(part))
    if "n_chars" in docs.columns:
        cut = cut.withColumn(f"c{docs.columns.index('n_chars')}", F.length(text).cast("long"))
    return cut.select(*own).toDF(*docs.columns)
