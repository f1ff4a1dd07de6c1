"""Cases in which the training-data operators once did less than the whole job."""

import numpy as np
import pandas as pd
import pytest

from tracewright.llm import simhash, suffix_tree, topk
from tracewright.llm.common import words_of


def test_topk_full_query_blocks_in_one_task(spark):
    """Full blocks of 512 queries share a partition; each keeps floors of its own."""
    r = np.random.default_rng(5)
    n, d, k = 5120, 64, 5
    x = r.standard_normal((n, d)) * np.where(np.arange(n) % 2, 1, 8)[:, None]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {}
        for row in topk.exact_topk(vectors, vectors, k, candidate_block=512).collect():
            found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    v = np.floor(x.astype(np.float32).astype(np.float64) * 256).astype(np.int64)
    scores = v @ v.T
    for i in range(n):
        scores[i, i] = -(2**62)
        best = np.lexsort((np.arange(n), -scores[i]))[:k]
        assert sorted(found.get(i, [])) == [(rank + 1, int(j), int(scores[i, j])) for rank, j in enumerate(best)], i


@pytest.mark.parametrize("limit", [10**6, 0])
def test_suffix_tree_keeps_rare_contexts_of_seven_symbols(spark, limit):
    """Scores are those of the tree grown at once from all contexts of up to seven symbols, loaded or joined."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(40)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(60)] + ["", None, "Été été x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    symbols = suffix_tree.byte_symbols(docs)
    coded = {i: suffix_tree.coded(words_of((t or "").encode()), symbols) for i, t in enumerate(texts)}
    g, n = np.unique(np.concatenate([suffix_tree.grams(s, 7) for i, s in coded.items() if not suffix_tree.held_out(i)]), return_counts=True)
    table = pd.concat([pd.DataFrame({"d": d, "ctx": (g >> 6) & ((1 << 6 * d) - 1), "sym": g & 63, "n": n}) for d in range(8)]).groupby(["d", "ctx", "sym"], as_index=False).n.sum()
    tree = suffix_tree.grow({c: table[c].to_numpy() for c in table}, symbols, 7, 12.0)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, least_count=1, broadcast_states=limit).collect()}
    assert len(got) == len(texts)
    for i, s in coded.items():
        assert got[i] == pytest.approx(tree.score(s), rel=1e-3), i


def test_near_duplicates_lose_no_borderline_pair(spark):
    """200 pairs of similarity just above 0.8, none with another copy: every one is a group."""
    r = np.random.default_rng(8)
    texts = []
    for _ in range(200):
        words = [f"w{x}" for x in r.integers(0, 10**6, 104)]
        other = list(words)
        other[30], other[70] = "one", "two"  # 10 of 100 shingles differ: 90 / 110
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = {x["doc_id"]: x["group_id"] for x in simhash.near_duplicates(docs).collect()}
    assert [i for i in range(0, 400, 2) if group[i] != group[i + 1]] == []
    assert len(set(group.values())) == 200


def test_near_duplicates_in_plans_of_bounded_size(spark, monkeypatch):
    """No write has all steps in its plan: the driver holds the running stages of a plan at once."""
    exchanges = {}

    def written(df, name, real=simhash.materialize):
        exchanges[name] = max(exchanges.get(name, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return real(df, name)

    monkeypatch.setattr(simhash, "materialize", written)
    words = [f"w{i} " * (i % 3) + "some words of a text that others share in part" for i in range(40)]
    assert simhash.near_duplicates(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).count() == 40
    assert max(exchanges.values()) <= 16, exchanges


def test_suffix_tree_counting_starts_without_an_earlier_tree():
    """Workers stay for the next query: what the last one's scoring has loaded goes before texts are counted."""
    suffix_tree._loaded["file:/x/lm-tree-1"] = np.zeros(1000, np.int64), np.zeros(1000, np.float32)
    assert list(suffix_tree.training(lambda batches: (len(suffix_tree._loaded) for _ in batches))(iter("ab"))) == [0, 0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_no_exploded_table(spark, monkeypatch):
    """Spark takes an exploded table for as small as what it comes from, so a table of fingerprints that may be broadcast would be with all its variants."""
    plans = {}
    written = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.setdefault(name, []).append(_plan(df)) or written(df, name))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words, "more"])), (2, " ".join(words[30:])), (3, "other words")], "doc_id long, text string")
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    assert groups[0] == groups[1] and len(set(groups.values())) == 3
    assert "Broadcast" not in plans["near-fingerprints"][0]
    assert all("Broadcast" not in p for p in plans["near-sets"])


def test_simhash_links_broadcast_no_variants(spark, tmp_path):
    spark.createDataFrame([(x,) for x in (0, 1, 1 << 40, 3 << 40, -1)], "fp long").write.parquet(str(tmp_path / "fps"))
    links = simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "fps")))
    assert "Broadcast" not in _plan(links)
    near = {(0, 1), (0, 1 << 40), (0, 3 << 40), (1, 1 << 40), (1, 3 << 40), (1 << 40, 3 << 40)}
    assert {tuple(sorted(x)) for x in links.collect()} == near
