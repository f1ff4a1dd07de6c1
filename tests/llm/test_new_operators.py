"""Periodic runs, hard negatives and substring deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, substrings
from tracewright.llm.negatives import Packed, mine_negatives
from tracewright.llm.periodic import periodic_runs, solved, tiles_of
from tracewright.llm.substrings import SuffixAutomaton, drop_repeated

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_in(text):
    return WORD.findall((text or "").encode())


# --- hashed words ---------------------------------------------------------------------------------


def test_words_hashed_in_pieces_are_the_same(monkeypatch):
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab \t\ncd\xc3") for _ in range(r.randrange(0, 90))) for _ in range(60)]
    whole = [common.hashed_words(np.frombuffer(t, np.uint8)) for t in texts]
    for size in (1, 2, 5, 16):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        for t, (starts, h) in zip(texts, whole):
            again = common.hashed_words(np.frombuffer(t, np.uint8))
            assert again[0].tolist() == starts.tolist() and again[1].tolist() == h.tolist()


def test_word_hashes_are_polynomials_of_the_words_bytes():
    texts = [b"a", b" ab\tb  abc", b"\xff\xfe x", "\u00e9t\u00e9 \u4e2d\u6587".encode(), b"", b" \n", b"w" * 300 + b" w"]
    for t, h in zip(texts, common.word_hashes_of(texts)):
        want = [sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for w in t.split()]
        assert h.tolist() == common.mixed(np.array(want, np.uint64)).tolist()


def test_benchmark_search_compares_an_items_own_words_alone(spark, monkeypatch):
    r = random.Random(4)
    item = [f"rare{i}" for i in range(24)]
    other = [f"w{r.randrange(50)}" for _ in range(12)]
    leak = [x for i, w in enumerate(item) for x in ([w, other[i // 2]] if i % 2 else [w])]
    texts = [" ".join(other + leak + other), " ".join(other)]
    h = [decontaminate.passage_hashes(t) for t in texts]
    idf, basis = np.ones(decontaminate.SLOTS), np.linalg.qr(np.random.default_rng(0).standard_normal((decontaminate.SLOTS, 8)))[0]
    items = decontaminate.items_of([(7, " ".join(item))], idf, basis)
    held, compared = {}, []
    monkeypatch.setattr(decontaminate, "LEAST_COSINE", -1.0)
    monkeypatch.setattr(decontaminate, "_texts", lambda docs: SimpleNamespace(mapInArrow=lambda run, schema: held.update(run=run)))
    monkeypatch.setattr(decontaminate, "lcs_length", lambda a, b, real=decontaminate.lcs_length: compared.append(b) or real(a, b))
    decontaminate.search(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))), items, idf, basis)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array(texts)], ["doc_id", "row", "t"])
    found = pa.Table.from_batches(held["run"](iter([batch]))).to_pylist()
    assert [(x["doc_id"], x["item_id"], x["lcs"], x["item_words"]) for x in found] == [(0, 7, 24, 24)]
    assert compared and all(np.isin(b, items.words[0]).all() for b in compared) and not np.isin(h[1], items.words[0]).any()


# --- periodic runs --------------------------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(q % d == 0 and w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, q, n))
            i = j
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def periodic_text(r):
    out = []
    while len(out) < r.randrange(1, 260):
        kind = r.random()
        if kind < 0.5:
            root = [r.choice("abc") for _ in range(r.randrange(1, 14))]
            out += (root * 9)[: r.randrange(1, 1 + 6 * len(root))]
        elif kind < 0.8:
            out += [r.choice("ab") for _ in range(r.randrange(1, 30))]
        else:
            out += [str(r.random()) for _ in range(r.randrange(1, 20))]
    return r.choice([" ", "\n", " \t "]).join(out)


def test_periodic_runs_against_brute_force(spark):
    r = random.Random(7)
    texts = [periodic_text(r) for _ in range(150)] + ["", None, " \n ", "a a a a a", "a a a a a a", "x " * 30000, "a b " * 9 + "a", "a a b " * 40]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q w q w q w q w q", "y", 2), (3, texts[3], "x", 1)]
    found = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, key int")).collect()
    assert len(found) == len(rows)
    got = defaultdict(list)
    for x in found:
        got[x["doc_id"]].append(([(a["start"], a["period"], a["length"]) for a in x["runs"]], x["collapsed"]))
    for doc_id, text, *_ in rows:
        w = words_in(text)
        want = brute_runs(w) if len(w) < 5000 else [(0, 1, len(w))]
        assert got[doc_id].pop() == (want, collapsed(w, want)), doc_id


def test_runs_over_tiles(spark, monkeypatch):
    """A run over many tiles, and tiles smaller than their runs."""
    from tracewright.llm import periodic

    monkeypatch.setattr(periodic, "LEAST_CORE", 1)
    r = random.Random(11)
    for _ in range(200):
        w = words_in(periodic_text(r))
        h = common.word_hashes(np.frombuffer(b" ".join(w), np.uint8))
        fragments = defaultdict(list)
        for _, _, base, part, boundaries, periods in tiles_of(h):
            for q, s, e in solved(part, boundaries, periods):
                fragments[q].append((base + s, base + e))
        runs = []
        for q, some in fragments.items():
            merged = []
            for s, e in sorted(some):
                if merged and s <= merged[-1][1] - q:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            runs += [(s, q, e - s) for s, e in merged if e - s >= max(6, 4 * q)]
        assert sorted(runs) == brute_runs(w)


def test_op11_contract(spark, tmp_path):
    from tracewright.llm.queries import op11_periodic

    r = random.Random(5)
    docs = [(i * 7 - 30, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 60)))) for i in range(120)] + [(10**12, None), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x.asDict() for x in op11_periodic(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in docs:
        w = words_in(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = brute_runs(w)
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        want = {"doc_id": doc_id, "n_runs": len(runs), "start": best and best[1], "length": best and -best[0], "period": best and best[2], "exponent_milli": best and 1000 * -best[0] // best[2]}
        want |= {"runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(w, runs).encode()).hexdigest()}
        assert got[doc_id] == want
    assert planted > 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(empty).count() == 0


# --- hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, step):
    usable = [(i, y, [int(np.floor(256.0 * c)) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    clamp = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in usable if i % step == 0}:
        scored = [(-sum(a * b for a, b in zip(v, u)), j, z) for j, z, u in usable if j != i and len(u) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2] == y)[:5]:
            near = sorted(x for x in scored if x[2] != y and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(i, j, k, m, clamp(-p), clamp(-s)) for k, (s, m, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 3e5, 1e9, 1e30])
def test_negatives_against_brute_force(spark, size):
    r = random.Random(int(size) % 97)
    rows = [(i, r.randrange(3), [r.uniform(0, 1) * size for _ in range(4)]) for i in range(160)]
    rows += [(i, r.randrange(3), [r.uniform(-1, 1) * size for _ in range(4)]) for i in range(160, 200)]
    rows += [(201 + i, 1, [0.5 * size] * 4) for i in range(12)] + [(300 + i, 2, [0.5 * size] * 4) for i in range(12)]
    rows += [(400, 1, None), (410, 1, [1.0, None, 1.0, 1.0]), (420, 1, [1.0, float("nan"), 1.0, 1.0]), (430, 1, [float("inf")] * 4), (440, None, [1.0] * 4), (None, 1, [1.0] * 4), (450, 1, [1.0, 2.0]), (451, 1, [1.0, 1.0]), (452, 2, [1.0, 1.9]), (460, 1, []), (480, 0, [-3.0 * size] * 4)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, label int, embedding array<double>, score string")
    for chunk, fields in ((65536, 2048), (37, 5)):
        got = sorted(tuple(x) for x in mine_negatives(df, F.col("vec_id") % 10 == 0, chunk=chunk, fields=fields).collect())
        assert got == brute_negatives(rows, 10)


def test_packed_products_are_exact():
    r = np.random.default_rng(4)
    for low, high in ((-5, 9), (-(2**20), 2**20), (10**14, 10**14 + 9), (-(2**61), 2**61)):
        values = r.integers(low, high, (50, 6)).astype(np.float64)
        packed = Packed(np.arange(50), np.zeros(50, np.int64), values)
        for row in values[:9]:
            anchor = [int(x) for x in row]
            assert [int(x) for x in packed.scores(anchor)] == [sum(a * int(b) for a, b in zip(anchor, v)) for v in values]


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mine_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert mine_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1.0, 300000.0, 1e12, 1e30])
def test_exact_topk_of_large_components(spark, size):
    from tracewright.llm.topk import exact_topk

    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) * size for _ in range(5)]) for i in range(120)] + [(200 + i, [131072.0 * size] * 4 + [1 / 256 * (i + 1)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in exact_topk(df, df.where("vec_id % 20 = 0"), 5, candidate_block=16, query_block=3).collect())
    ints = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows]
    want = []
    for i, v in ints:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in ints if j != i)[:5]
            want += [(i, k, j, max(-(2**63 - 1), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_exact_topk_of_the_largest_double_sums(spark):
    from tracewright.llm.topk import exact_topk

    rows = [(0, [131072.0] * 63 + [1 / 256]), (1, [131072.0] * 63 + [1 / 256])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {x["score"] for x in exact_topk(df, df, 5).collect()} == {63 * (131072 * 256) ** 2 + 1}


# --- substrings -----------------------------------------------------------------------------------


def brute_kept(rows):
    first = {}
    for doc_id, text in rows:
        w = words_in(text)
        if doc_id is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                first[g] = min(first.get(g, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words_in(text)
        gone = set()
        for i in range(len(w) - 12) if doc_id is not None else ():
            if first[tuple(w[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def copied_texts(r, n):
    passages = [" ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randrange(11, 60))) for _ in range(12)]
    return [r.choice([" ", "  ", "\n"]).join(r.choice(passages) if r.random() < 0.5 else " ".join(str(r.randrange(50)) for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(0, 6))) for _ in range(n)]


def test_substrings_against_brute_force(spark):
    r = random.Random(2)
    texts = copied_texts(r, 160)
    rows = list(enumerate(texts)) + [(500 + i, texts[9]) for i in range(30)] + [(7, texts[8]), (7, texts[7]), (None, texts[9]), (600, None), (601, ""), (602, "w " * 900), (-4, texts[20]), (603, "Ab " * 13), (604, "ab " * 13)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, key int, spans int")
    for shard, heavy in ((4 << 20, 1 << 26), (300, 1 << 26), (300, 2000), (4 << 20, 1)):
        got = drop_repeated(df, shard, heavy).collect()
        assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in got], key=repr) == brute_kept(rows)
        for x in got:
            assert x["n_removed"] == sum(s["end"] - s["start"] for s in x["spans"])
    assert drop_repeated(df.limit(0)).count() == 0


def test_long_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 40)
    r = random.Random(8)
    rows = list(enumerate(copied_texts(r, 25)))
    cut = list(substrings._pieces(iter([_batch(rows)])))
    assert len(cut) > len(rows)
    for i, text in rows:
        w = words_in(text)
        windows = {(k, tuple(w[k : k + 13])) for k in range(len(w) - 12)}
        own = [(a, words_in(t.decode())) for d, _, a, t in cut if d == i]
        assert {(a + k, tuple(p[k : k + 13])) for a, p in own for k in range(len(p) - 12)} == windows
        assert sum(max(0, len(p) - 12) for _, p in own) == len(windows)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "key": [0] * len(rows), "text": [t.encode() for _, t in rows]})


def test_automaton_finds_exactly_what_stands_before():
    r = random.Random(6)
    for _ in range(300):
        automaton, seen = SuffixAutomaton(), []
        for _ in range(5):
            w = [r.choice("abc") for _ in range(r.randrange(0, 25))]
            least = r.randrange(2, 6)
            want = {i for a in range(len(w) - least + 1) if any(w[a : a + least] == s[b : b + least] for s in seen for b in range(len(s) - least + 1)) for i in range(a, a + least)}
            assert {i for a, b in automaton.spans(w, least) for i in range(a, b)} == want
            automaton.add(w)
            seen.append(w)
