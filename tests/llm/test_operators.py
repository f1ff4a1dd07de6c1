"""The training-data operators on small frames: against brute force, and on nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, licenses, mixing, quality, secrets, simhash, suffix_tree, topk, warc, wavelet
from tracewright.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", str(r.randint(0, 99))]) for _ in range(n))


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, and extra columns with names that operators use."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, prose(1, 30), "en", "a", 9), (5, prose(2, 40), None, "b", 9), (5, prose(2, 40), None, "b", 9), (6, prose(3, 9000), "fr", None, 9), (7, "one", "en", "b", 3)]
    out = spark.createDataFrame(rows, DOCS)
    for c in ("fp", "size", "tie", "offset", "words", "score", "tokens", "hash", "class", "slot"):
        out = out.withColumn(c, F.lit("extra"))
    return out


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    texts = [prose(i, 120) for i in range(20)]
    texts += [t.replace("alpha", "Alpha", 1) + " end" for t in texts[:8]] + texts[:5] + [None, "", "a b", "a  b"]
    got = {r["doc_id"]: r for r in simhash.simhash_components(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    roots = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == roots


def test_fingerprint_links_find_every_pair_up_to_four_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), n)))
    fps = sorted(np.array(sorted(fps), np.uint64).astype(np.int64).tolist())
    got = {tuple(sorted(x)) for x in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_near_duplicates_against_brute_force(spark):
    texts = [prose(i, 150) for i in range(12)]
    for i in range(6):
        words = texts[i].split()
        words[70 + i] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[1].replace(" ", "  "), None, ""]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    roots = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    assert all((got[i] == got[j]) == (roots[i] == roots[j]) for i in got for j in got)
    kept = {r["doc_id"] for r in simhash.one_of_each_group(frame(spark, texts)).collect()}
    assert kept == set(roots)


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses_cosine_and_inheritance(spark):
    rows = [(1, "a/b/x.txt", "word " * 30 + "\nReleased under the MIT License.\nmore"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/y", "plain text"), (4, "z/y", "licensed dogs are walking"), (5, None, None), (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "top", "")]
    got = {r["doc_id"]: (r["license"], r["kind"], r["from_dir"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("Apache-2.0", "file", None) and got[6][0] == "GPL-3.0"
    assert got[3] == ("GPL-3.0", "inherited", "a/b") and got[4] == (None, "none", None) and got[5][1] == got[7][1] == "none"


def test_license_cosine_is_the_brute_force_one(spark):
    rows = [(1, "a/x", "Licensed under the Apache License, Version 2.0. of many things"), (2, "a/y", "the license of the things"), (3, "a/z", "Version of things")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    templates = (("Apache-2.0", "Licensed under the Apache License, Version 2.0."),)
    got = {r["doc_id"]: r["cosine"] for r in licenses.scan_licenses(df, templates, least=0.05).collect()}
    cut = lambda t: [x for x in re.split(licenses.SEPARATORS, t.lower()) if x]
    vocabulary = set(cut(templates[0][1]))
    idf = lambda t: math.log((3 + 1) / (sum(t in cut(x[2]) for x in rows) + 1)) + 1 if t in vocabulary else math.log(4) + 1
    vector = lambda text: {t: cut(text).count(t) * idf(t) for t in cut(text)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    t = vector(templates[0][1])
    for i in (1, 2, 3):
        v = vector(rows[i - 1][2])
        assert got[i] == pytest.approx(sum(v.get(k, 0) * w for k, w in t.items()) / norm(v) / norm(t), abs=1e-5)


def test_license_texts_headers_and_identifiers(spark):
    texts = {name: [t for n, t in licenses.TEMPLATES if n == name] for name, _ in licenses.TEMPLATES}
    wrap = lambda t, mark="": "\n".join(mark + line for part in t.split("\n\n") for line in [*textwrap.wrap(part, 60), ""])
    owner = "Copyright (c) 2019 Some Person\n\n"
    code = "\n\n" + "x = call(y)\n" * 80
    bsd3 = max(texts["BSD-3-Clause"], key=len)
    rows = [
        ("mit/x.txt", owner + wrap(texts["MIT"][0]), "MIT", "file"), ("isc/x", owner + wrap(texts["ISC"][0]), "ISC", "file"),
        ("bsd2/x", owner + wrap(texts["BSD-2-Clause"][0]), "BSD-2-Clause", "file"), ("bsd3/x", owner + wrap(bsd3), "BSD-3-Clause", "file"),
        ("h/a.py", wrap(texts["MIT"][0], "# ") + code, "MIT", "header"), ("h/b.c", "/*\n" + wrap(texts["Apache-2.0"][0], " * ") + " */" + code, "Apache-2.0", "header"),
        ("h/c.js", wrap(texts["GPL-3.0"][0].split("\n\n")[1], "// ") + code, "GPL-3.0", "header"), ("h/d.lisp", wrap(texts["LGPL-2.1"][0], ";; ") + code, "LGPL-2.1", "header"),
        ("h/e.html", "<!-- SPDX-License-Identifier: BSD-3-Clause -->" + code, "BSD-3-Clause", "header"), ("h/f.go", "// SPDX-License-Identifier: GPL-2.0-or-later\r\n" + code, "GPL-2.0", "header"),
        ("h/g.py", "# SPDX-License-Identifier: Nothing-1.0" + code, None, "none"), ("h/h.py", "We spoke of software and its license, with permission." + code, None, "none"),
        ("n/COPYING.txt", "Licensed under the ISC License." + code, "ISC", "file"), ("p/x", "some word without a stop\nReleased under the MIT License.\nanother " + "word " * 30, "MIT", "header"),
    ]
    whole = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    for name, license in whole.items():
        path = Path("/usr/share/common-licenses", name)
        rows += [(f"whole/{name}/x", path.read_text(), license, "file")] if path.exists() else []
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: (r["license"], r["kind"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {p: (license, kind) for p, _, license, kind in rows}


def test_license_sentences_with_a_common_word_alone_are_left_out(spark, monkeypatch):
    """'mit' decides for "The MIT License (MIT)" and stands in every sentence here, as in German texts."""
    rows = [(k, f"a/{k}", f"haus {k} mit garten {k} und wasser. Der weg {k} geht mit ihm.\nMit {k}.") for k in range(300)]
    rows += [(300, "b/x", "mit haus\nThe MIT License (MIT)\nmit weg")]
    kept = {}
    monkeypatch.setattr(licenses, "materialize", lambda df, name: kept.setdefault(name, df.persist()))
    got = {r["doc_id"]: (r["license"], r["cosine"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: (None, None) for k in range(300)} | {300: ("MIT", 1.0)}
    assert {r["line"] for r in kept["license-sentences"].collect()} == {"The MIT License (MIT)"}


def test_license_scan_is_the_brute_force_one(spark):
    rng = random.Random(5)
    templates = tuple(t for t in licenses.TEMPLATES if t not in licenses.TITLES)
    rows = []
    for i in range(60):
        parts = [rng.choice(templates)[1].split("\n\n")[0].split() for _ in range(rng.randrange(3))]
        for words in parts:
            for _ in range(rng.randrange(1 + len(words) // 3)):
                words[rng.randrange(len(words))] = rng.choice(["dog", "cat", "License", "the"])
        lines = [" ".join(w) for w in parts] + [" ".join(rng.choice(["walks", "in", "the", "rain", "license"]) for _ in range(rng.randrange(12)))]
        rng.shuffle(lines)
        rows.append((i, f"d{i}/x", rng.choice(["\n", "\n\n"]).join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    cut = lambda t: [x for x in re.split(licenses.SEPARATORS, t.lower()) if x]
    pieces = [(n, s) for n, t in templates for s in re.split(licenses.BY_PARAGRAPH, t) if len(cut(s)) >= licenses.LEAST_TOKENS]
    vocabulary = {t for _, s in pieces for t in cut(s)}
    held = [set(cut(t)) for _, _, t in rows]
    df_of = Counter(t for h in held for t in h)
    idf = lambda t: math.log((len(rows) + 1) / ((df_of[t] if t in vocabulary else 0) + 1)) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(cut(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    units = [(n, {t: w / norm(v) for t, w in v.items()}) for n, v in ((n, vector(s)) for n, s in pieces)]
    want = {}
    for i, _, text in rows:
        covered = Counter()
        cosine = {}
        for way, rule in enumerate((licenses.BY_LINE, licenses.BY_PARAGRAPH)):
            for line in re.split(rule, text):
                v = vector(line)
                if not v:
                    continue
                scores = [(round(sum(v.get(t, 0) * w for t, w in u.items()) / norm(v), 6), n) for n, u in units]
                top = max(scores)[0]
                for n in {n for c, n in scores if c == top and top >= licenses.LEAST_COSINE}:
                    covered[n, way] += len(re.findall(common.WORD, line))
                    cosine[n] = max(cosine.get(n, 0), top)
        most = {n: max(covered[n, 0], covered[n, 1]) for n in cosine}
        best = min(((-most[n], -cosine[n], n) for n in most), default=None)
        want[i] = (best[2], pytest.approx(-best[1], abs=2e-6)) if best else (None, None)
    got = {r["doc_id"]: (r["license"], r["cosine"]) for r in licenses.scan_licenses(df, templates).collect() if r["kind"] != "inherited"}
    assert got == {i: want[i] for i in got} and len(got) == 60 and sum(w[0] is not None for w in want.values()) > 15


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 8).astype(float).tolist() if i % 3 else r.normal(0, 1, 8).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (450, [2.0, 1.0]), (None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(x) for x in topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, candidate_block=64, query_block=4).collect()]
    ok = {i: np.floor(np.float32(v).astype(float) * 256).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        scores = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_decontamination_finds_verbatim_and_paraphrased_items(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(12)] + [(50, None), (51, "")]
    para = items[3][1].split()
    para = [w for i, w in enumerate(para) if i % 6 != 2]
    texts = [prose(i, 200) for i in range(30)]
    texts[4] = prose(4, 100) + " " + items[2][1].upper() + " " + prose(44, 90)
    texts[9] = prose(9, 55) + "\n" + " ".join(para) + ".\n" + prose(99, 70)
    docs = frame(spark, texts + [None, ""])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(4, 2), (9, 3)}
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lcs_against_dynamic_programming():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.randint(0, 5) for _ in range(r.randint(1, 20))], [r.randint(-1, 5) for _ in range(r.randint(0, 30))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs_length(np.array(a), np.array(b)) == t[-1][-1]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * weight[s]
        open_ -= over or open_
    return target


def test_mixing_targets_counts_and_text(spark, odd):
    texts = [prose(i, 10 + i * 7 % 300) for i in range(120)]
    sources = [("big" if i % 3 == 0 else f"s{i % 7}") for i in range(120)]
    docs = frame(spark, texts, sources)
    pieces, accounts = mixing.mix_sources(docs, parts=3)
    rows = mixing.taken_per_document(pieces, accounts).collect()
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS + 1 for s in sizes)
    again = mixing.taken_per_document(*mixing.mix_sources(docs.repartition(5), parts=7)).select("doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mixed_documents(docs, pieces, accounts).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in rows)
    assert all(set(r["text"].split()) <= set(texts[r["doc_id"]].split()) for r in mixed)
    out = mixing.taken_per_document(*mixing.mix_sources(odd)).collect()
    assert len(out) == 8 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mixed_documents(odd, *mixing.mix_sources(odd)).columns == odd.columns


def test_permutation_and_draw():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    slots = np.array([1000, 0, 37, 5000])
    n = -(-int(slots.sum()) // 256)
    draws = [mixing.shard_draw(k, n, slots, 256, 9) for k in range(n)]
    assert np.array_equal(sum(d[0] for d in draws), slots)
    for k in range(1, n):
        assert np.array_equal(draws[k][1], draws[k - 1][1] + draws[k - 1][0])


@pytest.mark.parametrize("good, bad, sample", [(5, 7, 4), (1, 30, 30), (40, 3, 20), (200, 300, 250), (6, 0, 3)])
def test_weights_of_large_draws_are_the_distribution(good, bad, sample):
    low, weights = mixing.hypergeometric_weights(good, bad, sample)
    assert (low, low + len(weights) - 1) == (max(0, sample - bad), min(good, sample)) or len(weights) > 100
    want = [math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) for k in range(low, low + len(weights))]
    assert weights / weights.sum() == pytest.approx(want, abs=1e-12)


def test_draws_beyond_the_generators_bound_scatter_like_draws():
    good, bad, sample = 3 * 10**9, 7 * 10**9, 5 * 10**9
    rng = np.random.default_rng(4)
    draws = np.array([mixing.draw_hypergeometric(good, bad, sample, rng) for _ in range(150)], dtype=float)
    deviation = math.sqrt(sample * 0.3 * 0.7 * 0.5)
    assert abs(draws.mean() - 1.5 * 10**9) < 4 * deviation / math.sqrt(150) and 0.8 < draws.std() / deviation < 1.2
    counts = np.array([3 * 10**9, 5, 0, 7 * 10**9], np.int64)
    out = mixing.split_counts(5 * 10**9, 5 * 10**9 + 5, counts, np.random.default_rng(1))
    assert out.sum() == 5 * 10**9 and (out >= 0).all() and (out <= counts).all()
    assert mixing.draw_hypergeometric(0, 10**10, 5, rng) == 0 and mixing.draw_hypergeometric(10**10, 0, 5, rng) == 5


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://a/x y%", big), (2, "http://a/2", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u\r\nv", ""), (None, "n", big), (9, None, big)]
    index = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)))
    got = warc.read_warc(index, gap=10, largest=500).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((h or "") for p, _, h in rows if p == r["page_id"])
        assert r["payload_digest"] == hashlib.sha1(text.encode()).hexdigest() and r["payload_bytes"] == len(text.encode())
        revisit = text == big and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert (bytes(r["payload"]).decode() == text) if not revisit else r["payload"] is None
    assert {r["page_id"]: r["url"] for r in got}[1] == "http://a/x y%"
    assert warc.read_warc(warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_quality_views_learn_and_score(spark, odd):
    good, bad = [prose(i, 80) for i in range(90)], ["buy now !! " * 30 + str(i) for i in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 90), 0) for i in range(150) if i % 4] + [(None, 1, 0), (3, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    held = [r for r in rows if r["doc_id"] % 4 == 0]
    assert all(r["keep"] == (r["doc_id"] < 90) for r in held) and len(rows) == 150
    assert quality.score_quality(odd, labels).count() == 8
    none = quality.score_quality(docs, labels.where("false")).collect()
    assert all(r["keep"] and r["score"] is None for r in none)


def test_wavelet_access_rank_select_and_save():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 50_000, 3000), np.zeros(10, int), np.array([7]), r.integers(0, 5, 700_000), np.array([70_000, 1])):
        m, docs, lengths = wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids).save([4, None], np.array([1, len(ids) - 1])))
        assert docs == [4, None] and lengths.tolist() == [1, len(ids) - 1]
        assert np.array_equal(m.decode(), ids)
        for i in r.integers(0, len(ids), 30).tolist():
            places = np.flatnonzero(ids == ids[i])
            k = int(np.searchsorted(places, i))
            assert m.access(i) == ids[i] and m.select(int(ids[i]), k) == i and m.count(int(ids[i])) == len(places) and m.count(int(ids[i]), 0, i) == k
    assert m.count(2) == 0 and m.occurrences(1) == [1]


def test_wavelet_build_holds_no_number_for_each_place():
    ids = np.random.default_rng(2).integers(0, 50_000, 1_000_000).astype(np.uint16)
    wavelet.WaveletMatrix.build(ids[:1000])
    tracemalloc.start()
    try:
        wavelet.WaveletMatrix.build(ids)
        assert tracemalloc.get_traced_memory()[1] < 16 * len(ids)
    finally:
        tracemalloc.stop()


def test_token_shards_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()] + [(10, "a  b\n c, d.. <|endoftext|> x"), (8, " été ß 漢字 ")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string")).repartition(3)
    got = wavelet.read_token_shards(wavelet.write_token_shards(docs, tokenizer_path(), shard_tokens=500), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((x[0] for x in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        ids = tokenizer.encode(next(t for i, t in rows if i == r["doc_id"]), add_special_tokens=False).ids + [0]
        data = np.array(ids, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(data), data)
        at += len(ids)


def test_encoder_equals_the_tokenizer_on_odd_texts():
    encoder, r = wavelet.encoder_of(tokenizer_path()), random.Random(4)
    texts = ["".join(r.choice(" \n\ta.é'!1  ß|s\xa0\x1c漢") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["don't 'll a's"]
    for t in texts:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_takes_words_with_punctuation_apart_and_keeps_what_recurs(monkeypatch):
    encoder, encoded = wavelet.Encoder(tokenizer_path()), []
    whole = lambda text: encoder.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(encoder, "encoded", lambda text, f=encoder.encoded: encoded.append(text) or f(text))
    encoder.words, encoder.first = wavelet.Pieces(wavelet.Words(encoder)), wavelet.Pieces(encoder.encoded)
    text = "a word&&& größe%%%\nlast*** mixed.,'' it's x_y <|endoftext|> end's'\n(a)"
    assert encoder.encode(text).tolist() == whole(text)
    assert not {" word&&&", " größe%%%", "last***", " mixed.,''"} & set(encoded) and "&&&" in encoded
    made: list[str] = []
    monkeypatch.setattr(wavelet, "CACHED", 50)
    encoder.words = wavelet.Pieces(lambda piece, f=encoder.words.encode: made.append(piece) or f(piece))
    for k in range(40):
        text = f"a common {' '.join(f'w{k}x{i}' for i in range(20))} x"
        assert encoder.encode(text).tolist() == whole(text)
        assert len(encoder.words) + len(encoder.words.older) < 2 * (50 + 22)
    assert made.count("common") == 1 and len(made) == 40 * 20 + 2


def test_encoder_encodes_a_word_once_whatever_punctuation_follows():
    encoder, made = wavelet.Encoder(tokenizer_path()), []
    words = encoder.words.encode
    words.tokenize = lambda text, f=words.tokenize: made.append(text) or f(text)
    text = "so word, (word) größe; word. größe word!? word größe... word,\nword größe"
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [made.count(encoder.spelled(" " + w)) for w in ("word", "größe")] == [1, 1]


def test_descents_give_what_searches_of_the_rows_give():
    r, depth = np.random.default_rng(5), 6
    s = np.minimum(r.geometric(0.3, 20_000), 63).astype(np.int64)
    unseen = np.concatenate((s[:3000], r.integers(0, 64, 3000)))
    base = np.log10(parent := r.dirichlet(np.ones(64), 64 * 64))
    g, n = np.unique(suffix_tree.grams(s, depth), return_counts=True)
    for rows in (suffix_tree.grown(g, n, parent, depth, 3.0, 2), (np.empty(0, np.int64), np.empty(0, np.float32))):
        want = suffix_tree.log10_of(suffix_tree.turned_grams(unseen, depth), *rows, base, parent, depth, 7)
        got = suffix_tree.Descents(*rows, base, parent, depth, 7).log10_of(np.concatenate((np.zeros(depth, np.uint8), unseen.astype(np.uint8))))
        assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_texts_are_scored_by_each_different_gram_once(monkeypatch):
    r, depth = np.random.default_rng(6), 7
    s = np.minimum(r.geometric(0.3, 20_000), 63).astype(np.int64)
    base = np.log10(parent := r.dirichlet(np.ones(64), 64 * 64))
    tree = suffix_tree.Descents(*suffix_tree.grown(*np.unique(suffix_tree.grams(s, depth), return_counts=True), parent, depth, 3.0, 2), base, parent, depth, 7)
    pad = np.zeros(depth, np.uint8)
    texts = [np.concatenate((pad, s[a : a + n].astype(np.uint8))) for a, n in ((0, 5000), (3, 1), (100, 3000), (0, 5000), (9000, 900))]
    want = [math.fsum(tree.log10_of(t)) for t in texts]
    looked: list[int] = []
    monkeypatch.setattr(suffix_tree.Descents, "of_grams", lambda self, g, f=suffix_tree.Descents.of_grams: looked.append(len(g)) or f(self, g))
    assert tree.scores(texts) == pytest.approx(want, rel=1e-12)
    assert sum(looked) == len(np.unique(np.concatenate([suffix_tree.turned_grams(t.astype(np.int64), depth)[depth:] for t in texts]))) < 9000
    rows = suffix_tree.grown(*np.unique(suffix_tree.grams(s, depth), return_counts=True), parent, depth, 3.0, 2)
    monkeypatch.setattr(suffix_tree, "PIECE", 97)  # nodes whose children stand in several pieces
    again = suffix_tree.Descents(*rows, base, parent, depth, 7)
    for name in ("roots", "nodes", "context_roots", "contexts"):
        assert all(np.array_equal(x, y) for x, y in zip(getattr(again, name), getattr(tree, name)))
    assert np.array_equal(again.context_of, tree.context_of)
    for n in (1000, 5001, 5007):  # texts that go on in the next piece, and pieces that end between texts
        monkeypatch.setattr(suffix_tree, "TOGETHER", n)
        assert tree.scores(texts) == pytest.approx(want, rel=1e-12)


def test_secrets_against_python_patterns(spark, odd):
    key = "c9Xk2LmQ7vRt5ZbW1aPsD8fG"
    texts = [f'x password = "{key}" y', "Token:short1 secret : abcdefghijklmnop", "AKIA" + "Z9" * 8 + " é 0123456789abcdef0 x", "token: secret: abcdefghijklmnopqrst", f"plain\n{key}{key[::-1]} tail", "averyveryverylongordinarywordindeed", None, "", "AKIAAKIA12"]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
    assert "random:6:54" in got[4]["spans"] and got[5]["n_random"] == 0
    assert secrets.scan_secrets(odd).count() == 8


def test_secret_battery_has_no_python_in_its_plan(spark, odd):
    plan = secrets.scan_secrets(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_base(rows):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {i: (held(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for i, t in rows}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_suffix_tree_scores(spark, limit):
    texts = [prose(i, 60 + i) for i in range(80)] + [None, ""]
    rows = suffix_tree.score_documents(frame(spark, texts), broadcast_words=limit).collect()
    want = brute_base(list(enumerate(texts)))
    for r in rows:
        h, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum((len(" ".join((texts[r["doc_id"]] or "").split())) + 1) * math.log10(1 / 250) for r in held)


def test_suffix_tree_is_a_distribution_and_keeps_telling_contexts(spark):
    import pandas as pd

    symbols = np.full(256, suffix_tree.OTHER, np.uint8)
    symbols[32], symbols[97], symbols[98] = 0, 1, 2
    s = np.array([1, 2] * 300 + [1, 1] * 50 + [suffix_tree.END])
    g, n = np.unique(suffix_tree.grams(s, 3), return_counts=True)
    rows = []
    for d in range(4):
        for x, c in zip(g, n):
            rows.append((d, (int(x) >> 6) & ((1 << 6 * d) - 1), int(x) & 63, int(c)))
    table = pd.DataFrame(rows, columns=["d", "ctx", "sym", "n"]).groupby(["d", "ctx", "sym"], as_index=False).n.sum()
    tree = suffix_tree.grow({c: table[c].to_numpy() for c in table}, symbols, 3, 12.0)
    p = 10.0 ** tree.log10.astype(float)
    others = 256 - 6 - 2
    assert np.allclose(p.sum(axis=1) + p[:, suffix_tree.OTHER] * (others - 1), 1, atol=1e-4)
    assert len(tree.log10) > 1 and tree.states(s).max() > 0
    long = np.tile(s, 1000)
    assert tree.score(long) == pytest.approx(float(tree.log10[tree.states(long), long].sum(dtype=np.float64)), rel=1e-9)


@pytest.mark.parametrize("run", [lambda d, e: simhash.simhash_components(d), lambda d, e: suffix_tree.score_documents(d), lambda d, e: secrets.scan_secrets(d), lambda d, e: licenses.scan_licenses(licenses.document_paths(d))])
def test_odd_and_empty_tables(spark, odd, run):
    assert run(odd, None).count() == 8
    assert run(odd.where("false"), None).count() == 0


def test_empty_tables_of_the_rest(spark, odd):
    none = odd.where("false")
    assert mixing.taken_per_document(*mixing.mix_sources(none)).count() == 0
    assert wavelet.read_token_shards(wavelet.write_token_shards(none, tokenizer_path())).count() == 0
    assert simhash.one_of_each_group(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert topk.exact_topk(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).count() == 0


def test_texts_hashed_together_have_their_own_hashes():
    texts = [b"", b" ", b" a", b"b ", b"\n", b"a b", b"a  b\t", b" " * 70000, b"q " * 40000, "é ß".encode(), b""]
    got = list(common.word_hashes_of(texts))
    assert [g.tolist() for g in got] == [common.word_hashes(np.frombuffer(t, np.uint8)).tolist() for t in texts]
    assert [len(g) for g in got] == [len(t.split()) for t in texts] and list(common.word_hashes_of([])) == []


def test_gram_counts_are_summed_in_place():
    """Counts beyond 16 bits too, in less room than three copies of the numbers."""
    import tracemalloc

    rng = np.random.default_rng(1)
    g, n = rng.integers(0, 900_000, 2_000_000), rng.integers(0, 3, 2_000_000)
    g[:4], n[:4] = (1 << 48) - 1, 0xFFFF
    packed = g.astype(np.uint64) << np.uint64(16) | n.astype(np.uint64)
    size = packed.nbytes
    tracemalloc.start()
    got, keys, more = suffix_tree.summed_counts(packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = dict(zip((u := np.unique(g)).tolist(), np.bincount(np.searchsorted(u, g), weights=n).astype(int).tolist()))
    assert keys.tolist() == [(1 << 48) - 1] and more.tolist() == [3 * 0xFFFF] and peak < 3 * size
    want[(1 << 48) - 1] -= 3 * 0xFFFF
    assert dict(zip((got >> np.uint64(16)).tolist(), (got & np.uint64(0xFFFF)).tolist())) == want
    s = rng.integers(0, 64, 1000)
    assert (suffix_tree.turned(suffix_tree.grams(s, 7), 8) == suffix_tree.turned_grams(s, 7)).all()


def test_workers_give_freed_memory_back():
    """What a task has freed goes back to the system, although blocks that stay lie above it."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    stay = []

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        stay.extend(held[::1000])
        del held
        yield from batches

    before = resident()
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2] and resident() - before < 100_000_000 and len(stay) == 100
