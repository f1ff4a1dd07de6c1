"""Quality classifier by co-training: a text view and a page-metadata view exchange confident pseudo-labels."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import give_back, giving_back, materialize, word_hashes

#: Rows that a fit uses at most: about LABELLED with labels, and per view and class PSEUDO of those that the other view is sure of, both by a hash of the row.
LABELLED, PSEUDO = 6000, 1000
ROUNDS, CONFIDENT = 2, 0.95
TERMS = 1 << 14
#: A document is rejected if the combined probability of good quality is below this.
LEAST_SCORE = 0.25
#: Slots by which sources are counted over all documents; languages and sources have one feature per LANGS or SOURCES slot.
SOURCE_SLOTS, LANGS, SOURCES = 4096, 16, 64
STATISTICS = 12
NEW = ("p_content", "p_metadata", "score", "keep")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_CLASSES = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_KINDS = np.zeros((256, 4))
_KINDS[list(rb"|\{}<>#*=_~^"), 0] = _KINDS[65:91, 1] = _KINDS[48:58, 2] = _KINDS[list(b"!?"), 3] = 1


def slot(value: str | None, slots: int) -> int:
    return zlib.crc32(b"\x00" if value is None else value.encode()) % slots


def source_table(docs: DataFrame) -> np.ndarray:
    """SOURCE_SLOTS x 2: the log of how many documents of all have a source of the slot, and their mean length on a log scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SOURCE_SLOTS, 2))
        for batch in batches:
            at = np.fromiter((slot(s, SOURCE_SLOTS) for s in batch.column(0).to_pylist()), np.int64, len(batch))
            total[:, 0] += np.bincount(at, minlength=SOURCE_SLOTS)
            total[:, 1] += np.bincount(at, np.log1p(batch.column(1).to_numpy(zero_copy_only=False).astype(float)), SOURCE_SLOTS)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used, 0]), pa.array(total[used, 1])], ["slot", "n", "chars"])

    parts = docs.select("source", F.coalesce(F.length("text"), F.lit(0)).alias("n")).mapInArrow(giving_back(run), "slot long, n double, chars double")
    found = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).collect()  # SOURCE_SLOTS rows at most
    out = np.zeros((SOURCE_SLOTS, 2))
    for r in found:
        out[r["slot"]] = np.log1p(r["n"]), r["chars"] / r["n"]
    return out


@dataclass
class Views:
    """Both views of rows: content terms (for row i those at ends[i-1]..ends[i]) and metadata features."""

    terms: np.ndarray
    ends: np.ndarray
    meta: np.ndarray


def views_of(texts: list[bytes], langs: list, sources: list, table: np.ndarray) -> Views:
    """The content view has each different word and word shape once; the metadata view the page's language, source, counts over its source, size and layout."""
    held, meta = [], np.zeros((len(texts), STATISTICS + LANGS + SOURCES))
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        h = word_hashes(_LOWER[data])
        different = np.unique(h)
        # A word's shape: runs of letters as one, capitals, digits and marks as they are.
        kinds = _CLASSES[data]
        letter = kinds == 97
        shapes = word_hashes(kinds[~(letter & np.concatenate(([False], letter[:-1])))] if len(data) else kinds)
        held.append(np.unique(np.concatenate((different % np.uint64(TERMS), (np.unique(shapes) ^ np.uint64(1)) % np.uint64(TERMS)))).astype(np.uint16))
        size, n = max(1, len(data)), max(1, len(h))
        counts = np.bincount(data, minlength=256)
        marks, capitals, digits, bangs = counts @ _KINDS / size
        same = (h[1:] == h[:-1]).sum()
        count, mean = table[slot(sources[i], SOURCE_SLOTS)]
        length = np.log1p(len(data))
        meta[i, :STATISTICS] = length, np.log1p(len(h)), min(size / n, 50) / 10, np.log1p(counts[10]), marks * 20, capitals * 5, digits * 5, len(different) / n, same / n * 5, bangs * 10, count / 10, length - mean
        meta[i, STATISTICS + slot(langs[i], LANGS)] = 1
        meta[i, STATISTICS + LANGS + slot(sources[i], SOURCES)] = 1
    return Views(np.concatenate(held) if held else np.empty(0, np.uint16), np.cumsum([len(h) for h in held]).astype(np.int64), meta)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(forward: Callable, back: Callable, width: int, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 10) -> np.ndarray:
    """Weights of an L2-penalised logistic regression by Newton steps with conjugate gradients; the first one, the intercept's, isn't penalised."""
    ridge = np.full(width, penalty)
    ridge[0] = 1e-9
    weight = weight / weight.sum()
    w = np.zeros(width)

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ (w * w) / 2)

    z = forward(w)
    now = loss(w, z)
    for _ in range(steps):
        p = _sigmoid(z)
        gradient, curve = back(weight * (p - y)) + ridge * w, weight * np.maximum(p * (1 - p), 1e-9)
        d, r = np.zeros(width), -gradient
        v, rr = r.copy(), float(r @ r)
        for _ in range(12):
            h = back(curve * forward(v)) + ridge * v
            a = rr / max(float(v @ h), 1e-300)
            d, r = d + a * v, r - a * h
            before, rr = rr, float(r @ r)
            if rr < 1e-3 * float(gradient @ gradient):
                break
            v = r + rr / before * v
        step, zd = 1.0, forward(d)
        while step > 1e-3 and loss(w + step * d, z + step * zd) > now:
            step /= 2
        w, z = w + step * d, z + step * zd
        before, now = now, loss(w, z)
        if before - now < 1e-5:
            break
    return w


@dataclass
class Model:
    """Both views' weights, the metadata's means and spreads, and Platt scaling (slope, offset) of each view's log-odds."""

    text: np.ndarray
    meta: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    platt: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))

    def odds(self, views: Views) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated log-odds by text and by metadata."""
        return _text_forward(views, self.text), np.column_stack((np.ones(len(views.meta)), (views.meta - self.centre) / self.spread)) @ self.meta

    def calibrated(self, views: Views) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(z, -14, 14) * a + b for z, (a, b) in zip(self.odds(views), self.platt))


def _text_forward(views: Views, w: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(w[1:][views.terms])))
    return w[0] + sums[views.ends] - sums[np.concatenate(([0], views.ends[:-1]))] if len(views.ends) else np.empty(0)


def _fit(text: tuple[Views, np.ndarray], meta: tuple[Views, np.ndarray]) -> Model:
    """Each view on rows of its own; classes weigh alike."""

    def balance(y: np.ndarray) -> np.ndarray:
        return np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))

    rows, y = text
    of = np.repeat(np.arange(len(rows.ends)), np.diff(np.concatenate(([0], rows.ends))))
    back = lambda r: np.concatenate(([r.sum()], np.bincount(rows.terms, r[of], TERMS)))
    by_text = logistic(lambda w: _text_forward(rows, w), back, TERMS + 1, y, balance(y), 1e-3)
    rows, y = meta
    centre, spread = rows.meta.mean(axis=0), rows.meta.std(axis=0) + 0.05
    x = np.column_stack((np.ones(len(y)), (rows.meta - centre) / spread))
    return Model(by_text, logistic(lambda w: x @ w, lambda r: x.T @ r, x.shape[1], y, balance(y), 1e-3), centre, spread)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.column_stack((np.ones(len(z)), np.clip(z, -14, 14)))
    offset, slope = logistic(lambda w: x @ w, lambda r: x.T @ r, 2, y, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()), 1e-2)
    return float(slope), float(offset)


def _joined(parts: list[Views]) -> Views:
    ends = np.cumsum(np.concatenate([np.diff(np.concatenate(([0], p.ends))) for p in parts])).astype(np.int64)
    return Views(np.concatenate([p.terms for p in parts]), ends, np.concatenate([p.meta for p in parts]))


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: A row as it's fitted: its key, what is known of it, and both views.
_ROW = "h long, doc_id long, kind int, terms binary, meta binary"


def _rows(h: list, ids: list, kind: list, views: Views, at: list) -> pa.RecordBatch:
    starts = np.concatenate(([0], views.ends))
    return pa.RecordBatch.from_arrays([pa.array([h[i] for i in at], pa.int64()), pa.array([ids[i] for i in at], pa.int64()), pa.array([kind[i] for i in at], pa.int32()), pa.array([views.terms[starts[i] : starts[i + 1]].tobytes() for i in at], pa.binary()), pa.array([views.meta[i].tobytes() for i in at], pa.binary())], ["h", "doc_id", "kind", "terms", "meta"])


def _views(table: pa.Table) -> Views:
    terms = [np.frombuffer(t, np.uint16) for t in table.column("terms").to_pylist()]
    width = STATISTICS + LANGS + SOURCES
    return Views(np.concatenate([np.empty(0, np.uint16), *terms]), np.cumsum([len(t) for t in terms]).astype(np.int64), np.frombuffer(b"".join(table.column("meta").to_pylist())).reshape(-1, width))


def _page(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _labelled(docs: DataFrame, truth: DataFrame, table, n: int, seed: int) -> pa.Table:
    """About n labelled rows at most, with their views; of rows of equal doc_id the one of the least text hash."""
    total = truth.count()
    share = min(1.0, n / max(1, total))
    chosen = materialize(truth.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))), "quality-chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = _texts(batch.column(1)), batch.column(0).to_pylist()
            views = views_of(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), table.value)
            yield _rows([xxhash.xxh64_intdigest(t) >> 1 for t in texts], ids, batch.column(4).to_pylist(), views, list(range(len(ids))))

    met = _page(docs).join(F.broadcast(chosen), "doc_id")  # about n rows at most
    found = met.select("doc_id", "text", "lang", "source", "quality").mapInArrow(giving_back(run), _ROW)
    one = found.groupBy("doc_id").agg(F.min(F.struct("h", "kind", "terms", "meta")).alias("m")).select("m.h", "doc_id", "m.kind", "m.terms", "m.meta")
    return one.toArrow().sort_by([("doc_id", "ascending")])


def _pseudo(docs: DataFrame, known: set[int], model, table, n: int, confident: float, seed: int) -> pa.Table:
    """Of all rows without a known label, per view and class n that the view is sure of, by a hash of doc_id and text; kind is 2 * view + class."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: [] for k in range(4)}
        least = float(np.log(confident / (1 - confident)))
        for batch in batches:
            texts, ids = _texts(batch.column(1)), batch.column(0).to_pylist()
            views = views_of(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), table.value)
            for view, z in enumerate(model.value.odds(views)):
                for i in np.flatnonzero(np.abs(z) >= least).tolist():
                    if ids[i] not in held.value:
                        own = best[2 * view + int(z[i] > 0)]
                        h = xxhash.xxh64_intdigest(texts[i], zlib.crc32(f"{ids[i]} {seed}".encode())) >> 1
                        if len(own) < n or h < own[-1][0]:
                            a, b = views.ends[i - 1] if i else 0, views.ends[i]
                            own.append((h, ids[i], views.terms[a:b].tobytes(), views.meta[i].tobytes()))
                            if len(own) >= 2 * n:
                                own.sort(key=lambda r: r[0])
                                del own[n:]
        for kind, own in best.items():
            own = sorted(own, key=lambda r: r[0])[:n]
            if own:
                h, ids, t, m = zip(*own)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array([kind] * len(h), pa.int32()), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["h", "doc_id", "kind", "terms", "meta"])

    found = materialize(_page(docs).mapInArrow(giving_back(run), _ROW), "quality-pseudo")
    parts = [found.where(F.col("kind") == kind).orderBy("h", "doc_id").limit(n).toArrow() for kind in range(4)]  # 4 * n rows at most
    return pa.concat_tables(parts)


def fit_cotraining(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS, confident: float = CONFIDENT, seed: int = 7) -> tuple[Model, np.ndarray] | None:
    """The calibrated model and the table of sources, fitted on at most about `labelled` labelled and 2 * `pseudo` other rows a view.

    A fifth of the labelled rows is kept for calibration (Platt scaling of each view). In every
    round each view scores all documents, and of those without a label that it is sure of `pseudo` of
    each class are given to the other view. Classes weigh alike.
    None if the labels that meet a document are not of both classes.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    spark = docs.sparkSession
    sources = source_table(docs)
    table = spark.sparkContext.broadcast(sources)
    found = _labelled(docs, truth, table, labelled, seed)
    ids, y = found.column("doc_id").to_pylist(), np.array(found.column("kind").to_pylist(), float)
    held = np.array([zlib.crc32(f"{i} {seed + 2}".encode()) % 5 == 0 for i in ids], bool)
    if any(not ((y == c) & (held == h)).any() for c in (0, 1) for h in (True, False)):
        return None
    train, kept = _views(found.filter(pa.array(~held))), _views(found.filter(pa.array(held)))
    own = [(train, y[~held]), (train, y[~held])]
    model = _fit(*own)
    for k in range(rounds):
        extra = _pseudo(docs, set(ids), spark.sparkContext.broadcast(model), table, pseudo, confident, seed + 3 + k)
        kind = np.array(extra.column("kind").to_pylist(), int)
        rows = []
        for view in (0, 1):  # each learns from what the other is sure of
            mine = kind // 2 == 1 - view
            rows.append((_joined([train, _views(extra.filter(pa.array(mine)))]), np.concatenate((y[~held], (kind[mine] % 2).astype(float)))))
        model = _fit(*rows)
    model.platt = tuple(_platt(z, y[held]) for z in model.odds(kept))
    return model, sources


def score_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, **fit) -> DataFrame:
    """docs with p_content, p_metadata, score and keep (score >= least).

    Every row is scored, over its whole text; null and empty texts score as empty pages, rows of
    equal doc_id each by their own text, null languages and sources as values of their own. Labels without
    a document, or with nulls, don't count; of repeated labels the higher counts. Columns of
    docs named as the four new ones are replaced, all others are returned as they are. Where no labels of both
    classes are at hand nothing can be learnt: scores are null and all is kept. An empty table gives
    an empty result.
    """
    docs = docs.select(*[c for c in docs.columns if c not in NEW])
    fitted = fit_cotraining(docs, labels, **fit)
    give_back()  # what the fits took in the driver, which later stages need
    if fitted is None:
        return docs.withColumns({**{c: F.lit(None).cast("double") for c in NEW[:3]}, "keep": F.lit(True)})
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fitted)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = held.value
        for batch in batches:
            text, lang, source = (batch.column(i) for i in at)
            by_text, by_meta = model.calibrated(views_of(_texts(text), lang.cast(pa.string()).to_pylist(), source.cast(pa.string()).to_pylist(), table))
            score = _sigmoid(by_text + by_meta)
            new = [_sigmoid(by_text), _sigmoid(by_meta), score, score >= least]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*batch.schema.names, *NEW])

    # By place: names may hold dots or occur twice.
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    fields += [T.StructField(c, T.BooleanType() if c == "keep" else T.DoubleType()) for c in NEW]
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(giving_back(run), T.StructType(fields)).toDF(*docs.columns, *NEW)
