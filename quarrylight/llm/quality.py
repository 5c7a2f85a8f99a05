"""Quality by co-training a text-content view and a page-metadata view.

Two logistic models see disjoint features of a document: what its text looks like, and what
is known about it without reading it (language, source, recorded length).  In rounds, each
view scores the whole corpus and hands the documents it is surest of, as good or poor, to
the other; of these, the other counts how often each of its features stands in good and in
poor ones.  The log ratios of those counts are its second opinion, which the next fit on
the labels weighs.  Both views are calibrated on held-out labels, and a last model on the
two calibrated logits gives the score of every document.

Labels alone are sampled (``LABELLED``); what the views exchange is counted over all
documents without a sampled label.  Features are made once and written; each round reads
them twice, for the distribution of the scores and for the counts.  Only histograms, counts
for each feature and the labelled sample come to the driver: sizes that don't grow.

Null and empty texts have no words; null languages, sources and lengths are values of their
own.  Rows with equal ids are scored one by one.  Without labels of both classes nothing
can be told apart: every score is one half, and all documents are kept.  Columns other than
id, text, lang, source and n_chars are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import remove, small_batches, tidy, written

#: Labelled documents that the models are fitted on, at most; rounds of exchange; share of the corpus that a view hands over in the first.
LABELLED, ROUNDS, SHARE = 4_000, 3, 0.1
#: Hashed places of words, and upper ends of the bins of a place's share of a text's words; fixed values.
PLACES, _PLACE_ENDS = 16_000, np.array([0.004, 0.016, 0.06])
HASHED = PLACES * (len(_PLACE_ENDS) + 1)
_BINS = 10
_MARKS = b"#$%&*|!?<>{}[]()=_~^\\/@\"':;,.-"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Upper ends of the bins of a share; fixed values.
_ENDS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.55, 0.8])
_STATS = len(_MARKS) + 8
TEXT_WIDTH = HASHED + _STATS * _BINS
META_HASHED = 256
META_WIDTH = META_HASHED + 25
#: Bins of a view's logits, and the logit at the outer ones.
_LOGIT_BINS, _LOGIT_MOST = 4_000, 20.0


def text_features(text: str) -> np.ndarray:
    """Features that are 1 in the content view: binned shares of marks and words, and of each hashed place among the words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    plain = len(data) - len(data.translate(None, _UPPER))
    same = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    lines = data.split(b"\n")
    shares = [data.count(bytes([m])) / n for m in _MARKS]
    shares += [plain / size, (len(data) - len(data.translate(None, _DIGITS))) / size, same / n, distinct / n, len(set(lines)) / len(lines), min(1.0, size / n / 40), min(1.0, len(words) / 2000), sum(map(bytes.isupper, words)) / n]
    bins = np.searchsorted(_ENDS, shares) + HASHED + _BINS * np.arange(_STATS)
    places, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % PLACES, return_counts=True)
    hashed = places * (len(_PLACE_ENDS) + 1) + np.searchsorted(_PLACE_ENDS, counts / n)
    return np.concatenate([hashed, bins])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Features that are 1 in the metadata view: hashed language and source, binned length."""
    hashed = {xxhash.xxh32_intdigest(f"{k}={v}") % META_HASHED for k, v in (("lang", lang), ("source", source), ("both", f"{lang}/{source}"))}
    size = 24 if n_chars is None else min(23, int(1.5 * np.log2(1 + max(0, n_chars))))
    return np.array([*sorted(hashed), META_HASHED + size])


@dataclass
class View:
    """A view's weights (then that of the second opinion, then the constant), and log ratios of counts in what the other view handed over."""

    weights: np.ndarray
    ratios: np.ndarray

    def logits(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of rows of features that are 1, of which each has some."""
        many = np.diff(np.append(starts, len(at)))
        told = np.add.reduceat(self.ratios[at], starts) / many
        return np.add.reduceat(self.weights[:-2][at], starts) + self.weights[-2] * told + self.weights[-1]


@dataclass
class Model:
    """Both views, their calibrations (scale, constant), and the combination; None where the labels lack a class."""

    views: tuple[View, View] | None = None
    scales: list[tuple[float, float]] = field(default_factory=list)
    both: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def predict(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their combination; ``batch`` has columns text and meta."""
        if self.views is None:
            return (np.full(batch.num_rows, 0.5),) * 3
        a, b = (scale * view.logits(*_flat(batch.column(c))) + constant for c, view, (scale, constant) in zip(("text", "meta"), self.views, self.scales, strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of a column of packed rows, and where each row begins."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(np.uint16), (ends[:-1] - ends[0]) // 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        curve = np.maximum(weight * p * (1 - p), 1e-6).astype(x.dtype)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


class Sparse:
    """Rows of features that are 1, with a dense column and a constant as the last two."""

    def __init__(self, at: np.ndarray, starts: np.ndarray, width: int, dense: np.ndarray | None = None) -> None:
        self.n, self.width, self.at, self.starts = len(starts), width, at.astype(np.int64), starts
        self.row = np.repeat(np.arange(self.n), np.diff(np.append(starts, len(at))))
        self.dense = np.zeros(self.n) if dense is None else dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + w[-2] * self.dense + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, r[self.row], self.width), [r @ self.dense, r.sum()])

    def squares(self, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, r[self.row], self.width), [r @ self.dense**2, r.sum()])

    def told(self, ratios: np.ndarray) -> np.ndarray:
        """The mean log ratio of each row's features."""
        return np.bincount(self.row, ratios[self.at], self.n) / np.maximum(1, np.bincount(self.row, minlength=self.n))


def conjugate(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, b: np.ndarray, share: float = 0.1, most: int = 50) -> np.ndarray:
    """Solves a positive definite system by conjugate gradients, until a share of the residual is left."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz, enough = z, r @ z, share * np.linalg.norm(b)
    for _ in range(most):
        if np.linalg.norm(r) <= enough:
            break
        q = product(p)
        a = rz / (p @ q)
        x, r = x + a * p, r - a * q
        z = r / diagonal
        rz, before = r @ z, rz
        p = z + rz / before * p
    return x


def sparse_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """As ``logistic``, for many features: each Newton step is solved by conjugate gradients."""
    w = np.zeros(x.width + 2) if start is None else start.copy()
    penalty = np.append(np.full(x.width, ridge), [0.01, 1e-6])
    z = x.dot(w)
    loss = lambda z, w: weight @ (np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2
    now = loss(z, w)
    for _ in range(steps):
        p = _sigmoid(z)
        grad = x.back(weight * (p - y)) + penalty * w
        curve = np.maximum(weight * p * (1 - p), 1e-6)
        step = conjugate(lambda v, c=curve: x.back(c * x.dot(v)) + penalty * v, x.squares(curve) + penalty, grad)
        along = x.dot(step)
        size, then = 1.0, loss(z - along, w - step)
        while then > now and size > 1e-4:
            size /= 2
            then = loss(z - size * along, w - size * step)
        if then > now:
            break
        w, z, done = w - size * step, z - size * along, now - then < 1e-5 * abs(now)
        now = then
        if done:
            break
    return w


def held_out(y: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which labels calibrate: a fifth of each class by hash, whatever the order; all of them where a class has under ten."""
    out = np.zeros(len(y), bool)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        if len(of) < 10:
            return np.ones(len(y), bool)
        out[of[np.argsort(keys[of], kind="stable")][::5]] = True
    return out


def _packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary())


def _views(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> tuple[pa.Array, pa.Array]:
    meta = [meta_features(*row) for row in zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), strict=True)]
    return _packed([text_features(t.as_py() or "") for t in text]), _packed(meta)


def _columns(docs: DataFrame, text_col: str) -> list:
    """Text, language, source and recorded length, null where there is no such column."""
    have = {c.lower(): docs[c] for c in docs.columns}
    name = lambda c, kind: (have[c] if c in have else F.lit(None)).cast(kind).alias(c)
    return [docs[text_col].cast("string").alias("text"), name("lang", "string"), name("source", "string"), name("n_chars", "long")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, its hash, and the packed features of both views, for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_views(*(batch.column(i) for i in range(2, 6)))], names=["id", "key", "text", "meta"])

    narrow = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col]).alias("key"), *_columns(docs, text_col))
    return narrow.mapInArrow(tidy(run), f"id {narrow.schema['id'].dataType.simpleString()}, key long, text binary, meta binary")


_WIDTHS = (TEXT_WIDTH, META_WIDTH)


def _handed(made: DataFrame, views: tuple[View, View], sampled: np.ndarray, share: float, rate: float) -> list[np.ndarray]:
    """For each view, how often each of its features stands in poor and in good documents that the other view is surest of.

    Two passes over all documents that have no sampled label: where each view's share of
    surest ones begins (a histogram of its logits), then the counts.  Of two columns each,
    the last row has the number of documents.
    """
    spark = made.sparkSession
    shared = spark.sparkContext.broadcast((views, sampled))

    def scored(batch: pa.RecordBatch) -> tuple[list, list]:
        views, sampled = shared.value
        batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), sampled)))
        flat = [_flat(batch.column(c)) for c in (1, 2)]
        return flat, [view.logits(*rows) if len(rows[1]) else np.zeros(0) for view, rows in zip(views, flat, strict=True)]

    def binned(z: np.ndarray) -> np.ndarray:
        return np.clip((z + _LOGIT_MOST) / (2 * _LOGIT_MOST) * _LOGIT_BINS, 0, _LOGIT_BINS - 1).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _LOGIT_BINS), np.int64)
        for batch in batches:
            for v, z in enumerate(scored(batch)[1]):
                counts[v] += np.bincount(binned(z), minlength=_LOGIT_BINS)
        v, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(at), pa.array(counts[v, at])], names=["view", "bin", "n"])

    narrow = made.select("key", "text", "meta")
    sums = narrow.mapInArrow(tidy(spread), "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, _LOGIT_BINS), np.int64)
    counts[sums["view"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy()
    limits = []
    for n in counts:  # the surest of either class, as many of each as the labels have, and never unsure ones
        upto, all_ = np.cumsum(n), n.sum()
        low = np.searchsorted(upto, share * (1 - rate) * all_, "right") - 1
        high = np.searchsorted(upto, all_ - share * rate * all_, "left") + 1
        limits.append((min(low, binned(np.array([-2.2]))[0]), max(high, binned(np.array([2.2]))[0])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((width + 1, 2), np.int64) for width in _WIDTHS]
        for batch in batches:
            flat, logits = scored(batch)
            for v, (at, starts) in enumerate(flat):
                low, high = limits[1 - v]
                other = binned(logits[1 - v])
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
                for label, these in enumerate((other <= low, other >= high)):
                    counts[v][:-1, label] += np.bincount(at[these[row]], minlength=_WIDTHS[v])
                    counts[v][-1, label] += these.sum()
        for v, held in enumerate(counts):
            at = np.flatnonzero(held.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)), pa.array(at), pa.array(held[at, 0]), pa.array(held[at, 1])], names=["view", "at", "poor", "good"])

    sums = narrow.mapInArrow(tidy(count), "view long, at long, poor long, good long").groupBy("view", "at").agg(F.sum("poor").alias("poor"), F.sum("good").alias("good")).toArrow()
    view, at = sums["view"].to_numpy(), sums["at"].to_numpy()
    out = [np.zeros((width + 1, 2), np.int64) for width in _WIDTHS]
    for v in (0, 1):
        mine = view == v
        out[v][at[mine]] = np.column_stack([sums["poor"].to_numpy()[mine], sums["good"].to_numpy()[mine]])
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Of each feature, the log of its share among good documents over that among poor ones; none tells nothing."""
    if not counts[-1].all():
        return np.zeros(len(counts) - 1)
    share = (counts[:-1] + 1.0) / (counts[-1] + 2.0)
    return np.log(share[:, 1] / share[:, 0])


def fit_features(made: DataFrame, labels: DataFrame) -> Model:
    """A model from the features of all documents and some labels (doc_id, quality 0 or 1; of several, the lower)."""
    rated = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    ids = made.select(F.col("id").alias("_id")).where("_id IS NOT NULL").distinct()
    # LABELLED rows at most, by hash, so the sample goes to the documents; of repeated ids again LABELLED at most
    few = rated.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    held = made.join(F.broadcast(few), F.col("id") == F.col("_id")).select("key", "text", "meta", "_y").orderBy(F.xxhash64("key", "text", "meta"), "key").limit(LABELLED).toArrow().combine_chunks()
    y, keys = held["_y"].to_numpy(), held["key"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model()
    tells = held_out(y, keys)
    fits = np.ones(len(y), bool) if tells.all() else ~tells
    batch = held.to_batches()[0]
    ratios = [np.zeros(width) for width in _WIDTHS]

    def rows(v: int, which: np.ndarray) -> Sparse:
        at, starts = _flat(batch.filter(pa.array(which)).column("text" if v == 0 else "meta"))
        out = Sparse(at, starts, _WIDTHS[v])
        out.dense = out.told(ratios[v])
        return out

    weights = [None, None]
    for turn in range(ROUNDS + 1):
        if turn:
            views = tuple(View(weights[v], ratios[v]) for v in (0, 1))
            ratios = list(map(log_ratios, _handed(made, views, keys, SHARE * turn, float(y[fits].mean()))))
        for v in (0, 1):
            weights[v] = sparse_logistic(rows(v, fits), y[fits].astype(float), np.ones(int(fits.sum())), weights[v])
    logits = [rows(v, tells).dot(weights[v]) for v in (0, 1)]
    told = y[tells].astype(float)
    scales = [tuple(logistic(z[:, None], told, ridge=0.1)) for z in logits]
    calibrated = np.column_stack([a * z + b for z, (a, b) in zip(logits, scales, strict=True)])
    return Model(tuple(View(weights[v], ratios[v]) for v in (0, 1)), scales, logistic(calibrated, told, ridge=0.1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all documents and some labels."""
    made = written(features(docs, id_col, text_col), "quality-features")
    model = fit_features(made, labels)
    remove(made)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_text, p_meta (calibrated), score (both combined) and keep (1 where score is at least one half)."""
    return score_features(features(docs, id_col, text_col), model, id_col)


def score_features(made: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """As :func:`score`, for features that are made already."""
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_text, p_meta, both = shared.value.predict(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p_text), pa.array(p_meta), pa.array(both), pa.array((both >= 0.5).astype(np.int32))], names=["id", "p_text", "p_meta", "score", "keep"])

    kind = made.schema["id"].dataType.simpleString()
    return made.select("id", "text", "meta").mapInArrow(tidy(run), f"id {kind}, p_text double, p_meta double, score double, keep int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of all documents by a model fitted on them and the labels; features are made once."""
    made = written(features(docs, id_col, text_col), "quality-features")
    return score_features(made, fit_features(made, labels), id_col)


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model keeps, unchanged; the texts stay in the JVM but for the features' sake."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([*_views(text, lang, source, n_chars)], names=["text", "meta"])
        return pa.array(shared.value.predict(batch)[2] >= 0.5)

    return docs.where(F.arrow_udf(keep, "boolean")(*_columns(docs, text_col)))
