"""Severity of toxic language by cumulative-link ordinal regression.

P(grade > k) = sigmoid(x.w - theta_k) with ordered thresholds theta and one weight vector
for all of them.  Features are the distinct words of a text and their beginnings, hashed;
a document's score is the sum of its words' weights, so scoring is one lookup for each word.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``); everything else
covers all rows and whole texts.  Null and empty texts hold no words: their severity is
that of an empty text.  Repeated rows are scored one by one.  Without labels of toxic and of
clean documents nothing is found toxic.  Columns other than id and text are not looked at,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import small_batches, tidy

#: Labelled documents that the model is fitted on, at most; hashed features; least documents of a feature.
SAMPLE, FEATURES, LEAST_DOCS = 8_000, 1 << 20, 6
#: A feature enters if its chi-square against "toxic at all" and its log odds ratio are at least so large.
CHI_SQUARE, LOG_ODDS = 20.0, 2.0
#: Lengths of the word beginnings that are features beside the word itself.
HEADS = (4, 5)
_WORD = re.compile(r"\w+")


def _features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    parts = [f"w{word}", *(f"{n}{word[:n]}" for n in HEADS if len(word) >= n)]
    return [xxhash.xxh32_intdigest(p) % FEATURES for p in parts]


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words."""
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Weights of the features that occurred often enough, and thresholds in ascending order."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def weight_of(self, word: str) -> float:
        ids = np.array(_features(word))
        at = np.minimum(np.searchsorted(self.features, ids), len(self.features) - 1)
        return float(self.weights[at][self.features[at] == ids].sum()) if len(self.features) else 0.0

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(score)[:, None] - self.thresholds[None, :], -500, 500)))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(values, 0.0), np.minimum(ptr[:-1], len(values))) * (np.diff(ptr) > 0)


def telling_features(sets: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Which features tell grades above 0 from grade 0 in enough documents; common words that only follow length don't."""
    a, b = np.zeros(FEATURES), np.zeros(FEATURES)
    for features, grade in zip(sets, grades, strict=True):
        (a if grade > 0 else b)[np.unique(features)] += 1
    toxic = grades > 0
    c, d = toxic.sum() - a, (~toxic).sum() - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(len(grades) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    odds = np.abs(np.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
    return (a + b >= LEAST_DOCS) & (chi >= CHI_SQUARE) & (odds >= LOG_ODDS)


def fit(sets: list[np.ndarray], grades: np.ndarray, steps: int = 400, ridge: float = 3e-5) -> Model:
    """Maximum likelihood with a ridge, by gradient steps with adapted lengths (Adam).

    ``sets[i]`` are the features of document i, once for each of its words that has them.
    Thresholds are the first and the logarithms of the gaps, so they stay in order.
    """
    n, top = len(grades), int(grades.max(initial=0))
    top = max(top, 1)
    chosen = telling_features(sets, grades)
    kept, place = np.flatnonzero(chosen), np.cumsum(chosen) - 1
    few = [place[s[chosen[s]]] for s in sets]
    column = np.concatenate([np.zeros(0, np.int64), *few])
    row = np.repeat(np.arange(n), [len(f) for f in few])
    ptr = np.concatenate([[0], np.cumsum([len(f) for f in few], dtype=np.int64)])
    w = np.zeros(len(kept))
    theta = np.concatenate([[1.0], np.zeros(top - 1)])
    params = np.concatenate([w, theta])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, theta = params[: len(kept)], params[len(kept) :]
        gaps = np.exp(theta[1:])
        cuts = theta[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = _sums(w[column], ptr)
        low = np.where(grades > 0, cuts[np.maximum(grades - 1, 0)], -np.inf)
        high = np.where(grades < top, cuts[np.minimum(grades, top - 1)], np.inf)
        sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
        a, b = sig(low - score), sig(high - score)  # P(y <= grade - 1), P(y <= grade)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        d_score = (db - da) / p / n  # of the negative log-likelihood
        d_cuts = np.zeros(top)
        np.add.at(d_cuts, np.minimum(grades, top - 1), np.where(grades < top, -db / p / n, 0.0))
        np.add.at(d_cuts, np.maximum(grades - 1, 0), np.where(grades > 0, da / p / n, 0.0))
        d_w = np.bincount(column, weights=d_score[row], minlength=len(kept)) + ridge * w
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grad = np.concatenate([d_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, theta = params[: len(kept)], params[len(kept) :]
    return Model(kept, w, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def grades_of(labelled: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and severity grades of a bounded sample of labelled documents (text, toxic 0/1).

    Where labels only tell toxic from clean, the grade of a toxic document is the third in
    which its number of telling words lies, from 1 to 3; clean ones are 0.  Telling words are
    those that are found in toxic documents ten times as often as in others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py() or "") for t in batch.column(0)]
            out = [np.array([f for w in ws for f in _features(w)], np.int32).tobytes() for ws in words]
            own = [np.array([xxhash.xxh32_intdigest(f"w{w}") % FEATURES for w in ws], np.int32).tobytes() for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()), pa.array(own, pa.binary())], names=["toxic", "features", "words"])

    held = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(run), "toxic int, features binary, words binary").orderBy(F.xxhash64("features", "words"), "toxic").limit(SAMPLE).toArrow()  # an id may be repeated
    toxic = held["toxic"].to_numpy()
    sets = [np.frombuffer(x, np.int32) for x in held["features"].to_pylist()]
    words = [np.frombuffer(x, np.int32) for x in held["words"].to_pylist()]
    count = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int32), *(np.unique(w) for w, t in zip(words, toxic, strict=True) if t == which)]), minlength=FEATURES)
    inside, outside = count(1), count(0)
    telling = (inside >= LEAST_DOCS) & (inside / max(1, (toxic == 1).sum()) > 10 * (outside + 0.1) / max(1, (toxic == 0).sum()))
    number = np.array([telling[w].sum() for w in words])
    bounds = np.quantile(number[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else np.zeros(2)
    grades = np.where(toxic == 1, 1 + np.searchsorted(bounds, number, "right"), 0)
    return sets, np.minimum(grades, 3)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_above_0 .. (one for each threshold), severity (expected grade), toxic (P(grade > 0) is at least one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEAST_DOCS * features of a bounded sample: bounded
    names = [f"p_above_{k}" for k in range(len(model.thresholds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 400_000:
                    self.clear()
                value = self[word] = own.weight_of(word)
                return value

        weights = Weights()
        for batch in batches:
            scores = [sum(map(weights.__getitem__, words_of(t.as_py() or ""))) for t in batch.column(1)]
            above = own.above(np.array(scores, np.float64))
            columns = [pa.array(above[:, k]) for k in range(above.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(above.sum(1)), pa.array((above[:, 0] >= 0.5).astype(np.int32))], names=["id", *names, "severity", "toxic"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(tidy(run), f"id {kind}, {', '.join(f'{n} double' for n in names)}, severity double, toxic int")
    return out.withColumnRenamed("id", id_col)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled documents and scores every document."""
    small_batches(docs.sparkSession)
    rated = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "toxic")
    # SAMPLE rows at most, so the sample goes to the documents and no text is shuffled; of repeated ids again SAMPLE at most
    known = F.broadcast(rated.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(SAMPLE))
    found = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    return score(docs, fit(*grades_of(found)))
