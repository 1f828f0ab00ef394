"""Operator 3, language identification by nearest centroid.

A text is the counts of its letter n-grams (1 to 3 characters, lower case,
every other character a space), hashed to ``DIMENSIONS`` slots, weighted by
TF-IDF and normalised.  Each language has ``clusters`` centroids from a
spherical k-means; a text takes the language of the centroid with the largest
cosine.  It is marked ``rejected`` if its distance from that centroid is
larger than that of nearly all learned texts of the centroid (their 0.999
quantile, times 1.25).

The model is fitted on labelled rows of every language, chosen by a hash of
their id: at most ``per_language`` of each, and fewer where there are many
languages, so that all have about ``most_rows`` together, but not under
``least_rows`` of each; that bound keeps the fit small at any corpus size.
Prediction reads whole texts of all rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and not rejected; null lang values are not learned; with nothing to learn from
every row is ``und``; ties go to the first language in alphabetical order;
repeated rows are predicted each; further columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import byte_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 1 << 12
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    if not _letters:
        made = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                made[c] = ord(low) if len(low) == 1 else c
        _letters.append(made)
    return _letters[0]


def counts(text: np.ndarray) -> np.ndarray | None:
    """Hashed n-gram counts of UTF-8 bytes; None without a letter."""
    if not len(text):
        return None
    points = _letter_table()[np.frombuffer(text.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)]
    if not (points != 32).any():
        return None
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))].astype(np.uint64)
    grams, total = points + np.uint64(7), np.zeros(DIMENSIONS, np.int64)
    for n in range(3):
        if n:
            if len(points) <= n:
                break
            grams = grams[:-1] * np.uint64(0x100000001B3) + points[n:]
        slots = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        total += np.bincount(slots.astype(np.int64), minlength=DIMENSIONS)
    return total


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centroids; the starts are spread rows (each next one
    is the row least like those already taken)."""
    taken = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[taken[0]]
    while len(taken) < min(k, len(x)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[taken[-1]])
    centroids = x[taken]
    for _ in range(rounds):
        of = np.argmax(x @ centroids.T, axis=1)
        made = [x[of == j].mean(axis=0) for j in range(len(centroids)) if (of == j).any()]
        centroids = np.array(made)
        centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids


class Model:
    def __init__(self, samples: list[tuple[str, np.ndarray]], clusters: int):
        """``samples``: (language, n-gram counts)."""
        self.names = sorted({name for name, _ in samples})
        if not samples:
            return
        label = np.array([self.names.index(name) for name, _ in samples])
        x = np.array([c for _, c in samples], dtype=np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
        x = weighted(x, self.idf)
        groups = [clustered(x[label == j], clusters) for j in range(len(self.names))]
        self.centroids = np.concatenate(groups).astype(np.float32)
        self.of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        like = x @ self.centroids.T
        best = like.argmax(axis=1)
        self.furthest = np.array([1.25 * np.quantile(1 - like[best == j, j], 0.999) if (best == j).any() else 0.5
                                  for j in range(len(self.centroids))])

    def predict(self, count: np.ndarray | None) -> tuple[str, float, bool]:
        if count is None or not self.names:
            return "und", 0.0, False
        like = self.centroids @ weighted(count, self.idf)
        best = int(like.argmax())
        return self.names[self.of[best]], float(min(max(like[best], 0), 1)), bool(1 - like[best] > self.furthest[best])


def _counted(batches):
    for batch in batches:
        found = [counts(t) for t in byte_texts(batch.column("text"))]
        keep = [i for i, c in enumerate(found) if c is not None]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(keep, pa.int64())),
             pa.array([found[i].astype("<u4").tobytes() for i in keep], pa.binary())], names=["lang", "counts"])


def fit(labelled: DataFrame, per_language: int = 500, most_rows: int = 32_000, least_rows: int = 8, clusters: int = 4) -> Model:
    """``labelled``: doc_id, text, lang.  At most ``most_rows`` rows, or
    ``least_rows`` a language, reach the driver, 16 KB each at most."""
    keys = labelled.where("lang is not null and text is not null").select("doc_id", "lang")
    languages = max(keys.select("lang").distinct().count(), 1)
    of_each = min(per_language, max(least_rows, most_rows // languages))
    # First within 64 parts of each language, so no task sorts a whole language.
    keys = keys.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        turn = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        keys = keys.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= of_each).drop("turn")
    chosen = keys.select("doc_id")
    rows = (labelled.join(F.broadcast(chosen), "doc_id", "left_semi").where("lang is not null and text is not null")
            .select("text", "lang").mapInArrow(_counted, "lang string, counts binary").collect())
    rows = sorted((r["lang"], bytes(r["counts"])) for r in rows)
    return Model([(lang, np.frombuffer(c, "<u4")) for lang, c in rows], clusters)


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **fitting) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine, 0 to 1) and
    rejected.  Only rows where ``learn_from`` holds are learned from."""
    used = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       learn_from.alias("learn"))
    model = fit(used.where("learn"), **fitting)

    def run(batches):
        for batch in batches:
            found = [model.predict(counts(t)) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return used.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
