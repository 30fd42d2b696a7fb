"""Open-set few-shot classifiers behind one protocol, chosen by name.

``classifier(name, ...).fit(support)`` gives a fitted classifier; ``predict``
scores query rows and returns ``pred``, ``conf``, ``close_max`` (the best
accepted class) and ``ood`` (the rejected mass), like ``prototypes.predict``.
``tables`` holds what has to be stored to build it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import prototypes as P


class Fitted(Protocol):
    tables: dict[str, DataFrame]

    def predict(self, queries: DataFrame, vec: str, keep: list[str]) -> DataFrame: ...


class Classifier(Protocol):
    def fit(self, support: DataFrame, cls: str, vec: str, row_id: str) -> Fitted: ...


@dataclass(frozen=True)
class NearestMean:
    """Softmax over the similarity to every class mean; the classes in ``reject`` are the unknown ones."""

    dim: int
    n_way: int
    reject: tuple[int, ...] = ()
    method: str = "euclidean"
    options: dict = field(default_factory=dict)

    def fit(self, support: DataFrame, cls: str, vec: str, row_id: str) -> FittedMeans:
        means = P.class_means(support.select(F.col(cls).alias("class"), F.col(vec).alias("z")), ["class"], "z", self.dim)
        return FittedMeans(self, {"prototypes": means})


@dataclass(frozen=True)
class FittedMeans:
    model: NearestMean
    tables: dict[str, DataFrame]

    def predict(self, queries: DataFrame, vec: str, keep: list[str]) -> DataFrame:
        m = self.model
        return P.predict(queries, self.tables["prototypes"], "class", vec, m.dim, m.n_way, keep, list(m.reject), m.method, **m.options)


def distances(kind: str, z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, classes): squared euclidean, one less the cosine, or the sum of both."""
    if kind == "euclidean":
        return -P.score_matrix("euclidean", z, p)
    if kind == "cosine":
        return 1.0 - P.score_matrix("cosine", z, p)
    if kind == "combined":
        return distances("euclidean", z, p) + distances("cosine", z, p)
    raise ValueError(f"unknown distance {kind!r}")


@dataclass(frozen=True)
class OpenMax:
    """Class means with a Weibull model of the ``tail`` largest distances of each known class.

    A class whose distance looks unlikely under its tail gives score away to the class ``unknown``. The classes in
    ``reject`` are left out of the fit. ``distance`` is euclidean, cosine or combined.
    """

    dim: int
    n_way: int
    reject: tuple[int, ...] = ()
    distance: str = "euclidean"
    tail: int = 5
    unknown: int = -1

    def fit(self, support: DataFrame, cls: str, vec: str, row_id: str) -> FittedOpenMax:
        rows = support.select(F.col(cls).alias("class"), F.col(vec).alias("z"), F.col(row_id).alias("row_id"))
        rows = rows.filter(~F.col("class").isin(*self.reject)) if self.reject else rows
        means = P.class_means(rows, ["class"], "z", self.dim)
        far = P.tail_distances(rows, means, "class", "z", "row_id", self.tail, self.distance)
        # one row per class
        fitted = means.join(P.openmax_fit(far, "class"), "class")
        return FittedOpenMax(self, {"prototypes": fitted})


@dataclass(frozen=True)
class FittedOpenMax:
    model: OpenMax
    tables: dict[str, DataFrame]

    def predict(self, queries: DataFrame, vec: str, keep: list[str]) -> DataFrame:
        m = self.model
        (shape, scale, shift), classes, matrix = P.fetch_model(self.tables["prototypes"], ["shape", "scale", "shift"], "class", m.dim, m.n_way)
        names = np.append(classes.to_numpy(zero_copy_only=False), m.unknown)

        def score(z: np.ndarray) -> np.ndarray:
            d = distances(m.distance, z, matrix)
            moved = np.maximum(d + 1.0 - shift, 0.0)
            kept = d * (1.0 - np.exp(-((moved / scale) ** shape)))
            return np.concatenate((-kept, -(d - kept).sum(axis=1, keepdims=True)), axis=1)

        return _decided(queries, vec, keep, m.dim, names, [m.unknown], score)


@dataclass(frozen=True)
class DummyPrototypes:
    """Known classes by their distance, the unknown one by its nearest rejected prototype, each with a temperature."""

    dim: int
    n_way: int
    reject: tuple[int, ...]
    t_known: float = 1.0
    t_unknown: float = 3.0
    unknown: int = -1

    def fit(self, support: DataFrame, cls: str, vec: str, row_id: str) -> FittedDummies:
        means = P.class_means(support.select(F.col(cls).alias("class"), F.col(vec).alias("z")), ["class"], "z", self.dim)
        return FittedDummies(self, {"prototypes": means})


@dataclass(frozen=True)
class FittedDummies:
    model: DummyPrototypes
    tables: dict[str, DataFrame]

    def predict(self, queries: DataFrame, vec: str, keep: list[str]) -> DataFrame:
        m = self.model
        _, classes, matrix = P.fetch_model(self.tables["prototypes"], [], "class", m.dim, m.n_way)
        classes = classes.to_numpy(zero_copy_only=False)
        far = np.isin(classes, m.reject)
        if not far.any():
            raise ValueError("none of the rejected classes is in the support")
        names = np.append(classes[~far], m.unknown)

        def score(z: np.ndarray) -> np.ndarray:
            d = distances("euclidean", z, matrix)
            return np.concatenate((-d[:, ~far] / m.t_known, -d[:, far].min(axis=1, keepdims=True) / m.t_unknown), axis=1)

        return _decided(queries, vec, keep, m.dim, names, [m.unknown], score)


def _decided(
    queries: DataFrame, vec: str, keep: list[str], dim: int, classes: np.ndarray, reject: list[int], score: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi in P.row_chunks(batch.num_rows, len(classes)):
                part = batch.slice(lo, hi - lo)
                out = P.decide(score(P.vectors_of(part, vec, dim)), classes, reject)
                yield pa.RecordBatch.from_arrays([*P.kept_columns(part, keep), *(pa.array(x) for x in out)], [*keep, *P.PREDICTION_NAMES])

    return queries.select(*keep, vec).mapInArrow(run, P.schema_of(queries, keep, P.PREDICTION))


#: The classifiers by name.
CLASSIFIERS: dict[str, type] = {"ncm": NearestMean, "ncm_openmax": OpenMax, "dproto": DummyPrototypes}


def classifier(name: str, **options) -> Classifier:
    if name not in CLASSIFIERS:
        raise ValueError(f"classifier {name!r} is none of {', '.join(CLASSIFIERS)}")
    return CLASSIFIERS[name](**options)
