"""Quality by co-training of a content view and a metadata view.

The content view sees only the text (document statistics and how often
character classes follow each other); the metadata view only the other
columns (language, source, recorded length). Each is a ridge logistic model.
Over rounds, each view labels the unlabelled rows that it is sure of, and the
other view learns from them. Both views are then calibrated on held-back
labelled rows (Platt scaling), and a logistic model of the two calibrated
logits, fitted on the same rows, scores all documents.

The labelled rows that are learned from are a bounded sample (a documented
parameter): those of the smallest hash of the id. The exchange covers all
unlabelled rows, in every round: both views of all documents are written once,
and each Newton step gathers its sums over them in Spark (a matrix for each view
and label), so that the driver holds no unlabelled row. The rows handed on with
one label together weigh as much as the labelled rows of that label, at most.

Nulls and special cases: a null text, or one without a word, scores 0 and is
rejected; null metadata is a value of its own; rows with null or repeated ids
are scored like any other (a row with a null id is unlabelled; of the rows of
one labelled id that of the smallest view teaches); a column ``label``,
``content`` or ``score`` of the documents is ignored; an empty table gives an
empty result; with no labels, or labels of one value only, every text with a
word scores the share of good labels (1 with none) and is judged by that.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.quality_trees import FEATURES, labelled_sample, statistics
from pkgpulse.llm.shared import blocks, written

#: labelled rows at most; one labelled row in FOLD is held back for calibration
LABELLED, FOLD = 12_000, 4
#: rounds of exchange, Newton steps in each; how sure a view must be to hand on a label
ROUNDS, STEPS, SURE = 4, 2, 0.97
#: tasks that add up the sums of the others
ADDERS = 16
THRESHOLD = 0.5
#: hash buckets of a metadata value
BUCKETS = 64

# character classes: letters by case, accented bytes, digits, line break, other white space, single marks, other marks
_CLASS = np.full(256, 9, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x80:], _CLASS[0x30:0x3A] = 0, 1, 2, 3
_CLASS[0x0A] = 4
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_CLASS[0x2E], _CLASS[0x2C], _CLASS[0x21] = 6, 7, 8
N_CLASSES = 10
N_CONTENT = len(FEATURES) + N_CLASSES * N_CLASSES
N_META = 2 * BUCKETS + 2


def content_view(texts: list[str | None]) -> np.ndarray:
    """Document statistics, and shares of pairs of neighbouring character classes."""
    stats = statistics(texts)[list(FEATURES)].to_numpy(float)
    pairs = np.zeros((len(texts), N_CLASSES * N_CLASSES))
    for i, text in enumerate(texts):
        kinds = _CLASS[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        if len(kinds) > 1:
            pairs[i] = np.sqrt(np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES**2) / (len(kinds) - 1))
    return np.hstack([stats, pairs])


def metadata_view(frame: pd.DataFrame) -> np.ndarray:
    """Hashed language and source, recorded length and whether it is missing."""
    out = np.zeros((len(frame), N_META))
    rows = np.arange(len(frame))
    for k, column in enumerate(("lang", "source")):
        bucket = [zlib.crc32(f"{column}={v if isinstance(v, str) else None}".encode()) % BUCKETS for v in frame[column]]
        out[rows, k * BUCKETS + np.array(bucket, np.int64)] = 1
    size = frame["n_chars"].astype(float).to_numpy()
    out[:, -2] = np.log1p(np.maximum(np.nan_to_num(size), 0))
    out[:, -1] = np.isnan(size)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardized columns (Newton's method)."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1
        self.weights = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if np.abs(self.step(*self.sums(x, y))).max() < 1e-8:
                break
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of the rows, at the present weights."""
        z = self._design(x)
        p = _sigmoid(z @ self.weights)
        return (z.T * (p * (1 - p) + 1e-6)) @ z, z.T @ (y - p)

    def step(self, curvature: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """One Newton step by the sums over all rows."""
        penalty = np.full(len(gradient), self.ridge)
        penalty[-1] = 1e-6
        moved = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        self.weights = self.weights + moved
        return moved

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -40, 40)


@dataclass
class Model:
    """Two views, their calibrations and the model that combines them; or, when
    there was nothing to learn, one share."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combiner: Logistic | None
    share: float
    exchanged: int = 0

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.combiner is None:
            return np.full(len(content), self.share)
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (content, meta), strict=True)]
        return _sigmoid(self.combiner.logit(np.stack(logits, axis=1)))


@dataclass
class Round:
    """Who teaches (a calibrated model per view), and who learns at present."""

    teachers: list[Logistic]
    calibrations: list[Logistic]
    students: list[Logistic]
    sure: float

    def sums(self, views: list[np.ndarray]) -> np.ndarray:
        """Of unlabelled rows, per student and label handed on: how many, and
        the sums of a Newton step, as one row of numbers each (padded)."""
        width = max(len(m.weights) for m in self.students)
        out = np.zeros((4, 1 + width * width + width))
        for i, student in enumerate(self.students):
            j = 1 - i
            p = _sigmoid(self.calibrations[j].logit(self.teachers[j].logit(views[j])[:, None]))
            for label, confidence in enumerate((1 - p, p)):
                rows = confidence >= self.sure
                curvature, gradient = student.sums(views[i][rows], float(label))
                n = len(gradient)
                out[2 * i + label, : 1 + n * n + n] = [rows.sum(), *curvature.ravel(), *gradient]
        return out


def cotrain(
    views: list[np.ndarray],
    label: np.ndarray,
    held: np.ndarray,
    gather: Callable[[Round], np.ndarray],
    rounds: int = ROUNDS,
    sure: float = SURE,
) -> Model:
    """Co-train on labelled rows (``held`` marks those kept for calibration),
    one matrix per view, and on unlabelled rows, over all of which ``gather``
    returns ``Round.sums``."""
    share = float(label.mean()) if len(label) else 1.0
    if len(set(label[held])) < 2 or len(set(label[~held])) < 2:
        return Model([], [], None, share)
    taught = label[~held]
    models = [Logistic().fit(x[~held], taught) for x in views]

    def calibrated() -> list[Logistic]:
        return [Logistic(1e-3).fit(m.logit(x[held])[:, None], label[held]) for m, x in zip(models, views, strict=True)]

    exchanged = 0
    for _ in range(rounds):
        now = Round(models, calibrated(), [replace(m) for m in models], sure)
        for _ in range(STEPS):
            found = gather(now)
            for i, student in enumerate(now.students):
                curvature, gradient = student.sums(views[i][~held], taught)
                n = len(gradient)
                for value in (0, 1):
                    row = found[2 * i + value]
                    weight = min(1.0, (taught == value).sum() / max(row[0], 1.0))
                    curvature += weight * row[1 : 1 + n * n].reshape(n, n)
                    gradient += weight * row[1 + n * n : 1 + n * n + n]
                student.step(curvature, gradient)
        exchanged = int(found[:, 0].sum())
        models = now.students
        if not exchanged:
            break
    calibrations = calibrated()
    logits = [c.logit(m.logit(x[held])[:, None]) for m, c, x in zip(models, calibrations, views, strict=True)]
    combiner = Logistic(1e-2).fit(np.stack(logits, axis=1), label[held])
    return Model(models, calibrations, combiner, share, exchanged)


def _columns(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("double").alias("n_chars"),
        *more,
    )


def views(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, key, content, meta) per row: both views, as 32-bit floats;
    ``key`` is a number of the caller's, carried along."""
    key = (F.lit(None) if key is None else key).cast("long")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            content, meta = content_view(frame["text"].tolist()), metadata_view(frame)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64").to_numpy(),
                    "key": frame["key"].astype("Int64").to_numpy(),
                    "content": [x.tobytes() for x in content.astype(np.float32)],
                    "meta": [x.tobytes() for x in meta.astype(np.float32)],
                }
            )

    return _columns(docs, key.alias("key")).mapInPandas(run, "doc_id long, key long, content binary, meta binary")


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    shapes = (("content", N_CONTENT), ("meta", N_META))
    return [np.frombuffer(b"".join(map(bytes, frame[c])), np.float32).reshape(-1, n).astype(float) for c, n in shapes]


def _add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = sum(np.frombuffer(part) for frame in frames for part in frame["part"])
    yield pd.DataFrame({"part": [total.tobytes()]})


def _gather(unlabelled: DataFrame) -> Callable[[Round], np.ndarray]:
    """Sums over all rows: each task adds up its own, ``ADDERS`` tasks theirs."""

    def gather(now: Round) -> np.ndarray:
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1)
            for frame in frames:
                for i in range(0, len(frame), 4096):
                    total = total + now.sums(_matrices(frame.iloc[i : i + 4096]))
            if total.ndim > 1:
                yield pd.DataFrame({"part": [total.tobytes()]})

        parts = unlabelled.select("content", "meta").mapInPandas(run, "part binary")
        parts = parts.withColumn("adder", F.pmod(F.spark_partition_id(), F.lit(ADDERS)))
        parts = parts.groupBy("adder").applyInPandas(_add, "part binary")
        total = now.sums([np.zeros((0, N_CONTENT)), np.zeros((0, N_META))])
        for r in parts.toLocalIterator():  # ADDERS rows at most
            total = total + np.frombuffer(r.part).reshape(total.shape)
        return total

    return gather


def fit_views(seen: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED) -> Model:
    """Co-train on a bounded sample of labelled rows and on all others; ``seen``
    is the written result of ``views``, which every step reads."""
    known = labelled_sample(seen, labels, target, labelled).groupBy("doc_id", "label")
    known = known.agg(F.min(F.struct("content", "meta")).alias("x")).select("doc_id", "label", "x.content", "x.meta")
    found = known.withColumn("label", F.col("label").cast("double")).toPandas()
    found["order"] = [zlib.crc32(str(i).encode()) for i in found["doc_id"]]
    found = found.sort_values(["order", "doc_id", "label"], kind="stable")
    with_label = labels.where(F.col(target).isNotNull()).select("doc_id").distinct()
    unlabelled = written(seen.join(with_label, "doc_id", "left_anti"), "unlabelled")
    held = (found["order"] % FOLD == 0).to_numpy(bool)
    return cotrain(_matrices(found), found["label"].to_numpy(float), held, _gather(unlabelled))


def judge_views(seen: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, kept) per row: the probability of good quality."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content, meta = _matrices(frame)
            score = np.where(content[:, 0] > 0, model.score(content, meta), 0.0)
            ids = frame["doc_id"].astype("Int64").to_numpy()
            yield pd.DataFrame({"doc_id": ids, "score": score, "kept": (score >= threshold) & (content[:, 0] > 0)})

    return seen.select("doc_id", "content", "meta").mapInPandas(run, "doc_id long, score double, kept boolean")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED) -> Model:
    return fit_views(written(views(docs), "views"), labels, target, labelled)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    return judge_views(views(docs), model, threshold)
