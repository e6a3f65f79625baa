"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text give the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss and an estimated class prior; where the second term would turn negative its gradient is
reversed, as the non-negative estimator asks. The margin is then calibrated to a probability on labelled rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents

#: Bound of the unlabelled sample, and apart from it of the trusted positives and of the rows for the calibration;
#: rows are chosen by a hash of the id.
MAX_TRAIN_ROWS = 30_000
_CLASSES = 10
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"", b"!?")):
    _CLASS[list(_chars)] = _k
_CLASS[128:192], _CLASS[192:] = 8, 9
_ADDED = 8
DIMENSIONS = _CLASSES + _CLASSES**2 + _ADDED


def features(text: str) -> np.ndarray:
    """Shares of character classes and their pairs, and measures of repetition, of a whole text."""
    out = np.zeros(DIMENSIONS, np.float32)
    kinds = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if not len(kinds):
        return out
    out[:_CLASSES] = np.bincount(kinds, minlength=_CLASSES) / len(kinds)
    if len(kinds) > 1:
        out[_CLASSES : _CLASSES + _CLASSES**2] = np.bincount(kinds[:-1] * np.uint8(_CLASSES) + kinds[1:], minlength=_CLASSES**2) / (len(kinds) - 1)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    distinct = len(set(words))
    out[-_ADDED:] = (
        distinct / n,
        distinct / n**0.75,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        min(1.0, len(kinds) / n / 20),
        1 - len(set(lines)) / len(lines),
        np.log1p(n) / 12,
        np.log1p(len(lines)) / 12,
    )
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=-1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    prior: float  # estimated without negatives; the fit uses this one
    labelled_share: float  # positives among the labelled rows, for comparison

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.offset)


def discriminator(one: np.ndarray, other: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (bias last) of a logistic regression that tells `one` from `other`, by Newton steps."""
    x = np.concatenate([one, other])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(one)), np.zeros(len(other))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01, few: int = 20) -> float:
    """The share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    A discriminator of the two is learned on one half of each. On the other half, above any threshold, the share of
    unlabelled rows over that of positives is at least the prior, and comes down to it where hardly a negative scores
    so high. The threshold with the least upper confidence bound of that ratio is taken. A half stands in for `few` more
    positives, so a handful of them says little; with fewer than two rows on either side it is a half. Held off 0 and 1.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    w = discriminator(positive[::2], unlabelled[::2])
    p, u = (np.sort(x[1::2] @ w[:-1] + w[-1]) for x in (positive, unlabelled))
    above_p = 1 - np.searchsorted(p, p) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    doubt = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    best = int(np.argmin((above_u + (1 + gamma) * doubt) / above_p))
    ratio = (len(p) * above_u[best] / above_p[best] + few * 0.5) / (len(p) + few)
    return float(np.clip(ratio, 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk by Adam over standardised rows."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    one = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u, p = one(unlabelled[order[at : at + batch]]), one(positive[rng.integers(0, len(positive), batch)])
            gu, gp = u @ w, p @ w
            # loss(+) = log(1 + e^-g), loss(-) = log(1 + e^g)
            up, pos_minus = (_sigmoid(gu) @ u) / len(u), (_sigmoid(gp) @ p) / len(p)
            negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
            grad = up - prior * pos_minus
            grad = prior * (-(_sigmoid(-gp)) @ p) / len(p) + grad if negative >= 0 else -grad
            grad[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margin to label, by Newton steps with a small ridge."""
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (p - label) + 1e-3 * (w - [1, 0]))
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS, id_col: str = ID, text_col: str = TEXT, label_col: str = "quality") -> QualityModel | None:
    """Fits on the usable rows of docs; None, with a warning, where they hold no positive row: there is nothing to learn.

    A sample of at most about max_rows texts, drawn by a hash of the id, is the unlabelled set. The trusted positives
    are drawn from all rows of label 1, and the rows for the calibration from all labelled rows, each up to about
    max_rows, however few of the documents are labelled. The class prior is estimated from the positives and the
    unlabelled sample; negatives only serve the calibration, which is skipped without any. Only feature vectors reach
    the driver. A document labelled more than once counts as its lowest label.
    """
    rows = documents(docs, id_col, text_col).where(usable)
    known = labels.select(labels[ID].alias("_id"), labels[label_col].cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label")).where("_label >= 0")
    counted = rows.select(ID).join(known, F.col(ID) == F.col("_id"), "left").agg(F.count("*").alias("n"), F.count("_label").alias("labelled"), F.count_if(F.col("_label") == 1).alias("positive")).first()
    below, below_labelled, below_positive = (int((1 << 40) * min(1.0, max_rows / max(1, counted[c]))) for c in ("n", "labelled", "positive"))
    draw = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 40))
    few = known.where((draw(F.col("_id")) <= below_labelled) | ((F.col("_label") == 1) & (draw(F.col("_id")) <= below_positive))).join(rows.select(F.col(ID).alias("_id")), "_id", "left_semi")
    flags = (draw(F.col(ID)) <= below).cast("int") + F.when(F.col("_id").isNotNull() & (draw(F.col(ID)) <= below_labelled), 2).otherwise(0)
    taken = rows.join(F.broadcast(few), F.col(ID) == F.col("_id"), "left").withColumn("flags", flags).where((F.col("flags") > 0) | F.col("_id").isNotNull()).select(F.coalesce("_label", F.lit(-1)).alias("label"), TEXT, "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(x).tobytes() for x in part.column(1).to_pylist()], pa.binary()), part.column(2)], ["label", "x", "flags"])

    got = taken.mapInArrow(run, "label int, x binary, flags int").toArrow()
    if not counted["positive"]:
        warnings.warn("no usable document has label 1, so nothing can be learned and all scores are 0.5", stacklevel=2)
        return None
    label, flag = got["label"].to_numpy(), got["flags"].to_numpy()
    raw = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    order = np.lexsort([*raw.T[:8], flag, label])  # the same model whatever the order of the rows
    label, flag, raw = label[order], flag[order], raw[order]
    sample = flag % 2 == 1 if np.any(flag % 2 == 1) else np.ones(len(flag), bool)
    x = _expand(raw[sample]).astype(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    standard = lambda x: np.clip((x - mean) / scale, -8, 8)
    positive = standard(_expand(raw[label == 1]).astype(np.float64))
    prior, share = estimate_prior(_shuffled(positive), _shuffled(standard(x))), counted["positive"] / max(1, counted["labelled"])
    w = fit_nnpu(positive, standard(x), prior)
    model = QualityModel(mean, scale, w, 1.0, 0.0, prior, share)
    known_rows = flag >= 2
    slope, offset = calibrate(model.margin(raw[known_rows]), (label[known_rows] == 1).astype(float)) if np.any(label[known_rows] == 0) else (1.0, 0.0)
    return QualityModel(mean, scale, w, slope, offset, prior, share)


def _shuffled(x: np.ndarray) -> np.ndarray:
    return x[np.random.default_rng(1).permutation(len(x))]


def score(df: DataFrame, model: QualityModel | None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, score) for every whole text; null texts count as empty. Without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.stack([features(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5), pa.float64())], ["doc_id", "score"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, score double")
