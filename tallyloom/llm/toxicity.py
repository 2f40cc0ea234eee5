"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over words and word beginnings, trained from confirmed toxic texts (P) and texts
without any regard to a label (U) by the class-prior-corrected risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``; where the bracket falls below zero its gradient is
reversed, so the classifier cannot profit from fitting the unlabelled texts as all negative.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import forget, give_back, id_type, materialise, text_batches

_EDGE = ".,;:!?\"'()[]{}<>*#$%&|_-/\\"
#: Features are hashed into so many buckets.
BUCKETS = 1 << 20
#: Folds of both samples from which the prior is estimated.
FOLDS = 4


@dataclass
class NNPUModel:
    """``weights`` by bucket, zero where unused; the score is the logistic function of bias + sum."""

    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word: the word itself and its first three to six letters."""
    word = word.strip(_EDGE)
    if not word:
        return []
    names = ["w:" + word, *("p:" + word[:k] for k in (3, 4, 5, 6) if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def text_features(text: str | None, cache: dict[str, list[int]]) -> np.ndarray:
    """Distinct buckets of a whole text."""
    out: set[int] = set()
    for w in set((text or "").lower().split()):
        own = cache.get(w)
        if own is None:
            if len(cache) >= 300_000:
                cache.clear()
            own = cache[w] = word_features(w)
        out.update(own)
    return np.fromiter(out, np.int32, len(out))


def _held(rows: list[np.ndarray]) -> np.ndarray:
    """How many texts hold each bucket; a text lists a bucket once."""
    out = np.zeros(BUCKETS, np.int32)
    for r in rows:
        out[r] += 1
    return out


def _dense(rows: list[np.ndarray], place: np.ndarray, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    return x


def risk_gradient(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float, beta: float = 0.0, decay: float = 0.0) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk by weights and bias, and the risk's bracket, with the logistic loss."""
    fp, fu = xp @ w + b, xu @ w + b
    sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
    negative = float(np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp)))
    gp, gu = np.zeros_like(sp), su / len(su)
    if negative >= -beta:
        gp = prior * (sp - 1) / len(sp) - prior * sp / len(sp)
    else:  # only the correction, the other way
        gp, gu = prior * sp / len(sp), -gu
    return np.concatenate([gp @ xp + gu @ xu + decay * w, [gp.sum() + gu.sum()]]), negative


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    features: int = 1024,
    epochs: int = 300,
    rate: float = 0.05,
    decay: float = 3e-4,
    beta: float = 0.0,
) -> NNPUModel:
    """Train on feature lists. Without positives or unlabelled texts the score is the prior everywhere."""
    prior = float(min(max(prior, 1e-4), 0.9))
    weights, bias = np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return NNPUModel(weights, bias)
    held_p, held_u = _held(positive), _held(unlabelled)
    # only what three texts hold is compared: no array of doubles over all buckets
    used = np.nonzero(held_p + held_u >= 3)[0]
    share_p, share_u = held_p[used] / len(positive), held_u[used] / len(unlabelled)
    both = (held_p[used] + held_u[used]) / (len(positive) + len(unlabelled))
    z = (share_p - share_u) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / len(positive) + 1 / len(unlabelled)))
    best = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = used[best[np.abs(z[best]) >= 4]]
    if not len(chosen):
        return NNPUModel(weights, bias)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    xp, xu = _dense(positive, place, len(chosen)), _dense(unlabelled, place, len(chosen))
    w, b = np.zeros(len(chosen), np.float32), np.float32(bias)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        grad, _ = risk_gradient(xp, xu, w, b, prior, beta, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        # smaller and smaller steps, so that reversed gradients near the end do not throw the result about
        move = rate * (1 - (step - 1) / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    weights[chosen] = w
    return NNPUModel(weights, float(b))


def margins(rows: list[np.ndarray], model: NNPUModel) -> np.ndarray:
    return np.array([model.bias + float(model.weights[r].sum()) for r in rows])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from both kinds' scores by a model that did not train on them.

    Above any threshold the unlabelled hold at least that share of what the positives hold; the threshold with the
    smallest ratio, two standard errors included, has fewest negatives above it, and its ratio is the estimate.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p[: max(1, len(p) * 3 // 4)])  # above them a quarter of the positives at least
    over_p, over_u = len(p) - np.searchsorted(p, cuts), len(u) - np.searchsorted(u, cuts)
    ratio = np.maximum(over_u, 1) / len(u) / (over_p / len(p))
    error = 2 * ratio * np.sqrt(1 / np.maximum(over_u, 1) + 1 / over_p)
    return float(ratio[int(np.argmin(ratio + error))])


def labelled_share(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> float | None:
    """The share of 1 among labelled documents: a prior where labels are drawn without regard to class; None without labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    return known.agg(F.avg("y")).first()[0]


def _collect_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """Feature lists of the documents named by the bounded table ``ids``, one for each id however often it is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            f = pa.array([np.sort(text_features(t, cache)) for t in batch.column("t").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), f], ["id", "f"])
        cache.clear()
        give_back()

    picked = docs.join(F.broadcast(ids), id_col, "left_semi").select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    with text_batches(docs.sparkSession):
        per = picked.mapInArrow(run, f"id {id_type(docs, id_col)}, f array<int>").groupBy("id").agg(F.min("f").alias("f"))
        got = per.toArrow().sort_by("id")
    return [np.asarray(x, np.int32) for x in got.column("f").to_numpy()]


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    max_positive: int = 2000,
    max_unlabelled: int = 10_000,
) -> NNPUModel:
    """Fit on at most ``max_positive`` texts labelled 1 and ``max_unlabelled`` texts of any label.

    Both samples go by a hash of the id; an id with several rows is one document. Labels of 0 are not used.
    ``prior`` is the share of toxic texts; if not given, first models trained without one fold each score that fold,
    and these scores tell it (:func:`estimate_prior`). ``docs`` and ``labels`` hold training rows only;
    null ids and labels are left out, null and empty texts have no features. Without texts labelled 1, or no rows
    at all, the score is the prior everywhere. Other columns are not read, whatever their names.
    """
    positive = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(id_col).distinct()

    def sample(ids: DataFrame, seed: int, n: int) -> DataFrame:
        return materialise(ids.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n), "sample")

    known = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    p_ids, u_ids = sample(positive.join(known, id_col), 1, max_positive), sample(known, 2, max_unlabelled)
    p, u = (_collect_features(docs, ids, id_col, text_col) for ids in (p_ids, u_ids))
    forget(p_ids, u_ids)
    if prior is None:
        prior = len(p) / max(1, len(p) + len(u))
        folds = [(p[i::FOLDS], u[i::FOLDS]) for i in range(FOLDS)]
        if all(a and b for a, b in folds):
            scores = []
            for i, own in enumerate(folds):
                first = fit_nnpu(*([x for j, other in enumerate(folds) if j != i for x in other[k]] for k in (0, 1)), prior, epochs=100)
                scores.append([margins(x, first) for x in own])
            prior = estimate_prior(*(np.concatenate([x[k] for x in scores]) for k in (0, 1)))
        del folds
    model = fit_nnpu(p, u, prior)
    del p, u
    give_back()  # the driver runs on
    return model


def score_toxicity(docs: DataFrame, model: NNPUModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Whole texts are read; only the text decides, and only it goes to Python. Null, empty and blank texts get the
    score of a text without features. Repeated rows score alike, no rows give no rows. Input columns named
    ``score`` or ``predicted`` are replaced.
    """
    used = np.nonzero(model.weights)[0]
    table = dict(zip(used.tolist(), model.weights[used].astype(float).tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((table, model.bias))
    base = docs.drop(*(c for c in ("score", "predicted") if c in docs.columns and c not in (id_col, text_col)))

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        cache: dict[str, tuple[int, ...]] = {}
        for texts in series:
            scores = []
            for text in texts:
                seen: set[int] = set()
                for w in set((text or "").lower().split()):
                    own = cache.get(w)
                    if own is None:
                        if len(cache) >= 300_000:
                            cache.clear()
                        own = cache[w] = tuple(x for x in word_features(w) if x in weights)
                    if own:
                        seen.update(own)
                f = bias + sum(weights[x] for x in sorted(seen))
                scores.append(1 / (1 + math.exp(-min(max(f, -30), 30))))
            yield pd.Series(scores, dtype="float64")
        cache.clear()
        give_back()

    return base.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids whose crc32, taken as text, is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: object) -> DataFrame:
    """``docs`` without texts predicted toxic by a model trained on all of ``labels``.

    Null, empty and blank texts are not toxic by themselves: they have the score of a text without features.
    Repeated rows stay or go together, rows with a null id go by their text; no rows give no rows. All columns
    stay as they are, whatever their names.
    """
    model = train_toxicity(docs, labels, id_col, text_col, **settings)
    named = docs.select(F.col(text_col), F.col(id_col).alias("_i"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"))
    scored = score_toxicity(named, model, "_i", text_col).where("predicted = 0")
    return scored.select(*(F.col("_d")[c].alias(c) for c in docs.columns))
