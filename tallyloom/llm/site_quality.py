"""Quality classifier with hierarchical empirical Bayes over sites and their sections.

A logistic classifier on text statistics gives each document its own evidence. Grouped sums of that evidence
by host, and by host and path, are shrunk: a host's mean toward the global mean, a path's toward its host's,
each by a strength that the spread between groups tells (method of moments; that of paths is the spread
within their hosts). A document's log-odds are its own plus what its path's posterior, without the document
itself, lies above or below the global mean.

Hosts and paths are any two columns, the second nested in the first: of a table with URLs
``url_filter.url_parts`` gives both; where documents carry no URL, a source and its languages stand for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import WordIds, forget, give_back, id_type, materialise, maybe_broadcast, text_batches
from tallyloom.llm.quality_rules import text_statistics

N_FEATURES = 9


def text_vector(text: str | None, ids: WordIds) -> list[float]:
    """Statistics of a whole text; all zero without words."""
    n, chars, symbols, dups, repeats, lines = text_statistics(text, ids)
    if not n:
        return [0.0] * N_FEATURES
    text = text or ""
    words = text.split()
    upper = sum(1 for w in words if len(w) > 2 and w.isupper()) / n
    marks = (text.count("!") + text.count("?")) / chars
    return [
        np.log1p(n) / 5, np.log1p(chars / n), np.log1p(100 * symbols / chars), np.log1p(100 * dups / max(lines, 1)),
        np.log1p(100 * repeats / n), len(set(words)) / n, upper, np.log1p(100 * marks), max(map(len, words)) / 50,
    ]


def _vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            x = pa.array([text_vector(t, ids) for t in batch.column("t").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), x], ["id", "x"])
        ids.clear()
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type(docs, id_col)}, x array<double>")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> tuple:
    """(mean, scale, weights, bias) fitted on at most ``max_rows`` labelled documents, taken by a hash of the id.

    Null ids and labels are left out; an id with several rows is one document, with the largest label. Without
    both classes the weights are zero and the bias is the smoothed rate's.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    chosen = docs.select(id_col).distinct().join(labels, id_col).orderBy(F.xxhash64(F.col(id_col), F.lit(3)), id_col).limit(max_rows)
    chosen = materialise(chosen, "labelled")
    known = F.broadcast(chosen.withColumnRenamed(id_col, "id"))  # max_rows at most
    with text_batches(docs.sparkSession):
        # one row for each id, however often it is repeated
        per = _vectors(docs.join(F.broadcast(chosen.select(id_col)), id_col, "left_semi"), id_col, text_col).groupBy("id").agg(F.min("x").alias("x"))
        got = per.join(known, "id").toArrow().sort_by("id")
    forget(chosen)
    x = np.array([np.asarray(v) for v in got.column("x").to_pylist()], float).reshape(-1, N_FEATURES)
    y = np.array(got.column("y").to_pylist(), float)
    rate = (y.sum() + 1) / (len(y) + 2)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w, b = np.zeros(2 * N_FEATURES), float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) > 1:
        z = _expand((x - mean) / scale)
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
            a = np.column_stack([z, np.ones(len(z))])
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0] * z.shape[1] + [1e-6])
            g = a.T @ (p - y) + np.append(w, 0.0)
            step = np.linalg.solve(h, g)
            w, b = w - step[:-1], b - step[-1]
            if np.abs(step).max() < 1e-8:
                break
    return mean.tolist(), scale.tolist(), w.tolist(), float(b)


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([z, z * z / 4])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _bounded(within: float, between: float, floor: float = 1.0, cap: float = 1e4) -> float:
    """Documents that a prior counts for: the variance within groups over the one between them, within bounds."""
    return float(min(max(within / between if between > 1e-12 else cap, floor), cap))


def strengths(paths: DataFrame, hosts: DataFrame) -> tuple[float, float, float]:
    """(global mean, host strength, path strength) from (host, n, s, q) of paths and of hosts: counts, sums, sums of squares.

    Moments of a nested design: paths are compared within their host only.
    """
    n, s, q, m, means, squares = hosts.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count("*"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum(F.col("n") * F.col("n"))).first()
    if not n:
        return 0.5, 1e4, 1e4
    mean = s / n
    within = max((q - means) / max(n - m, 1), 1e-9)
    k_host = _bounded(within, (means - n * mean * mean - (m - 1) * within) / max(n - squares / n, 1e-9))
    per = paths.groupBy("host").agg(F.count("*").alias("p"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("means"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    count, path_means, spread = per.agg(F.sum("p"), F.sum("means"), F.sum(F.col("squares") / F.col("n"))).first()
    inside = max((q - path_means) / max(n - count, 1), 1e-9)
    between = (path_means - means - (count - m) * inside) / max(n - spread, 1e-9) if count > m else 0.0
    return mean, k_host, _bounded(inside, between)


def site_quality(
    docs: DataFrame, model: tuple, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, weight: float = 1.0
) -> DataFrame:
    """(id, host, path, doc_score, host_posterior, path_posterior, score, kept) for each row of ``docs``.

    Null hosts and paths are groups like others. Null, empty and blank texts have no statistics: their own
    evidence is the classifier's on zeros, and they count in their groups. Rows come back as often as
    given and count as often; documents with equal scores are kept or go alike; no rows give no rows. Only the id,
    the text, the host and the path are read, whatever other columns are named.
    """
    mean, scale, w, b = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            x = np.array([text_vector(t, ids) for t in batch.column("t").to_pylist()], float).reshape(-1, N_FEATURES)
            z = _expand((x - np.array(mean)) / np.array(scale)) @ np.array(w) + b
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -15, 15))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), p], ["id", "host", "path", "p"])
        ids.clear()
        give_back()

    picked = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("t"))
    # rounding makes sums the same in whatever order they are taken
    scored = picked.mapInArrow(run, f"id {id_type(docs, id_col)}, host string, path string, p double").withColumn("p", F.col("p").cast("decimal(10,9)").cast("double"))
    with text_batches(docs.sparkSession):
        scored = materialise(scored, "scores")
    p = F.col("p")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p.cast("decimal(10,9)")).cast("double").alias("s"), F.sum((p * p).cast("decimal(12,11)")).cast("double").alias("q"))
    paths = materialise(paths, "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    base, k_host, k_path = strengths(paths, hosts)
    tops = hosts.select(F.col("host").alias("_h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(maybe_broadcast(tops, hosts.count()), paths["host"].eqNullSafe(tops["_h"])).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "hn", "hs"
    )
    joined = scored.join(maybe_broadcast(both, paths.count()), scored["host"].eqNullSafe(both["_h"]) & scored["path"].eqNullSafe(both["_p"]))
    host_post = (F.col("hs") - p + k_host * base) / (F.col("hn") - 1 + k_host)
    path_post = (F.col("s") - p + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    out = joined.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    odds = _logit(p) + weight * (_logit(F.col("path_posterior")) - _logit(F.lit(base)))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 9))
    return out.select(
        F.col("id").alias(id_col), "host", "path", p.alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept")
    )
