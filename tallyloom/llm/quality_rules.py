"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

The statistics of all documents enter the estimates. Several starts (medians and scaled deviations, all
documents, signs, small subsets by hash) are improved by concentration steps: per group, the half of the
documents with the smallest distance, found by counting in a fixed grid of distance bins, of which the last
counts in part, and their mean and covariance by grouped sums. The start with the smallest determinant goes
on until it settles; then the estimate is reweighted once. Statistics are taken in thousandths, so sums are
whole numbers and the same in whatever order.

Estimates are made for each language and source, each language, and all documents. Each is shrunk toward the
one above it: in a group's mean that counts as ``MEAN_PRIOR`` documents, for sources do differ, in its covariance
as ``PRIOR``. So small groups need no rule of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import WordIds, forget, give_back, materialise, maybe_broadcast, rolling, text_batches

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: Documents that the estimate above a group counts for in its covariance, and in its mean.
PRIOR, MEAN_PRIOR = 50, 1
#: Squared distance beyond which a document is an outlier; the 0.9999 quantile of chi-squared with 5 degrees.
CUTOFF = 25.74
#: Squared distance up to which a document counts when the estimate is reweighted; the 0.975 quantile.
_INNER = 12.833
#: What is one value of each transformed statistic, in thousandths: most texts have no symbols and repeat nothing,
#: so that the half nearest to the centre may not vary at all. A smaller standard deviation counts as this one.
RESOLUTION = (100, 100, 250, 50, 50)
_BINS = 4096
_SUBSETS = 8
_STARTS = 3 + _SUBSETS


def text_statistics(text: str | None, ids: WordIds, window: int = 8) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    space = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = len(text or "") - space
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    runs = rolling(ids.of(words), window)
    if len(runs) > 1:
        _, back, count = np.unique(runs, return_inverse=True, return_counts=True)
        at = np.nonzero(count[back] > 1)[0]
        if len(at):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge)[:n] > 0))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, keep..., statistics, n_lines) of whole texts, all long; null texts count as empty."""
    names = [*STATS, "n_lines"]
    picked = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_t"))
    passed = picked.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = np.array([text_statistics(t, ids) for t in batch.column("_t").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array(rows[:, i]) for i in range(len(names)))], [*passed, *names])
        ids.clear()
        give_back()

    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in passed)
    found = picked.mapInArrow(run, fields + "".join(f", {n} long" for n in names))
    return found.withColumnsRenamed(dict(zip(passed, (id_col, *keep))))


def _transformed() -> list[Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    values = [
        F.log1p(words),
        F.log1p(chars / F.greatest(words, F.lit(1))),
        F.log1p(100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        # shares, as if of ten lines and a hundred words more: a line said twice in a short text is no habit
        F.col("n_dup_lines") / (F.col("n_lines") + 10),
        F.col("n_repeat_words") / (words + 100),
    ]
    return [F.round(1000 * v).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


_X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_SUMS = ["n", *(f"s{i}" for i in range(DIM)), *(f"q{i}{j}" for i, j in _PAIRS)]


def _chi2(x: float, degrees: int) -> float:
    """Distribution function of chi-squared, for an odd number of degrees."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, degrees, 2):
        out -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0.0
    return out


def consistency(share: float) -> float:
    """What the covariance of a normal distribution's central ``share`` is to be multiplied by."""
    if share >= 1:
        return 1.0
    low, high = 1e-9, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, DIM) < share else (low, mid)
    return share / _chi2(low, DIM + 2)


def regular(cov: np.ndarray) -> np.ndarray:
    """``cov`` made regular where it is singular.

    A variance below the statistic's resolution becomes that; where statistics depend on each other, the smallest
    eigenvalues of their correlation are lifted to 0.001. Any other matrix stays as it is.
    """
    cov = cov + np.diag(np.maximum(np.square(np.array(RESOLUTION, float)) - np.diag(cov), 0))
    scale = np.sqrt(np.diag(cov))
    low, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    return cov if low[0] >= 1e-3 else np.outer(scale, scale) * ((axes * np.maximum(low, 1e-3)) @ axes.T)


def _moments(row: dict, prefix: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    n = float(row[prefix + "n"])
    mu = np.array([row[f"{prefix}s{i}"] for i in range(DIM)], float) / n
    cov = np.zeros((DIM, DIM))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = row[f"{prefix}q{i}{j}"] / n - mu[i] * mu[j]
    return n, mu, cov


_FIT = "grp string, start int, mu array<double>, cov array<double>, inv array<double>, logdet double"


def _fit_row(grp: str, start: int, mu: np.ndarray, cov: np.ndarray) -> tuple:
    inv = np.linalg.inv(cov)
    return grp, start, mu.tolist(), [cov[p] for p in _PAIRS], [inv[p] for p in _PAIRS], round(float(np.linalg.slogdet(cov)[1]), 6)


def _each(rows: DataFrame, make, schema: str = _FIT) -> DataFrame:
    """``make`` of each row, a dict; rows are few, one for each group and start."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([made for r in frame.to_dict("records") if (made := make(r)) is not None], columns=names)

    return rows.mapInPandas(run, schema)


def _distance() -> Column:
    """Squared Mahalanobis distance of x under the row's own mu and inv."""
    d = [F.col(f"x{i}") - F.col("mu")[i] for i in range(DIM)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        out = out + d[i] * d[j] * F.col("inv")[k] * (1 if i == j else 2)
    return out


def _sums(x: DataFrame, *keys: str) -> DataFrame:
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS),
    )


def _centres(x: DataFrame) -> DataFrame:
    """(grp, n, spread, mid, dev): variances, medians and scaled absolute deviations, exact, from counts of values."""
    counts = materialise(x.select("grp", F.posexplode(F.array(*_X)).alias("i", "v")).groupBy("grp", "i", "v").agg(F.count("*").alias("c")), "counts")
    over = "over (partition by grp, i order by {0}) as upto"

    def median(of: DataFrame, name: str) -> DataFrame:
        run = of.select("grp", "i", name, F.expr(f"sum(c) {over.format(name)}"), F.expr("sum(c) over (partition by grp, i) as n"))
        return run.where("2 * upto >= n").groupBy("grp", "i").agg(F.min(name).alias(f"m_{name}"))

    mid = median(counts, "v")
    away = counts.join(mid, ["grp", "i"]).select("grp", "i", F.abs(F.col("v") - F.col("m_v")).alias("w"), "c").groupBy("grp", "i", "w").agg(F.sum("c").alias("c"))
    spread = counts.groupBy("grp", "i").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("q"))
    per = spread.join(mid, ["grp", "i"]).join(median(away, "w"), ["grp", "i"])
    row = F.struct("i", (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("spread"), F.col("m_v").cast("double").alias("mid"), (1.4826 * F.col("m_w")).alias("dev"))
    made = per.groupBy("grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("r"))
    out = materialise(made.select("grp", "n", F.col("r.spread").alias("spread"), F.col("r.mid").alias("mid"), F.col("r.dev").alias("dev")), "centres")
    forget(counts)
    return out


def _starts(x: DataFrame, centres: DataFrame, n_groups: int) -> DataFrame:
    """First estimates: 0 medians and deviations, 1 all documents, 2 signs, from 3 on some dozen of them by hash."""
    z = [(F.col(f"x{i}") - F.col("mid")[i]) / F.greatest(F.when(F.col("dev")[i] > 0, F.col("dev")[i]).otherwise(F.sqrt(F.col("spread")[i])), F.lit(1.0)) for i in range(DIM)]
    length = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    sign = [F.round(1000 * v / F.greatest(length, F.lit(1e-9))).cast("long") for v in z]
    kinds = [F.struct(F.lit(1).alias("start"), *_X)]
    for k in range(3, _STARTS):
        chosen = F.pmod(F.xxhash64(F.lit(k), *_X), F.ceil(F.col("n") / 12)) == 0
        kinds.append(F.when(chosen, F.struct(F.lit(k).alias("start"), *_X)))
    kinds.append(F.struct(F.lit(2).alias("start"), *(s.alias(f"x{i}") for i, s in enumerate(sign))))
    rows = x.join(maybe_broadcast(centres, n_groups), "grp").select("grp", F.explode(F.array(*kinds)).alias("r")).where("r is not null").select("grp", "r.*")
    sums = _sums(rows, "grp", "start").join(centres.select("grp", "spread", "mid", "dev"), "grp")

    def make(r: dict) -> tuple:
        spread, mid, dev = (np.array(r[c], float) for c in ("spread", "mid", "dev"))
        _, mu, cov = _moments(r)
        if r["start"] == 2:
            scale = np.where(dev > 0, dev, np.sqrt(np.maximum(spread, 1)))
            mu, cov = mid, cov / 1e6 * np.outer(scale, scale)
        return _fit_row(r["grp"], r["start"], mu, regular(cov))

    def plain(r: dict) -> tuple:
        return _fit_row(r["grp"], 0, np.array(r["mid"], float), regular(np.diag(np.square(np.array(r["dev"], float)))))

    return materialise(_each(sums, make).unionByName(_each(centres, plain)), "mcd")


def _concentrated(x: DataFrame, fit: DataFrame, n_groups: int) -> DataFrame:
    """One concentration step of each group and start: mean and covariance of the half nearest to the last ones."""
    near = x.join(maybe_broadcast(fit.select("grp", "start", "mu", "inv"), n_groups * _STARTS), "grp").withColumn("d2", _distance())
    # bins of equal ratio: what is in a bin is told apart by less than one per cent
    near = near.withColumn("bin", F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor(F.log(F.col("d2") + 1e-6) * 128 + 1800))).cast("int"))
    bins = _sums(near, "grp", "start", "bin")
    over = "over (partition by grp, start order by bin)"
    placed = bins.withColumns({"upto": F.expr(f"sum(n) {over}"), "all": F.expr("sum(n) over (partition by grp, start)")}).withColumn("half", F.expr(f"(all + {DIM + 1}) div 2"))
    full, edge = F.col("upto") <= F.col("half"), (F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") < F.col("half"))
    halves = placed.groupBy("grp", "start").agg(
        F.max("all").alias("all"), F.max("half").alias("half"),
        *(F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0)).alias(f"f{c}") for c in _SUMS), *(F.coalesce(F.sum(F.when(edge, F.col(c))), F.lit(0)).alias(f"e{c}") for c in _SUMS),
    )

    def make(r: dict) -> tuple:
        half = min(r["half"], r["all"])
        part = (half - r["fn"]) / r["en"] if r["en"] else 0.0
        _, mu, cov = _moments({c: r[f"f{c}"] + part * r[f"e{c}"] for c in _SUMS})
        return _fit_row(r["grp"], r["start"], mu, regular(cov * consistency(half / r["all"])))

    return materialise(_each(halves, make), "mcd")


def raw_mcd(x: DataFrame, centres: DataFrame, n_groups: int) -> DataFrame:
    """(grp, start, mu, cov, inv, logdet): of each group the estimate with the smallest determinant that was found."""
    fit = _starts(x, centres, n_groups)
    for step in range(10):
        before, fit = fit, _concentrated(x, fit, n_groups)
        same = fit.join(before.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        forget(before)
        if step == 1:  # only the best start goes on
            best = materialise(fit.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start")).join(fit, ["grp", "start"]), "mcd")
            forget(fit)
            fit = best
        if step >= 2 and (same is None or same <= 1e-4):
            break
    return fit


def mcd(x: DataFrame) -> DataFrame:
    """(grp, n, mu, cov, n_inner): the reweighted estimate of each group of ``x`` (grp, x0 ... x4 in thousandths)."""
    centres = _centres(x)
    n_groups = centres.count()
    fit = raw_mcd(x, centres, n_groups)
    inner = x.join(maybe_broadcast(fit.select("grp", "mu", "inv"), n_groups), "grp").where(_distance() <= _INNER)
    sums = centres.join(_sums(inner, "grp").drop("mu").withColumnRenamed("n", "m"), "grp", "left").join(fit.select("grp", "mu", "cov"), "grp")

    def make(r: dict) -> tuple:
        inner_n = r["m"]
        if pd.isna(inner_n):  # cannot be nearer than the half that made the estimate, but for rounding
            return r["grp"], r["n"], list(r["mu"]), list(r["cov"]), 0
        _, mu, cov = _moments(r | {"n": inner_n})
        cov = regular(cov * consistency(0.975))
        return r["grp"], r["n"], mu.tolist(), [cov[p] for p in _PAIRS], int(inner_n)

    out = materialise(_each(sums, make, "grp string, n long, mu array<double>, cov array<double>, n_inner long"), "mcd")
    forget(fit, centres)
    return out


def robust_outliers(stats: DataFrame, lang: str = "lang", source: str = "source", prior: float = PRIOR) -> DataFrame:
    """``stats`` with ``distance2``, null for documents without words."""
    pair, one = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))), F.to_json(F.struct(F.col(lang).alias("l")))
    x = materialise(stats.select("*", *_transformed(), pair.alias("_pair"), one.alias("_one")), "stats")
    used = x.where("n_words > 0")
    fit = mcd(used.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("1"), "_one"), F.concat(F.lit("2"), "_pair"))).alias("grp"), *_X))

    def named(prefix: str) -> DataFrame:
        return fit.select("grp", *(F.col(c).alias(prefix + c) for c in ("n_inner", "mu", "cov")))

    groups = used.select("_pair", "_one").distinct()
    chain = (
        groups.join(named("c_"), F.col("grp") == F.concat(F.lit("2"), "_pair")).drop("grp")
        .join(named("b_"), F.col("grp") == F.concat(F.lit("1"), "_one")).drop("grp")
        .join(F.broadcast(named("a_").where("grp = 'all'")))  # one row
    )

    def make(r: dict) -> tuple:
        mu, cov = np.array(r["a_mu"], float), np.array(r["a_cov"], float)
        for level in "bc":
            n = r[f"{level}_n_inner"]
            own, own_mean = n / (n + prior), n / (n + MEAN_PRIOR)
            mu, cov = own_mean * np.array(r[f"{level}_mu"]) + (1 - own_mean) * mu, own * np.array(r[f"{level}_cov"]) + (1 - own) * cov
        whole = np.zeros((DIM, DIM))
        for v, (i, j) in zip(cov, _PAIRS):
            whole[i, j] = whole[j, i] = v
        inv = np.linalg.inv(whole)
        return r["_pair"], mu.tolist(), [inv[p] for p in _PAIRS]

    final = materialise(_each(chain.drop("_one"), make, "_pair string, mu array<double>, inv array<double>"), "mcd")
    forget(fit)
    found = x.join(maybe_broadcast(final, final.count()), "_pair", "left").withColumn("distance2", F.round(F.when(F.col("n_words") > 0, _distance()), 6))
    return found.drop("_pair", "_one", "mu", "inv", "grp", *_X)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_words: int = 20,
    repeat_percent: int = 30,
    cutoff: float = CUTOFF,
    prior: float = PRIOR,
) -> DataFrame:
    """(id, lang, source, statistics, n_lines, base_failed, distance2, kept) for each row of ``docs``.

    ``base_failed``: fewer than ``min_words`` words or more than ``repeat_percent`` per cent of them in
    repeated windows. ``kept``: not base_failed and no outlier of its group. Null languages and sources are
    values like others. A group's estimate is shrunk toward its language's, and that toward the one of all
    documents; ``prior`` is the number of documents that these count for in the covariance, so a document alone
    in its group is judged by its distance from the others of its language. Null, empty and blank texts fail the base rules and are in no estimate. Documents at the
    cutoff are kept. Repeated rows come back, and count, as often as given; no rows give no rows. Only the four
    named columns are read, so others may have any name; the four may not be named as a statistic.
    """
    with text_batches(docs.sparkSession):
        stats = materialise(document_statistics(docs, id_col, text_col, (lang, source)), "doc-stats")
    found = robust_outliers(stats, lang, source, prior)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return found.select(
        id_col, lang, source, *STATS, "n_lines", failed.alias("base_failed"), "distance2",
        (~failed & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
