"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for other URLs.

DataFrame functions only, training included: the bounded sample's features are binned once, and rows with
equal bins become one row with their counts; each level of each tree is one grouped aggregate, a row for each
node, whose rows are folded into sums of gradients by feature and bin. A fifth of the sample is held out and ends
the training; trees that it does not gain by are not kept. A trained model is an expression of CASE WHENs over
the features. Suffix statistics are block rates of labelled URLs by the host's suffix at several depths, alone or
with the path's first segment, and by the path's own suffix; in training each is taken from the other folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import forget, materialise

FEATURES = (
    "url_chars", "host_chars", "depth", "digit_ratio", "entropy", "n_params", "hyphens",
    "host_labels", "path_chars", "first_chars", "last_chars", "digit_run", "path_params", "host_entropy", "path_entropy", "query_entropy",
    "host_digits", "path_digits", "query_chars", "suffix_rate",
)
#: What a block rate can be taken by; the feature is the name and ``_rate``.
STATISTICS = ("suffix", "domain", "host", "tail", "suffix_section", "domain_section")
#: A suffix's rate counts the overall one as so many URLs more.
SMOOTH = 10


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; all empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    has = F.locate("://", url) > 0
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(after, r"(?s)^[^?#]*\?([^#]*)", 1)
    empty = F.lit("")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(empty), F.when(has, path).otherwise(empty), F.when(has, query).otherwise(empty)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. ``rules``: (allow or block, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def statistic(name: str) -> Column:
    """What URLs are grouped by for a block rate: the host's last label, its last two, the whole host, the path's extension, and
    the first two with the path's first segment."""
    host, path = F.col("host"), F.col("path")
    domain = F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?$", 0)
    section = F.concat(F.lit("/"), F.regexp_extract(path, "^/+([^/]*)", 1))
    keys = {
        "suffix": suffix(host), "domain": domain, "host": host, "tail": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
        "suffix_section": F.concat(suffix(host), section), "domain_section": F.concat(domain, section),
    }
    return keys[name]


def lexical_features(pages: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``suffix`` and the features that need no training."""
    host, path, query = url_parts(F.col(url_col))
    url = F.coalesce(F.col(url_col), F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return pages.withColumns({"host": host, "path": path, "_query": query}).withColumns(
        {
            "suffix": suffix(F.col("host")),
            "url_chars": F.length(url).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
            "entropy": F.round(_entropy(url), 6),
            "n_params": F.when(F.col("_query") == "", 0.0).otherwise(F.size(F.split("_query", "&")).cast("double")),
            "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "path_chars": F.length("path").cast("double"),
            "first_chars": F.length(F.regexp_extract("path", "^/+([^/]*)", 1)).cast("double"),
            "last_chars": F.length(F.regexp_extract("path", "([^/]*)/*$", 1)).cast("double"),
            "digit_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("path", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)).cast("double"),
            "path_params": F.length(F.regexp_replace("path", "[^;=]", "")).cast("double"),
            "host_entropy": F.round(_entropy(F.col("host")), 6),
            "path_entropy": F.round(_entropy(F.col("path")), 6),
            "query_entropy": F.round(_entropy(F.col("_query")), 6),
            "host_digits": F.length(F.regexp_replace("host", "[^0-9]", "")) / F.greatest(F.length("host"), F.lit(1)),
            "path_digits": F.length(F.regexp_replace("path", "[^0-9]", "")) / F.greatest(F.length("path"), F.lit(1)),
            "query_chars": F.length("_query").cast("double"),
        }
    ).drop("_query")


@dataclass
class UrlModel:
    """Trees as nested (feature, threshold, left, right) with log-odds at the leaves."""

    trees: list
    base: float
    rates: DataFrame  # (_kind, _s, _rate): block rates of the labelled URLs, a row for each of these and statistic at most
    held_out_loss: list[float]
    statistics: tuple[str, ...] = ("suffix",)

    def margin(self) -> Column:
        def value(node: object) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, at, left, right = node
            return F.when(F.col(feature) <= at, value(left)).otherwise(value(right))

        return sum((value(t) for t in self.trees), F.lit(self.base))

    def with_rates(self, df: DataFrame) -> DataFrame:
        """What no labelled URL has has no rate: -1."""
        for kind in self.statistics:
            own = self.rates.where(F.col("_kind") == kind).select("_s", "_rate")
            df = df.withColumn("_key", statistic(kind)).join(F.broadcast(own), F.col("_key") == F.col("_s"), "left")
            df = df.withColumn(f"{kind}_rate", F.coalesce("_rate", F.lit(-1.0))).drop("_key", "_s", "_rate")
        return df


def _grown(rows: DataFrame, depth: int, rate: float, edges: dict[str, list[float]], features: list[str]) -> tuple[object, Column]:
    """One tree for ``rows`` (y, n, fit, margin, bins), as nested tuples and as a column of what it adds."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    graded = rows.where("fit").withColumns({"g": F.col("n") * (p - F.col("y")), "h": F.col("n") * p * (1 - p)})
    splits: dict[int, tuple[str, int]] = {}
    leaves: dict[int, float] = {}
    bins = max(len(e) for e in edges.values()) + 1
    # a node's rows, of a bounded sample, are folded feature by feature into sums by bin: no row is made for a feature
    sums = F.expr(
        f"""transform(sequence(0, {len(features) - 1}), f -> aggregate(held, array_repeat(named_struct('g', 0D, 'h', 0D), {bins}),
        (acc, r) -> transform(acc, (v, i) -> if(r.bins[f] = i, named_struct('g', v.g + r.g, 'h', v.h + r.h), v))))"""
    )

    def node_column() -> Column:
        node = F.lit(1)
        for level in range(depth):
            step = F.lit(None).cast("int")
            for k, (f, b) in splits.items():
                if k.bit_length() == level + 1:
                    step = F.when(node == k, F.when(F.col(f) <= b, 2 * k).otherwise(2 * k + 1)).otherwise(step)
            node = F.coalesce(step, node)
        return node

    for level in range(depth):
        at = graded.withColumn("node", node_column()).where(F.col("node") >= 2**level)
        rows_of = at.select("node", F.struct("g", "h", F.array(*features).alias("bins")).alias("r")).groupBy("node").agg(F.array_sort(F.collect_list("r")).alias("held"))
        for k, found in sorted((r["node"], r["s"]) for r in rows_of.select("node", sums.alias("s")).collect()):
            gt, ht = (round(sum(x[v] for x in found[0]), 9) for v in ("g", "h"))
            best = (1e-6, None)
            for f, own in zip(features, found, strict=True):
                gl = hl = 0.0
                for b in range(len(edges[f])):
                    gl, hl = round(gl + own[b]["g"], 9), round(hl + own[b]["h"], 9)
                    gain = gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1)
                    if 0 < hl < ht and gain > best[0] + 1e-9:
                        best = (gain, [f, b, gl, hl, b])
                    elif best[1] and best[1][0] == f and best[1][4] == b - 1 and best[1][2:4] == [gl, hl]:
                        best[1][4] = b  # nothing lies between: the edge will be in the middle
            leaves[k] = round(-rate * gt / (ht + 1), 9)
            if best[1]:
                f, b, gl, hl, until = best[1]
                splits[k] = (f, (b + until + 1) // 2)
                leaves[2 * k], leaves[2 * k + 1] = round(-rate * gl / (hl + 1), 9), round(-rate * (gt - gl) / (ht - hl + 1), 9)
        if not any(k.bit_length() == level + 1 for k in splits):
            break

    def build(k: int) -> object:
        if k not in splits:
            return leaves.get(k, 0.0)
        f, b = splits[k]
        return (f, edges[f][b], build(2 * k), build(2 * k + 1))

    node, gain = node_column(), F.lit(0.0)
    for k in leaves:
        if k not in splits:
            gain = F.when(node == k, leaves[k]).otherwise(gain)
    return build(1), gain


def train_url_model(
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label: str = "label",
    max_rows: int = 20_000,
    trees: int = 12,
    depth: int = 3,
    bins: int = 16,
    rate: float = 0.4,
    statistics: tuple[str, ...] = ("suffix",),
) -> UrlModel:
    """Fit on at most ``max_rows`` labelled URLs (``label`` 1: block), taken by a hash of the id.

    Null labels and URLs are left out. A URL's rates by ``statistics`` (see :data:`STATISTICS`; the suffix among
    them) are in training those of the other four fifths, so no label tells on itself; one fifth goes without, so
    trees learn what to say of URLs whose suffix no labelled URL has. Trees are added while the
    fifth that is held out gains, ``trees`` at most; where none helps it, none is kept. With no rows, or one class alone, the model has no trees and gives that class's smoothed rate. Repeated rows count
    as often as given; URLs of any length are whole; other columns are not read.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(url_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(label).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("id", F.lit(5)), "id", "url").limit(max_rows)
    sample = materialise(lexical_features(rows, "url").withColumn("part", F.pmod(F.xxhash64("url", F.lit(7)), F.lit(5))), "urls")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = (pos + 1) / (n + 2)
    model = UrlModel([], math.log(prior / (1 - prior)), None, [], tuple(statistics))
    parts, whole = [], []
    for kind in statistics:
        counts = sample.groupBy(statistic(kind).alias("_s"), "part").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        known = counts.groupBy("_s").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
        whole.append(known.select(F.lit(kind).alias("_kind"), "_s", F.round((F.col("all_s") + SMOOTH * prior) / (F.col("all_n") + SMOOTH), 6).alias("_rate")))
        others = F.round((F.col("all_s") - F.col("s") + SMOOTH * prior) / (F.col("all_n") - F.col("n") + SMOOTH), 6)
        others = F.when(F.col("part") == 4, -1.0).otherwise(others)
        parts.append((kind, counts.join(known, "_s").select("_s", "part", others.alias(f"{kind}_rate"))))
    model.rates = materialise(reduce(DataFrame.unionByName, whole), "rates")
    if pos == 0 or pos == n:
        forget(sample)
        return model
    for kind, others in parts:  # max_rows at most
        sample = sample.withColumn("_s", statistic(kind)).join(F.broadcast(others), ["_s", "part"]).drop("_s")
    features = [*FEATURES, *(f"{kind}_rate" for kind in statistics if f"{kind}_rate" not in FEATURES)]
    cuts = sample.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10000).alias(f) for f in features)).first()
    edges = {f: sorted(set(cuts[f])) for f in features}
    binned = sample.select("y", (F.col("part") > 0).alias("fit"), *(sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)).alias(f) for f in features))
    binned = binned.groupBy("y", "fit", *features).agg(F.count("*").alias("n")).withColumn("margin", F.lit(model.base))
    binned = materialise(binned.coalesce(1), "urls")
    loss = F.sum(F.when(~F.col("fit"), F.col("n") * (F.log1p(F.exp(F.col("margin"))) - F.col("y") * F.col("margin"))))

    def lost(rows: DataFrame) -> float:
        return round((rows.agg(loss).first()[0] or 0.0), 9)

    model.held_out_loss.append(lost(binned))
    for _ in range(trees):
        tree, gain = _grown(binned, depth, rate, edges, features)
        before, binned = binned, materialise(binned.withColumn("margin", F.col("margin") + gain), "urls")
        forget(before)
        model.trees.append(tree)
        model.held_out_loss.append(lost(binned))
        if len(model.held_out_loss) > 3 and min(model.held_out_loss[-2:]) >= min(model.held_out_loss[:-2]):
            break
    best = model.held_out_loss.index(min(model.held_out_loss))
    model.trees = model.trees[:best]
    forget(binned)
    return model


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, block_score, verdict) for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and decides.
    Other URLs are blocked if the model's score is 0.5 or more. Null URLs and those without ``://`` have an
    empty host and path, so no rule. URLs of any length are whole; equal URLs are judged alike. Repeated rows
    come back as often as given; no rows give no rows. Only the id and the URL are read, so other columns may
    have any name.
    """
    found = model.with_rates(lexical_features(pages.select(F.col(id_col), F.col(url_col)), url_col))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = found.withColumns({"rule": rule, "_by_rule": verdict, "block_score": 1 / (1 + F.exp(-model.margin()))})
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", "block_score", F.coalesce("_by_rule", by_model).alias("verdict"))


def rule_labels(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` that a rule fits, with ``label`` 1 for block and 0 for allow."""
    host, path, _ = url_parts(F.col(url_col))
    parts = pages.withColumns({"_h": host, "_p": path})
    return parts.withColumn("_v", matching_rule(F.col("_h"), F.col("_p"), rules)[1]).where("_v is not null").withColumn("label", (F.col("_v") == "block").cast("int")).drop("_h", "_p", "_v")
