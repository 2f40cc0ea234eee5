import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quality_rules as Q
from tallyloom.llm import site_quality as S
from tallyloom.llm import toxicity as T
from tests.llm.brute import statistics


def toxic_rows(n=600):
    rng = random.Random(1)
    plain, bad = [f"word{i}" for i in range(200)], ["vilest", "grubby", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        if toxic or rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return rows, labels


def test_nnpu_finds_toxic_texts_held_out(spark):
    rows, labels = toxic_rows()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = ~T.held_out()
    model = T.train_toxicity(docs.where(train), lab.where(train), prior=0.15)
    got = T.score_toxicity(docs, model).join(lab, "doc_id").where(T.held_out()).collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_nnpu_risk_stays_usable_when_everything_unlabelled_is_positive():
    p = [np.array([1, 2], np.int32)] * 50
    model = T.fit_nnpu(p, p, prior=0.5)
    assert np.isfinite(model.bias)


def test_score_edges(spark):
    model = T.fit_nnpu([], [], prior=0.2)
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (None, "x " * 100_000, 3.0), (2, "", 3.0)], "doc_id long, text string, score double")
    got = T.score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert [(round(r.score, 6), r.predicted) for r in got.collect()] == [(0.2, 0)] * 4
    assert T.score_toxicity(docs.limit(0), model).count() == 0
    empty = T.train_toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.weights.any()
    clash = spark.createDataFrame([(1, "fine", "s")], "doc_id long, text string, predicted string")
    assert T.drop_toxic(clash, spark.createDataFrame([], "doc_id long, toxic int")).columns == clash.columns


def quality_docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        n = int(rng.lognormvariate(5, 0.5)) + 20
        rows.append((i, " ".join(rng.choice(["alpha", "be", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(n)), rng.choice(["en", "de"]), "hot" if i % 3 else "rare"))
    rows += [(1000, "ab### cd$$$ ef%%% " * 40 + " ".join(map(str, range(400))), "en", "hot"), (1001, None, "en", None), (1002, "", None, "hot"), (1003, "a\na\nb c\nb c\n \n \n" + "same eight words in a row are here twice " * 2, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_statistics_equal_brute_force(spark):
    rows, docs = quality_docs(spark)
    got = {r.doc_id: tuple(r[s] for s in Q.STATS) for r in Q.document_statistics(docs).collect()}
    assert got == {i: statistics(t) for i, t, _, _ in rows}


def test_outliers_go_and_plain_texts_stay(spark):
    rows, docs = quality_docs(spark)
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (1001, 1002, 1003))
    assert sum(got[i].kept for i in range(400)) >= 396


def _whole(values):
    out = np.zeros((Q.DIM, Q.DIM))
    for v, (i, j) in zip(values, Q._PAIRS):
        out[i, j] = out[j, i] = v
    return out


def test_small_groups_find_the_smallest_determinant_of_all_halves(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for g in range(4):
        x = rng.normal(0, 1, (13, Q.DIM)) @ np.diag([300, 400, 900, 500, 700]) + 5000
        x[:3] += 9000 * (g + 1)
        groups[f"g{g}"] = np.round(x).astype(int)
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"x{i} long" for i in range(Q.DIM)))
    centres = Q._centres(df)
    for r in centres.collect():
        x = groups[r.grp]
        mid = np.array([sorted(c)[(len(c) - 1) // 2] for c in x.T])
        dev = [sorted(abs(c - m))[(len(c) - 1) // 2] * 1.4826 for c, m in zip(x.T, mid)]
        assert np.allclose(r.mid, mid) and np.allclose(r.dev, dev) and np.allclose(r.spread, x.var(0)) and r.n == len(x)
    fit = {r.grp: r for r in Q.raw_mcd(df, centres, 4).collect()}
    half, gaps = (13 + Q.DIM + 1) // 2, []
    for g, x in groups.items():
        best = min(np.linalg.slogdet(Q.regular(np.cov(x[list(s)].T, bias=True) * Q.consistency(half / 13)))[1] for s in itertools.combinations(range(13), half))
        gaps.append(fit[g].logdet - best)
    # concentration steps end in local minima: the smallest of all 715 halves, or one whose axes are some per cent longer
    assert min(gaps) > -1e-3 and sum(x < 0.1 for x in gaps) >= 3 and max(gaps) < 0.8, gaps
    final = {r.grp: r for r in Q.mcd(df).collect()}
    for g, x in groups.items():
        d = x - np.array(final[g].mu)
        far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(_whole(final[g].cov)), d)
        assert far[:3].min() > 2 * far[3:].max()


def test_large_group_follows_plain_concentration_and_reweighting(spark):
    rng = np.random.default_rng(9)
    mix = rng.normal(0, 1, (Q.DIM, Q.DIM)) * 500
    x = np.round(rng.normal(0, 1, (900, Q.DIM)) @ mix + 20_000).astype(int)
    x[:150] += 30_000
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, " + ", ".join(f"x{i} long" for i in range(Q.DIM))).repartition(7)
    got = Q.mcd(df).first()
    mu, inv = np.median(x, 0), np.diag(1 / x.var(0))
    half = (900 + Q.DIM + 1) // 2
    for _ in range(60):
        inner = x[np.argsort(np.einsum("ij,jk,ik->i", x - mu, inv, x - mu))[:half]]
        mu, inv = inner.mean(0), np.linalg.inv(np.cov(inner.T, bias=True) * Q.consistency(half / 900))
    inner = x[np.einsum("ij,jk,ik->i", x - mu, inv, x - mu) <= Q._INNER]
    want = np.cov(inner.T, bias=True) * Q.consistency(0.975)
    assert abs(got.n_inner - len(inner)) <= 5 and np.allclose(got.mu, inner.mean(0), rtol=0.01)
    assert np.abs(_whole(got.cov) / want - 1).max() < 0.1


def test_consistency_is_that_of_a_normal_sample():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, (400_000, Q.DIM))
    order = np.argsort((z * z).sum(1))
    for share in (0.5, 0.75, 0.975):
        assert abs(z[order[: int(share * len(z))]].var(0).mean() * Q.consistency(share) - 1) < 0.02


def test_groups_are_judged_by_themselves_and_see_repeats(spark):
    """Long texts are usual in one source and outliers in another; so is one that says a line again and again."""
    rng = random.Random(5)

    def text(n):
        return "\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(8)) for _ in range(n))

    rows = [(i, text(rng.randint(8, 14)), "en", "notes") for i in range(80)] + [(100 + i, text(rng.randint(500, 700)), "en", "books") for i in range(80)]
    often = "\n".join(x + "\nthank you" for x in text(60).split("\n"))
    rows += [(900, text(600), "en", "notes"), (901, text(600), "en", "books"), (902, often, "en", "books")]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900].kept and got[901].kept and sum(got[i].kept for i in range(80)) >= 78
    assert not got[902].kept and not got[902].base_failed and got[902].n_dup_lines == 59


def test_partitioning_does_not_change_distances(spark):
    _, docs = quality_docs(spark)
    a, b = ({r.doc_id: r.distance2 for r in Q.quality_rules(docs.repartition(n)).collect()} for n in (2, 7))
    assert a == b


def test_quality_rules_small_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 5, None, None), (2, " ".join(map(str, range(30))), "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept, r.distance2) for r in Q.quality_rules(docs).collect()}
    assert got == {1: (True, False, 0.0), 2: (False, True, 0.0)} or all(v[2] is not None for v in got.values())
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_site_posteriors_shrink_and_separate(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        good = (i % 10 != 0) if i % 2 else (i % 10 != 4)
        w = [f"w{rng.randrange(900)}" for _ in range(60)] if good else ["BUY!!"] * 60
        rows.append((i, " ".join(w), f"host{i % 7}", "p" if i % 2 else None))
        labels.append((i, int(good)))
    rows.append((999, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = S.train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in S.site_quality(docs, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 501
    assert np.mean([got[i].kept == bool(y) for i, y in labels]) > 0.98
    assert S.site_quality(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_site_posteriors_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "x " * rng.randint(1, 90), f"h{rng.randrange(4)}", rng.choice(["a", "b", None])) for i in range(70)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string, lang string").withColumn("p", F.lit("clash")).withColumn("host", F.lit(1))
    model = ([0.0] * S.N_FEATURES, [1.0] * S.N_FEATURES, [1.3] + [0.0] * (2 * S.N_FEATURES - 1), -0.9)
    got = sorted(S.site_quality(docs, model, F.col("source"), F.col("lang")).collect(), key=lambda r: r.doc_id)
    rows = sorted(rows + rows[:3])
    p = [round(float(1 / (1 + np.exp(-(1.3 * np.log1p(len(t.split())) / 5 - 0.9)))), 9) for _, t, _, _ in rows]
    by_host, by_path = {}, {}
    for (_, _, h, l), x in zip(rows, p):
        by_host.setdefault(h, []).append(x)
        by_path.setdefault((h, l), []).append(x)
    n, mean = len(p), sum(p) / len(p)

    def ss(groups):
        return sum(sum(g) ** 2 / len(g) for g in groups)

    def bound(within, between):
        return min(max(within / between if between > 1e-12 else 1e4, 1.0), 1e4)

    q = sum(round(x * x, 11) for x in p)
    hosts, paths = list(by_host.values()), list(by_path.values())
    w = (q - ss(hosts)) / (n - len(hosts))
    k_host = bound(w, (ss(hosts) - n * mean**2 - (len(hosts) - 1) * w) / (n - sum(len(g) ** 2 for g in hosts) / n))
    w = (q - ss(paths)) / (n - len(paths))
    inside = sum(sum(len(g) ** 2 for k, g in by_path.items() if k[0] == h) / len(own) for h, own in by_host.items())
    k_path = bound(w, (ss(paths) - ss(hosts) - (len(paths) - len(hosts)) * w) / (n - inside))
    for r, (i, _, h, l), x in zip(got, rows, p):
        host = (sum(by_host[h]) - x + k_host * mean) / (len(by_host[h]) - 1 + k_host)
        path = (sum(by_path[h, l]) - x + k_path * host) / (len(by_path[h, l]) - 1 + k_path)
        odds = [np.log(v / (1 - v)) for v in (x, path, mean)]
        score = 1 / (1 + np.exp(-(odds[0] + odds[1] - odds[2])))
        assert r.doc_id == i and abs(r.host_posterior - host) < 1e-7 and abs(r.path_posterior - path) < 1e-7 and abs(r.score - score) < 1e-7


def test_path_strength_leaves_out_what_hosts_differ_in(spark):
    """Hosts far apart, paths of a host alike: paths are shrunk fully toward their host."""
    rows = [(h, p, 50.0, 50 * m, 50 * m * m + 1.0) for h, m in (("a", 0.2), ("b", 0.8)) for p in "xyz"]
    paths = spark.createDataFrame(rows, "host string, path string, n double, s double, q double")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, k_host, k_path = S.strengths(paths, hosts)
    assert abs(mean - 0.5) < 1e-9 and k_host == 1.0 and k_path == 1e4


def test_one_id_repeated_brings_one_text_to_the_driver(spark):
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some rotten text").alias("text")).unionByName(spark.createDataFrame([(1, "plain words")], "doc_id long, text string"))
    ids = spark.createDataFrame([(7,), (1,)], "doc_id long")
    assert len(T._collect_features(docs, ids, "doc_id", "text")) == 2
    named = docs.selectExpr("concat('n', doc_id) as doc_id", "text")
    lab = spark.createDataFrame([("n7", 1, 0), ("n1", 0, 1)], "doc_id string, toxic int, quality int")
    T.score_toxicity(named.limit(3), T.train_toxicity(named, lab)).collect()
    mean, *_ = S.train_quality(named, lab)
    assert len(mean) == S.N_FEATURES


def test_nnpu_risk_and_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    xp, xu = (rng.random((9, 6)) < 0.4).astype(float), (rng.random((30, 6)) < 0.4).astype(float)
    w, b, prior, decay = rng.normal(0, 0.5, 6), 0.1, 0.3, 1e-2

    def soft(z):
        return np.logaddexp(0, z)

    def parts(v):
        fp, fu = xp @ v[:-1] + v[-1], xu @ v[:-1] + v[-1]
        return prior * soft(-fp).mean(), soft(fu).mean() - prior * soft(fp).mean()

    for shift in (0.0, -6.0):  # far below, the negative part of the risk falls under zero
        v = np.append(w, b + shift)
        positive, negative = parts(v)
        grad, bracket = T.risk_gradient(xp, xu, v[:-1], v[-1], prior, decay=decay)
        assert abs(bracket - negative) < 1e-9

        def risk(v):
            a, c = parts(v)
            return (a + c if negative >= 0 else -c) + decay * (v[:-1] @ v[:-1]) / 2

        for i in range(7):
            e = np.zeros(7)
            e[i] = 1e-5
            assert abs((risk(v + e) - risk(v - e)) / 2e-5 - grad[i]) < 1e-6


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(6)
    for share in (0.05, 0.3):
        p = rng.normal(4, 1, 1500)
        u = np.concatenate([rng.normal(4, 1, int(3000 * share)), rng.normal(0, 1, int(3000 * (1 - share)))])
        assert abs(T.estimate_prior(p, u) - share) < 0.03
