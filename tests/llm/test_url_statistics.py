"""Suffix statistics of the URL model: what they are taken by, unseen ones, and trees that do not help."""

import random

from pyspark.sql import functions as F

from tallyloom.llm import url_filter as U


def test_what_rates_are_taken_by(spark):
    urls = [(1, "http://a.B.example.org/en/x.html?q=1"), (2, "http://localhost"), (3, None), (4, "http://x.co/a.tar.gz/")]
    x = U.lexical_features(spark.createDataFrame(urls, "page_id int, url string"), "url")
    got = {r.page_id: tuple(r)[1:] for r in x.select("page_id", *(U.statistic(k).alias(k) for k in U.STATISTICS)).collect()}
    assert got[1] == ("org", "example.org", "a.b.example.org", "html", "org/en", "example.org/en")
    assert got[2] == ("localhost", "localhost", "localhost", "", "localhost/", "localhost/")
    assert got[3] == ("", "", "", "", "/", "/")
    assert got[4] == ("co", "x.co", "x.co", "", "co/a.tar.gz", "x.co/a.tar.gz")


def test_sections_decide_and_unseen_ones_do_not_follow(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        section = rng.choice(["de", "fr", "es"])
        rows.append((i, f"https://{rng.choice('abcdef')}{rng.randrange(99)}.example.com/{section}/{rng.randrange(9999)}", int(section == "de")))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = U.train_url_model(df, trees=4, statistics=U.STATISTICS)
    assert model.held_out_loss[-1] < 0.5 * model.held_out_loss[0] and len(model.trees) <= 4
    new = [(1, "https://zz.example.com/de/5", "block"), (2, "https://zz.example.com/fr/5", "allow"), (3, "https://other.net/it/5", "allow")]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(new, "page_id long, url string, want string"), [], model).collect()}
    assert got == {i: want for i, _, want in new}


def test_no_tree_is_kept_that_the_held_out_fifth_rejects(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(50)}.net/{rng.randrange(10**6)}", int(rng.random() < 0.5)) for i in range(150)]
    model = U.train_url_model(spark.createDataFrame(rows, "page_id long, url string, label int"), trees=3)
    assert len(model.trees) == model.held_out_loss.index(min(model.held_out_loss))
    assert model.rates.where(F.col("_kind") != "suffix").count() == 0
