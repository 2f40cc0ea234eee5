import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rounding as R
from tallyloom.functions import text as T

CASES = [
    (T.norm_text, "a b​ \t c\r\n\n\n\nd ", "a b c\n\nd"),
    (T.norm_text, '["4 - Mostly ready"]', "4 - Mostly ready"),
    (T.norm_text, None, ""),
    (T.norm_key, " “A” – Mostly  Ready. ", "“a” - mostly ready"),
    (T.normalize, "  A  B\n c ", "a b c"),
    (T.slugify, "--Big  Co., Ltd!", "big_co_ltd"),
    (T.registrable_domain, "https://user@www.BBC.co.uk:80/x?y", "bbc.co.uk"),
    (T.registrable_domain, "www.emissionsfi", "www.emissionsfi"),
    (T.registrable_domain, "http://127.0.0.1/x", ""),
    (T.registrable_domain, "nodots", ""),
    (lambda c: T.registrable_domain(c, strict=True), "www.emissionsfi", ""),
    (lambda c: T.registrable_domain(c, strict=True), "http://www.example.org.", "example.org"),
    (T.is_gibberish, "asdf", True),
    (T.is_gibberish, "aaaa", True),
    (T.is_gibberish, "a perfectly ordinary answer", False),
    (T.is_gibberish, "xkcd", True),
    (T.has_keyboard_run, "sds", True),
    (T.is_placeholder, " N/A. ", True),
    (T.is_placeholder, "Acme", False),
    (T.is_substantive, "We support this change entirely", True),
    (T.is_substantive, "no no no no no no no no no", False),
    (T.word_count, "  a b c ", 3),
    (T.int_or_zero, " 12 ", 12),
    (T.int_or_zero, "abc", 0),
    (T.parse_year, "2027", 2027),
    (T.parse_year, "27", None),
    (T.quote_cut, "word " * 200, ("word " * 120).strip()),
    (lambda c: T.truncate(c, 8), "abc  def ghi", "abc def…"),
    (lambda c: T.between_markers(c, "<a>", "<b>"), "x<a>mid<b>y<b>", "<a>mid<b>"),
    (lambda c: T.join_ids(T.split_ids(c)), "10|9|2", "2|9|10"),
    (lambda c: F.array_join(T.question_references(c, F.lit(4)), ","), "see questions 5-7, Q. 12, question 4 and question 200", "5,6,7,12"),
    (lambda c: F.array_join(T.question_references(c, F.lit(4)), ","), "question 10 and 50", "10,50"),
    (lambda c: F.array_join(T.signals(c), ","), "Smith et al. (2020) www.x.org/a.pdf, peer-review", "url,etal,peer_review,pdf,paren_year"),
    (T.entity_key, "The Électricité de France (EDF) S.A. Ltd", "electricite de france s a"),
    (T.is_not_applicable, " N/A ", True),
    (T.humanise, "policy_lever", "Policy lever"),
    (T.short_label, "Other (please specify)", "Other"),
    (lambda c: T.iso_date_in(c).cast("string"), "export 2025.03.09 final.xlsx", "2025-03-09"),
    (lambda c: T.first_match(c, [("hard", "STUDY"), ("soft", "feel")], "none"), "a study we feel", "hard"),
    (lambda c: T.classify_domain(c, {"x.org": "ngo"}, [(".gov.uk", "government"), (".org", "nonprofit")]), "y.org", "nonprofit"),
    (lambda c: T.role_at_start(F.lit(30), c, F.lit(False))["role"], "Please provide comments on this", "comment"),
    (lambda c: T.role_at_start(F.lit(30), c, F.lit(False))["parent"], 'If you answered "No" to question 29, say why', 29),
    (lambda c: T.role_anywhere(F.lit(30), c, F.lit(True), F.lit(False)), "30. Reasons for support", "reasons_support"),
    (lambda c: T.role_anywhere(F.lit(30), c, F.lit(False), F.lit(True)), "30. Reasons for support", "comment"),
    (lambda c: T.role_anywhere(F.lit(5), c, F.lit(False), F.lit(True)), "5. Name", "profile"),
    (lambda c: T.question_header(c)["question_id"], "26.1. Regulatory test", "Q026_1"),
    (lambda c: T.question_header(c)["wording"], "71.On a scale", "On a scale"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_text_function(spark, i):
    f, given, want = CASES[i]
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(f(F.col("x")).alias("y")).first().y == want


def test_verbatim_parts_in_order(spark):
    rows = [("one two", "x one two y", True), ("one […] two", "one and two", True), ("two […] one", "one and two", False), ("a […] a", "a", False)]
    df = spark.createDataFrame(rows, "q string, s string, want boolean")
    assert all(r.got == r.want for r in df.select(T.verbatim_in(F.col("q"), F.col("s")).alias("got"), "want").collect())


def test_rounding(spark):
    one = spark.range(1)
    got = one.select(
        R.r2(F.lit(2.675)).alias("a"), R.pct(F.lit(1), F.lit(0)).alias("b"), R.pct(F.lit(1), F.lit(3)).alias("c"), R.net(F.lit(1), F.lit(2), F.lit(7)).alias("d"),
        R.net_of_counts(F.lit(1), F.lit(2), F.lit(7)).alias("e"), R.whole_or_double(F.lit(3.0)).alias("f"), R.mean_rung(F.array(F.lit(1), F.lit(0), F.lit(1))).alias("g"),
        R.metric(F.array(*map(F.lit, (1, 1, 1, 1, 6))), 5, "net").alias("h"),
    ).first()
    assert tuple(got) == (2.68, None, 33.3, -14.3, -14.3, "3", 2.0, 50.0)
