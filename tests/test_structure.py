"""Disclosure, contracts, labels, names and seeds against brute force on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import browser as B
from tallyloom.operators import contract as K
from tallyloom.operators import derive as D
from tallyloom.operators import disclosure as X
from tallyloom.operators import panels as P
from tallyloom.sources import readers


def propagate(cells, terms):
    """{cell: (value, step)} by hand, with the same two rules."""
    known, step, out = dict(cells), 0, {}
    while True:
        step += 1
        found = {}
        for eq in {t[0] for t in terms}:
            own = [(c, s) for e, c, s in terms if e == eq]
            rest = sum(s * known[c] for c, s in own if known[c] is not None)
            hidden = [(c, s) for c, s in own if known[c] is None]
            if len(hidden) == 1:
                found[hidden[0][0]] = -rest * hidden[0][1]
            elif len(hidden) > 1 and rest == 0 and len({s for _, s in hidden}) == 1:
                found |= {c: 0 for c, _ in hidden}
        if not found:
            return out
        known |= found
        out |= {c: (v, step) for c, v in found.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_revealed_cells_are_the_true_ones(spark, seed):
    rng = random.Random(seed)
    counts = [("t", r, c, rng.choice([0, 0, 1, 2, 7])) for r in "abcd" for c in "xyz"]
    hide = {(r, c) for r in [*"abcd", None] for c in [*"xyz", None] if rng.random() < 0.45 and (r or c)}
    hidden = F.lit(False)
    for r, c in hide:
        hidden = hidden | (F.col("r").eqNullSafe(F.lit(r)) & F.col("c").eqNullSafe(F.lit(c)))
    cells, terms = X.two_way(spark.createDataFrame(counts, "q string, r string, c string, n int"), "q", "r", "c", "n", hidden)
    known = {x.cell: x.value for x in cells.collect()}
    assert sum(v is None for v in known.values()) == len(hide)
    got = {x.cell: (x.value, x.step) for x in X.revealed(cells, terms).collect()}
    assert got == propagate(known, [tuple(t) for t in terms.collect()])

    def true(cell):
        _, r, c = json.loads(cell)
        return sum(n for _, a, b, n in counts if r in (a, None) and c in (b, None))

    assert all(v == true(cell) for cell, (v, _) in got.items())


def test_nothing_hidden_and_no_tables(spark):
    cells, terms = X.two_way(spark.createDataFrame([("t", "a", "x", 3)], "q string, r string, c string, n int"), "q", "r", "c", "n", F.lit(False))
    assert X.revealed(cells, terms).count() == 0
    assert X.revealed(cells.limit(0), terms.limit(0)).count() == 0


RULES = [K.Rule("$", "object"), K.Rule("$.a", "array", nullable=True), K.Rule("$.a[*]", "object", required=False), K.Rule("$.a[*].n", "number", low=0), K.Rule("$.s", "string", required=False, low=2, allowed=("ok", "yes", "x"))]


def test_every_problem_of_a_document_at_once(spark):
    docs = [
        (1, '{"a":[{"n":1},{"n":2.5}],"s":"ok"}'), (2, '{"a":null}'), (3, '{"s":"no"}'), (4, '{"a":[{"n":-1},{},{"n":"1","z":0},3],"s":"x"}'), (5, "oops"), (6, None), (7, "[1]"), (8, '{"a":[]}'),
    ]
    got = sorted(tuple(r) for r in K.violations(spark.createDataFrame(docs, "id int, j string"), "id", "j", RULES).collect())
    assert got == [
        (3, "$.a", "missing", 1), (3, "$.s", "value", 1), (4, "$.a[*]", "type", 1), (4, "$.a[*].n", "missing", 1), (4, "$.a[*].n", "range", 1), (4, "$.a[*].n", "type", 1), (4, "$.a[*].z", "unknown", 1),
        (4, "$.s", "range", 1), (5, "$", "unparsable", 1), (6, "$", "unparsable", 1), (7, "$", "type", 1), (7, "$[*]", "unknown", 1),
    ]


def test_canonical_documents(spark):
    docs = [(1, '{"a":1,"b":[1,2]}'), (2, '{"b":1,"a":2}'), (3, '{"a": 1}'), (4, "oops")]
    assert sorted(r.id for r in K.not_canonical(spark.createDataFrame(docs, "id int, j string"), "id", "j").collect()) == [2, 3, 4]


def test_redacted_names_leak(spark):
    rows = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "id int, name string")
    assert [r.id for r in K.leaked(rows, "name", spark.createDataFrame([(2,), (3,)], "id int"), "id").collect()] == [3]


def test_names_fold_and_match(spark):
    names = ["Ørsted Ēnergía", "Oﬃce №1 Ｆｏｏ", "株式会社 Acme Holdings", "The (old) AB", "Ab", None, "Łódź ² Ltd"]
    got = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.entity_key(F.col("n")).alias("k")).collect()]
    assert got == ["rsted energia", "office 1", "acme", "", "", "", "odz 2"]


def test_both_named_rule_placeholders_and_tiers(spark):
    left = [(1, "Acme Energy", False), (2, "Acme Energy", True), (3, "N/A", False), (4, "Bank of North", False), (5, "Solo", False), (6, "Green Power Group", None), (7, "Bank of North West", False)]
    right = [(11, "ACME ENERGY Ltd", False), (12, "n/a", False), (13, "Bank of the North West Coast", False), (14, "Solo Flight", False), (15, "Green Power", False), (16, "Bank North of", True), (17, "Acme Energy Services", False)]
    a, b = (spark.createDataFrame(x, "id int, name string, red boolean") for x in (left, right))
    got = sorted(tuple(r) for r in B.cross_matches(a, b, "id", "name", "red").collect())
    assert got == [(1, 11, "exact"), (4, 13, "variant"), (7, 13, "variant")]
    assert B.cross_matches(a, b, "id", "name", "red", b.where("id = 11")).where("left_id = 1").select("right_id", "tier").collect() == [(17, "variant")]


def test_variants_equal_all_pairs(spark):
    rng = random.Random(8)
    make = lambda n, k: [(i + k, " ".join(rng.sample(["bank", "of", "north", "energy", "water", "coal", "sun"], rng.randint(1, 5)))) for i in range(n)]
    left, right = make(60, 0), make(60, 1000)
    got = {tuple(r) for r in B.entity_variants(spark.createDataFrame(left, "id int, key string"), spark.createDataFrame(right, "id int, key string")).collect()}
    exact = {(i, j) for (i, a), (j, b) in itertools.product(left, right) if a == b}
    done = {i for i, _ in exact}, {j for _, j in exact}
    near = {
        (i, j) for (i, a), (j, b) in itertools.product(left, right)
        if i not in done[0] and j not in done[1] and (x := set(a.split())) != (y := set(b.split())) and (x < y or y < x) and min(len(x), len(y)) >= 2
    }
    assert got == {(*p, "exact") for p in exact} | {(*p, "variant") for p in near} and near


def test_seeds_grow_within_their_area(spark):
    rng = random.Random(12)
    own = {i: {rng.randrange(25) for _ in range(3)} for i in range(60)}
    area = {i: "x" if i % 2 else "y" for i in own}
    members = spark.createDataFrame([(f"c{c}", i) for i, cs in own.items() for c in cs], "cluster_hash string, id long")
    scope = spark.createDataFrame(list(area.items()), "id long, area string")
    seeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("lost", 999)], "seed string, id long")
    for least in (1, 2):
        want = {("lost", 999)}
        for seed, first in (("a", 1), ("b", 2), ("c", 3)):
            held, todo = {first}, [first]
            while todo:
                i = todo.pop()
                new = {j for j in own if area[j] == area[i] and j not in held and len(own[i] & own[j]) >= least}
                held |= new
                todo += new
            want |= {(seed, i) for i in held}
        assert {tuple(r) for r in D.seeded_components(seeds, members, scope, least, max_pairs=5).collect()} == want


def test_rounds_shuffle_the_frontier_only(spark):
    """A step's join broadcasts what was found last; the edges are read as they lie."""
    edges = spark.range(1, 40).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(1000, 3000).selectExpr("id as a", "id + 1 as b"))
    got = D.reached(spark.createDataFrame([("s", 1)], "seed string, id long"), edges)
    assert sorted(r.id for r in got.collect()) == list(range(1, 41))


def test_blocs_of_unknown_kinds_raise(spark):
    none = spark.createDataFrame([], "respondent_id long, signature string")
    with pytest.raises(ValueError):
        P.resolved_blocs([("a", "guess", 1)], none, none, none, none, none)


def test_effects_hide_both_sides(spark):
    rows = [(1, "us", "A")] * 6 + [(1, "de", "A")] * 12 + [(2, "us", "A")] * 2 + [(2, "de", "B")] * 9 + [(3, "fr", "A")] * 7 + [(1, None, "A")]
    a = spark.createDataFrame(rows, "q int, country string, answer_text string")
    side = F.when(F.col("country") == "us", "us").otherwise("non_us")
    got = {(r.q, r.side): (r.c, r.n, r.thin, r.masked) for r in P.two_sided_cells(a, "q", side, ("us", "non_us"), ["A", "B"]).collect()}
    assert got == {(1, "us"): ([6, 0], 6, True, False), (1, "non_us"): ([13, 0], 13, False, False)} | {(q, s): (None, None, False, True) for q in (2, 3) for s in ("us", "non_us")}


def test_strict_quotes_raise(spark):
    df = spark.createDataFrame([("word " * 200,)], "t string")
    assert df.select(T.checked_quote(F.col("t"))["warning"].alias("w")).first().w == "quote 1000 chars, truncated to 599 (limit 600)"
    with pytest.raises(Exception, match="quote of 1000 chars"):
        df.select(T.checked_quote(F.col("t"), strict=True)["quote"]).collect()


def test_labels_are_fine_or_named(spark):
    head = "question_id string, question_number int, sub_number string, shorthand string, label string, category string, method string, subcategory string, notes string"
    fine = ("Q026_1", 26, "1", "the_test", "L", "c", "m", "s", "n")
    wrong = ("Q027_1", 28, "2", "The_test", None, "d", "x", "t", None)
    args = dict(vocabularies={"category": ["c", "d"]}, implies={"d": "m"}, belongs={"c": ["s"], "d": ["u"]}, present=("label", "subcategory"), noted=("Q027_1",), digits=False, numbered=True)
    assert readers.label_violations(spark.createDataFrame([fine], head), **args).count() == 0
    got = sorted(r.rule for r in readers.label_violations(spark.createDataFrame([fine, wrong], head), **args).collect())
    assert got == ["category implies method", "label present", "notes required", "number of id", "shorthand form", "sub number of id", "subcategory of category"]
