import collections
import datetime
import hashlib
import math
import random
import struct

import xxhash

from pyspark.sql import functions as F

from tallyloom.llm import chat as C
from tallyloom.llm import mixing as M
from tallyloom.llm import pii as P
from tallyloom.llm import queries as Q
from tallyloom.llm import url_filter as U

TEXT = (
    "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112. call +1 (643) 555-2043 or 643-555-2043, "
    "host 51.146.50.110 not 999.1.1.1, on 2024-02-29 not 2023-02-29, id 123-45-6789, mail A.b99@x.example.com"
)


def test_pseudonyms_round_trip_keep_format_and_link(spark):
    rng = random.Random(1)
    rows = [(0, TEXT), (1, None), (2, ""), (3, "4111111111111111"), (4, "nothing 12 here"), (5, "é " * 50_000 + "10.0.0.1")]
    rows += [(10 + i, f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d} {'.'.join(str(rng.randrange(256)) for _ in range(4))}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_changed int")
    out = {r.doc_id: r for r in P.pseudonymise(docs, "k").collect()}
    assert out[1].text is None and out[2].text == "" and out[4].text == rows[4][1]
    a = out[0].text.split()
    assert "4111111111111112." in a and "999.1.1.1," in a and "2023-02-29," in a and a[-1].endswith("@x.example.com")
    card = out[3].text
    assert card != "4111111111111111" and card in out[0].text and " ".join(card[i : i + 4] for i in range(0, 16, 4)) in out[0].text
    assert sum((int(d) * 2 - 9 * (int(d) > 4)) if i % 2 else int(d) for i, d in enumerate(reversed(card))) % 10 == 0
    assert len(set(out[i].text for i in range(10, 50))) == len(set(t for i, t in rows if 10 <= i < 50))
    back = P.pseudonymise(P.pseudonymise(docs, "k").drop("n_changed"), "k", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    other = {r.doc_id: r.text for r in P.pseudonymise(docs, "another").collect()}
    assert other[3] != card
    assert P.pseudonymise(docs.limit(0), "k").count() == 0


def test_cards_next_to_other_numbers(spark):
    card, four, amex = "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"
    texts = [
        card, f"{four} 12/27", f"pay {card} 99", f"no 7 {card}", f"{four} 123", f"{card}-123 x", f"1234 {four} 5678", f"{four} {four}", f"{four} 12th", f"12 {amex} 9",
        f"{four} 2024-02-29", f"{four} 643-555-2043", f"{four} 10.0.0.1", "41111111 11111111 12", f"{card} " + "12 " * 2_000 + "end", "4111 1111 1111 1112 12/27",
    ]
    out = [r.text for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = out[0]
    spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    want = [t.replace(card, new).replace(four, spaced) for t in texts[:9]]
    assert out[:9] == want and new != card
    assert amex not in out[9] and out[9][:3] + out[9][-2:] == "12  9"
    for i, other in ((10, "2024-02-29"), (11, "643-555-2043"), (12, "10.0.0.1")):
        assert out[i].startswith(spaced + " ") and other not in out[i]
    assert out[13] == f"{new[:8]} {new[8:]} 12" and out[14] == texts[14].replace(card, new) and out[15].startswith("4111 1111 1111 1112 12")


def test_feistel_is_a_permutation(spark):
    all_pairs = spark.range(7 * 5).select((F.col("id") / 5).cast("int").alias("a"), (F.col("id") % 5).cast("int").alias("b"))
    x = P.feistel(F.array("a", "b"), F.array(F.lit(7), F.lit(5)), "k", "t")
    got = all_pairs.select(x.alias("x"), P.feistel(x, F.array(F.lit(7), F.lit(5)), "k", "t", undo=True).alias("y"), "a", "b").collect()
    assert len({tuple(r.x) for r in got}) == 35 and all(r.y == [r.a, r.b] for r in got)


def _brute_rule(host, path, rules):
    fit = [(len(t), t, a) for a, t in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def test_url_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/1?x=1#y", "https://example.org/en/17", "http://org/x", "http://notorg/x", "ftp://b.com/de/?q", "http://b.com?de/",
        "http://x.org", "http://x.org#/", "a://b://c.com/fr/", "http://sub.example.org/ES/", "http://é.com/fr/é", "http://h.com/" + "a" * 50_000,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = U.train_url_model(U.rule_labels(pages, Q.URL_RULES), trees=2)
    got = {r.page_id: r for r in U.judge_urls(pages, Q.URL_RULES, model).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:].split("#")[0].split("?")[0]
        assert (got[i].host, got[i].path) == (host, path)
        rule, verdict = _brute_rule(host, path, Q.URL_RULES)
        assert got[i].rule == rule and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert U.judge_urls(pages.limit(0), Q.URL_RULES, model).count() == 0


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        spam = rng.random() < 0.4
        rows.append((i, f"http://h{i}.net/a/{'9' * 12 if spam else 'page'}?{'&'.join(['u=1'] * (4 if spam else 1))}", int(spam)))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = U.train_url_model(df.where("page_id % 5 <> 0"), trees=3)
    got = U.judge_urls(df, [], model).join(df.select("page_id", "label"), "page_id").where("page_id % 5 = 0").collect()
    assert all((r.verdict == "block") == (r.label == 1) for r in got)
    empty = U.train_url_model(df.limit(0))
    assert empty.trees == [] and {r.verdict for r in U.judge_urls(df, [], empty).collect()} <= {"allow", "block"}


def test_snapshots_collapse_like_brute_force(spark):
    rng = random.Random(6)
    convs = {}
    for i in range(80):
        if i > 5 and rng.random() < 0.6:
            src = convs[rng.choice(list(convs))]
            convs[i] = list(src[: rng.randint(1, len(src))]) + ([("user", f"t{rng.randrange(50)}")] if rng.random() < 0.4 else [])
        else:
            convs[i] = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", f"t{rng.randrange(9)}"])) for _ in range(rng.randint(1, 6))]
    rows = [(i, k, r, t) for i, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    kept = set()
    for i, a in convs.items():
        longer = any(len(b) > len(a) and b[: len(a)] == a for b in convs.values())
        if not longer and not any(b == a and j < i for j, b in convs.items()):
            kept.add(i)
    got = C.format_conversations(df).collect()
    assert {r.conv_id for r in got} == kept
    for r in got:
        assert r.rendered == "".join(f"<|im_start|>{a or 'user'}\n{b or ''}<|im_end|>\n" for a, b in convs[r.conv_id]) and r.n_turns == len(convs[r.conv_id])
    assert C.format_conversations(df.limit(0)).count() == 0


def test_rendered_text_cannot_open_a_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb")], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).first().rendered.count("<|im_start|>") == 1


def mixed(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 40), "big" if i < 300 else ("mid" if i < 360 else None)) for i in range(380)] + [(900, None, "big"), (901, "", "none"), (None, "a b", "mid")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_meets_limits_and_budgets(spark):
    rows, docs = mixed(spark)
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    for limit in (1.5, 4.0):
        out = M.mix_sources(docs, max_repetition=limit).collect()
        read = collections.Counter()
        for r in out:
            read[r.source] += r.n_tokens
        reps = {s: read[s] / n for s, n in tokens.items() if n}
        assert min(reps.values()) > 0.999 and max(reps.values()) <= limit + 1e-6 and max(reps.values()) > limit - 0.25
        assert len({(r.doc_id, r.n_tokens, r.epoch) for r in out}) == len(out)
        assert {(r.doc_id) for r in out if r.epoch == 0} == {i for i, t, _ in rows if (t or "").split()}
    again = M.mix_sources(docs.repartition(7), max_repetition=4.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_budget_and_entropy(spark):
    rows, docs = mixed(spark)
    out = M.mix_sources(docs, budget_tokens=1000, max_repetition=None).collect()
    assert 1000 - 3 * 40 <= sum(r.n_tokens for r in out) <= 1001 and {r.epoch for r in out} == {0}
    even = M.mix_sources(docs, budget_tokens=1000, max_repetition=None, target_entropy=1.0)
    w = {r.source: r.weight for r in even.collect()}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 1.0) < 1e-3
    assert M.mix_sources(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.epoch) for r in M.mix_sources(one).collect()] == [(1, 0)]


def plain_feistel(values, radices, key, kind):
    cut = -(-len(values) // 2)
    sides, sizes = [list(values[:cut]), list(values[cut:])], [radices[:cut], radices[cut:]]
    for step in range(8):
        own, other = (0, 1) if step % 2 == 0 else (1, 0)
        mask = hashlib.sha512("|".join([key, kind, str(step), ",".join(map(str, sides[other]))]).encode()).hexdigest()
        sides[own] = [(v + int(mask[i % 32 * 4 : i % 32 * 4 + 4], 16)) % r for i, (v, r) in enumerate(zip(sides[own], sizes[own]))]
    return sides[0] + sides[1]


def plain_pseudonym(m):
    """Kinds told by their look; the card in one run of digits only."""
    key = "k"
    if "@" in m:
        local, at = m.split("@")
        abc = "abcdefghijklmnopqrstuvwxyz"
        classes = [10 if c.isdigit() else 26 if c.lower() in abc else 1 for c in local]
        values = [int(c) if c.isdigit() else max(abc.find(c.lower()), 0) for c in local]
        new = [str(v) if r == 10 else abc[v] if r == 26 else c for c, v, r in zip(local, plain_feistel(values, classes, key, "email"), classes)]
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, local)) + "@" + at
    if m.count(".") == 3:
        return ".".join(map(str, plain_feistel([int(x) for x in m.split(".")], [256] * 4, key, "ip")))
    parts = m.split("-")
    if [len(x) for x in parts] == [3, 2, 4]:
        a, g, n = map(int, parts)
        a, g, n = plain_feistel([a - 2 if a > 666 else a - 1, g - 1, n - 1], [898, 99, 9999], key, "ssn")
        return f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{n + 1:04d}"
    if [len(x) for x in parts] == [4, 2, 2]:
        first = datetime.date(1900, 1, 1)
        n = (datetime.date.fromisoformat(m) - first).days
        while True:
            a, b = plain_feistel([n // 270, n % 270], [271, 270], key, "date")
            n = a * 270 + b
            if n < 73049:
                return str(first + datetime.timedelta(n))
    if [len(x) for x in parts] == [3, 3, 4]:
        d = [int(c) for c in m if c != "-"]
        low = [2 if i in (0, 3) and v >= 2 else 0 for i, v in enumerate(d)]
        radix = [(8 if v >= 2 else 2) if i in (0, 3) else 10 for i, v in enumerate(d)]
        new = [v + b for v, b in zip(plain_feistel([v - b for v, b in zip(d, low)], radix, key, "phone"), low)]
        return "".join(map(str, new[:3])) + "-" + "".join(map(str, new[3:6])) + "-" + "".join(map(str, new[6:]))
    body = plain_feistel([int(c) for c in m[:-1]], [10] * (len(m) - 1), key, "card")
    total = sum((v * 2 - 9 * (v > 4)) if i % 2 == 0 else v for i, v in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def test_pseudonyms_equal_plain_python(spark):
    rng = random.Random(3)
    values = ["4111111111111111", "378282246310005", "A.b99@x.example.com", "zoe_1@mail.org", "665-01-0001", "899-99-9999", "643-555-2043", "143-055-2043"]
    values += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(20)]
    values += [str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))) for _ in range(30)]
    out = P.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), "k").collect()
    assert {r.doc_id: r.text for r in out} == {i: plain_pseudonym(v) for i, v in enumerate(values)}
    a, b = plain_pseudonym("Ann.Lee@x.org"), plain_pseudonym("ann.lee@x.org")
    got = {r.doc_id: r.text for r in P.pseudonymise(spark.createDataFrame([(1, "Ann.Lee@x.org"), (2, "ann.lee@x.org"), (2, "ann.lee@x.org")], "doc_id long, text string"), "k").collect()}
    assert got == {1: a, 2: b} and a.lower() == b


def spark_hash(*values):
    """What xxhash64 gives for whole numbers (long, or int where given as a tuple) and texts; nulls are passed over."""
    seed = 42
    for v in values:
        data = b"" if v is None else v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        if v is not None:
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_mix(rows, limit, seed=17):
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    whole = sum(tokens.values())

    def weigh(a):
        p = {s: (n / whole) ** a for s, n in tokens.items()}
        z = sum(p.values())
        reps = [p[s] / z / n for s, n in tokens.items()]
        return {s: x / z for s, x in p.items()}, 1 / min(reps), max(reps) / min(reps)

    under, a = 0.0, 1.0
    if weigh(0.0)[2] <= limit * (1 + 1e-9):
        a = 0.0
    for _ in range(30 if a else 0):
        half = (under + a) / 2
        under, a = (under, half) if weigh(half)[2] <= limit * (1 + 1e-9) else (half, a)
    weights, budget, _ = weigh(a)
    budget = min(budget, limit * whole)
    docs = collections.Counter(s for _, t, s in rows if (t or "").split())
    out = []
    for s, n in tokens.items():
        full, part = divmod(round(weights[s] * budget), n)
        blocks = max(1, math.ceil(math.sqrt(docs[s])))
        own = [(i, len(t.split()), spark_hash((seed,), i, t if i is None else None)) for i, t, x in rows if x == s and (t or "").split()]
        for e in range(full + (part > 0)):
            groups = collections.defaultdict(list)
            for i, k, salt in own:
                groups[salt % blocks].append((spark_hash((seed,), e, salt), i, k))
            left = part if e == full else math.inf
            for b in sorted(groups, key=lambda b: (spark_hash((seed,), e, s, b), b)):
                for order, i, k in sorted(groups[b], key=lambda x: (x[0], x[1] is not None, x[1])):
                    if k > left:
                        left = -1
                    if left < 0:
                        break
                    left -= k
                    out.append((i, s, k, e, b, order))
                if left < 0:
                    break
    return weights, out


def test_mixing_equals_plain_python(spark):
    rows, docs = mixed(spark)
    rows, docs = rows + rows[-1:], docs.unionByName(docs.where("doc_id is null")).withColumn("tokens", F.lit("clash")).withColumn("epoch", F.lit("clash"))
    for limit in (1.5, 4.0):
        weights, want = plain_mix(rows, limit)
        got = M.mix_sources(docs, max_repetition=limit).collect()
        assert sorted(((r.doc_id, r.source, r.n_tokens, r.epoch, r.block, r.doc_order) for r in got), key=str) == sorted(want, key=str)
        assert all(abs(r.weight - weights[r.source]) < 1e-6 for r in got)
    kept = M.mix_sources(docs, max_repetition=4.0, keep=("text",)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((i, next(t for j, t, x in rows if j == i and x == s)) for i, s, *_ in want), key=str)


def test_first_split_and_scores_equal_plain_python(spark):
    rng = random.Random(21)
    rows = []
    for i in range(500):
        bad = rng.random() < 0.3
        host = rng.choice(["a.example.org", "b.net", "c.co.uk", "long-name-here.com"])
        rows.append((i, f"http://{host}/{'x' * rng.randint(1, 30)}/{rng.randrange(10 ** rng.randint(1, 9))}{'?a=1&b=2' if rng.random() < (0.7 if bad else 0.2) else ''}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = U.train_url_model(df, trees=4, bins=8)
    assert len(model.held_out_loss) >= 2 and min(model.held_out_loss) < model.held_out_loss[0]
    own = {r.url: r for r in U.lexical_features(df, "url").collect()}
    fit = [(u, y) for _, u, y in rows if spark_hash(u, (7,)) % 5]
    base = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    assert abs(model.base - math.log(base / (1 - base))) < 1e-12

    def gain(values, at):
        g = [base - y for _, y in fit]
        left = [v <= at for v in values]
        gl, nl = sum(x for x, l in zip(g, left) if l), sum(left)
        h, gt = base * (1 - base), sum(g)
        return gl * gl / (h * nl + 1) + (gt - gl) ** 2 / (h * (len(g) - nl) + 1) - gt * gt / (h * len(g) + 1)

    feature, at, _, _ = model.trees[0]
    found = gain([own[u][feature] for u, _ in fit], at)
    for f in U.FEATURES[:-1]:  # the suffix rate in training is out of fold
        values = sorted(own[u][f] for _, u, _ in rows)
        cuts = {values[max(0, math.ceil(i / 8 * len(values)) - 1)] for i in range(1, 8)}
        assert all(gain([own[u][f] for u, _ in fit], c) <= found + 1e-6 for c in cuts), f

    def value(node, x):
        return node if isinstance(node, float) else value(node[2] if x[node[0]] <= node[1] else node[3], x)

    rates = {r["_s"]: r["_rate"] for r in model.rates.collect()}
    for r in U.judge_urls(df, [], model).collect():
        x = own[rows[r.page_id][1]].asDict()
        x["suffix_rate"] = rates[x["suffix"]]
        z = model.base + sum(value(t, x) for t in model.trees)
        assert abs(r.block_score - 1 / (1 + math.exp(-z))) < 1e-9 and r.verdict == ("block" if z >= 0 else "allow")


def test_urls_repeated_and_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "r"), (1, "http://a.org/x", "h", "r"), (None, None, None, None)], "page_id long, url string, host string, suffix_rate string")
    model = U.train_url_model(pages.withColumn("label", F.lit(1)))
    got = U.judge_urls(pages, Q.URL_RULES, model).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == [("1", "a.org", "allow"), ("1", "a.org", "allow"), ("None", "", "block")]


def test_conversations_with_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "x" * 300_000, 1, 2), (1, 1, "assistant", "y", 1, 2), (2, 0, "user", "x" * 300_000, 1, 2), (3, 0, "user", "q", 1, 2), (3, 0, "user", "q", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, h1 int")
    assert sorted((r.conv_id, r.n_turns) for r in C.format_conversations(df).collect()) == [(1, 2), (3, 2)]
