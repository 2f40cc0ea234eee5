"""Derivations over answers: shared texts, identical answer vectors, families, blocs, citations, junk, resubmission."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.ranking import ranked, use_checkpoints


def text_members(answers: DataFrame, id_col: str, text_col: str, min_chars: int = 200, preview: int = 240) -> DataFrame:
    """(cluster_hash, id, chars, preview), distinct: who gave which normalised text of at least ``min_chars``.

    The length filter comes before hashing; the text itself never goes through a shuffle."""
    norm = T.normalize(F.col(text_col))
    long = answers.select(F.col(id_col).alias("id"), norm.alias("t")).where(F.length("t") >= min_chars)
    return long.select(F.sha1("t").alias("cluster_hash"), "id", F.length("t").alias("chars"), F.substring("t", 1, preview).alias("preview")).distinct()


def text_clusters(members: DataFrame, min_members: int = 3) -> DataFrame:
    """(cluster_hash, n_respondents, chars, preview, first_id) of texts that several respondents gave.

    Counted, not collected: a text that everybody gave is still one row. Members stay a long table."""
    grouped = members.groupBy("cluster_hash").agg(
        F.count("*").alias("n_respondents"), F.max("chars").alias("chars"), F.min("preview").alias("preview"), F.min("id").alias("first_id")
    )
    return grouped.where(F.col("n_respondents") >= min_members)


def listed(members: DataFrame, key: str, id_col: str, max_members: int = 100_000) -> DataFrame:
    """(key, member_ids joined by ``|``) for publishing; a group beyond ``max_members`` raises in the query."""
    sizes = members.groupBy(key).agg(F.count("*").alias("n")).where(F.assert_true(F.col("n") <= max_members, "too many members to list").isNull())
    return members.join(sizes.select(key), key).groupBy(key).agg(T.join_ids(F.collect_set(id_col)).alias("members"))


def sharing_summary(members: DataFrame, template_min: int = 3, large: int = 200) -> DataFrame:
    """(id, n_shared, n_co_sharers, is_template): clusters that hold a respondent, distinct others in them, and whether
    these are ``template_min`` at least (3 in the first edition, 1 in the second).

    No respondents or profiles are paired but within clusters of at most ``large`` members. The holders of a set of larger
    clusters are counted once for the set: respondents are numbered, so that those with the same large clusters are
    neighbours, each cluster is a bitmap, and the bits of a set's bitmaps are put together and counted."""
    m = members.select(F.col("cluster_hash").alias("c"), "id").distinct()
    sizes = m.groupBy("c").agg(F.count("*").alias("held"))
    big = F.col("held") > large
    own = m.join(sizes, "c").groupBy("id").agg(
        F.count("*").cast("int").alias("n_shared"), F.array_sort(F.collect_set(F.when(big, F.col("c")))).alias("large"), F.collect_set(F.when(~big, F.col("c"))).alias("small")
    )
    numbered = ranked(own.where(F.size("large") > 0).select("id", "large"), [F.col("large"), F.col("id")], "no")
    bits = numbered.select(F.explode("large").alias("c"), F.bitmap_bucket_number("no").alias("bucket"), F.bitmap_bit_position("no").alias("bit"))
    maps = bits.groupBy("c", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    sets = numbered.select("large").distinct()
    either = sets.select("large", F.explode("large").alias("c")).join(maps, "c").groupBy("large", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("map")).alias("n"))
    of_set = either.groupBy("large").agg(F.sum("n").alias("in_large"))
    each = own.select("id", "large", F.explode("small").alias("c"))
    near = each.join(each.select(F.col("id").alias("other"), F.col("large").alias("theirs"), "c"), "c").where(F.col("id") != F.col("other")).where(~F.arrays_overlap("large", "theirs"))
    in_small = near.select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("in_small"))
    counted = own.select("id", "n_shared", "large").join(of_set, "large", "left").join(in_small, "id", "left")
    n = F.coalesce(F.col("in_large") - 1, F.lit(0)) + F.coalesce("in_small", F.lit(0))
    return counted.select("id", "n_shared", n.cast("long").alias("n_co_sharers"), (n >= template_min).alias("is_template"))


def vector_clusters(scores: DataFrame, id_col: str, key: str, score: str, min_length: int = 10, min_members: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster_id, n_respondents, vector_length, h) of respondents whose whole score vectors are equal,
    and their members (cluster_id, id). A vector is as long as the questionnaire; groups are counted."""
    vectors = scores.where(F.col(score).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("q"), F.col(score).alias("s")))).alias("v"))
    vectors = vectors.where(F.size("v") >= min_length).select(F.col(id_col).alias("id"), F.sha2(F.to_json("v"), 256).alias("h"), F.size("v").alias("vector_length"))
    groups = vectors.groupBy("h", "vector_length").agg(F.count("*").alias("n_respondents"), F.min("id").alias("first_id")).where(F.col("n_respondents") >= min_members)
    numbered = ranked(groups, [F.desc("n_respondents"), F.desc("vector_length"), F.col("first_id")], "no")
    named = numbered.select(F.format_string("vc%02d", "no").alias("cluster_id"), "n_respondents", "vector_length", "h")
    return named, vectors.join(named.select("cluster_id", "h"), "h").select("cluster_id", "id")


def anchor_signature(scores: DataFrame, id_col: str, key: str, score: str, anchors: list[int], mapped: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """(id, signature): one character for each anchor; ``-`` unanswered, ``?`` an answer without a character."""

    def char(q: int) -> Column:
        got = F.max(F.when(F.col(key) == q, F.col(score).cast("string")))
        if mapped is None:
            return F.coalesce(got, F.lit("-"))
        table = F.create_map(*(F.lit(x) for kv in mapped[q].items() for x in kv))
        return F.when(got.isNull(), "-").otherwise(F.coalesce(F.element_at(table, got), F.lit("?")))

    return scores.groupBy(id_col).agg(F.concat(*(char(q) for q in anchors)).alias("signature"))


def agreed_signature(signatures: DataFrame, group: str, width: int) -> DataFrame:
    """Per group and place: the value all members that answered agree on, else null."""

    def place(i: int) -> Column:
        c = F.substring("signature", i + 1, 1)
        said = F.when(c != "-", c)
        return F.when(F.countDistinct(said) == 1, F.max(said))

    return signatures.groupBy(group).agg(F.array(*(place(i) for i in range(width))).alias("agreed"))


def families_by_pattern(entities: DataFrame, name: str, patterns: list[tuple[str, str]], id_col: str) -> DataFrame:
    """(id, family, n_matches): the first pattern that is found wins; overlaps show as a count over one."""
    found = F.array_compact(F.array(*(F.when(F.col(name).rlike(p), F.lit(k)) for k, p in patterns)))
    return entities.select(id_col, found.alias("m")).where(F.size("m") > 0).select(id_col, F.col("m")[0].alias("family"), F.size("m").alias("n_matches"))


def families_by_name(entities: DataFrame, name: str, id_col: str, min_members: int = 2) -> DataFrame:
    """(id, family, n_members): entities with equal normalised names that are no placeholder."""
    norm = entities.where(~T.is_placeholder(F.col(name))).select(id_col, T.normalize(F.col(name)).alias("n")).distinct()
    sizes = norm.groupBy("n").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= min_members)
    return norm.join(sizes, "n").select(id_col, F.substring(T.slugify(F.col("n")), 1, 40).alias("family"), "n_members")


def resubmissions(entities: DataFrame, name: str, id_col: str) -> DataFrame:
    """(id, kept_id, next_id, superseded): same name, the latest submission is kept, each points to the next."""
    norm = entities.where(~T.is_placeholder(F.col(name))).select(id_col, T.normalize(F.col(name)).alias("n"))
    latest = norm.groupBy("n").agg(F.max(id_col).alias("kept_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    placed = ranked(norm.join(latest, "n"), [F.col("n"), F.col(id_col)], "no")
    after = placed.select(F.col("n").alias("n_after"), F.col(id_col).alias("next_id"), (F.col("no") - 1).alias("no"))
    both = placed.join(after, "no", "left")
    return both.select(id_col, "kept_id", F.when(F.col("n") == F.col("n_after"), F.col("next_id")).alias("next_id"), (F.col(id_col) < F.col("kept_id")).alias("superseded"))


def common_edges(members: DataFrame, min_shared: int = 2, max_pairs: int = 200) -> DataFrame:
    """(a, b, n_shared): edges between respondents with at least ``min_shared`` clusters in common, each counted over
    all clusters. Their connected components are those of all such pairs, though not every pair has its edge.

    Respondents in the same clusters are one profile, a star on its smallest member. Profiles with a cluster of at most
    ``max_pairs`` profiles in common meet by pairs. Those that share only larger clusters have ``min_shared`` of these
    in common: each such set is a star on its smallest holder, so its rows grow with the holders, not with their pairs."""
    own = members.select("cluster_hash", "id").distinct().groupBy("id").agg(F.array_sort(F.collect_set("cluster_hash")).alias("clusters")).where(F.size("clusters") >= min_shared)
    own = own.withColumn("hub", F.min("id").over(W.partitionBy("clusters")))
    alike = own.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.size("clusters").cast("long").alias("n_shared"))
    profiles = own.where("hub = id").select("id", "clusters")
    each = profiles.select("id", F.explode("clusters").alias("c"))
    sized = each.join(each.groupBy("c").agg(F.count("*").alias("size")).where("size > 1"), "c")
    small, large = sized.where(F.col("size") <= max_pairs).select("id", "c"), sized.where(F.col("size") > max_pairs).select("id", "c")
    near = small.select(F.col("id").alias("a"), "c").join(small.select(F.col("id").alias("b"), "c"), "c").where("a < b").select("a", "b")
    sets = large.select("id", F.array("c").alias("set"))
    for _ in range(min_shared - 1):
        sets = sets.join(large, "id").where(F.col("c") > F.element_at("set", -1)).select("id", F.concat("set", F.array("c")).alias("set"))
    hubs = sets.groupBy("set").agg(F.min("id").alias("a"))
    far = sets.join(hubs, "set").where("a < id").select("a", F.col("id").alias("b"))
    pairs = near.unionByName(far).distinct()
    pairs = pairs.join(profiles.select(F.col("id").alias("a"), F.col("clusters").alias("x")), "a").join(profiles.select(F.col("id").alias("b"), F.col("clusters").alias("y")), "b")
    counted = pairs.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n_shared")).where(F.col("n_shared") >= min_shared)
    return alike.unionByName(counted)


def blocs(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, bloc): connected components by smallest label; each round also jumps to the label's own label.

    Lineage is cut by ``checkpoint`` in the folder that ``spark.checkpoint.dir`` names."""
    use_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("bloc", F.col("id")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "bloc"), "b").groupBy(F.col("a").alias("id")).agg(F.min("bloc").alias("low"))
        step = labels.join(near, "id").select("id", F.least("bloc", "low").alias("bloc"))
        jump = step.select(F.col("id").alias("bloc"), F.col("bloc").alias("further"))
        new = step.join(jump, "bloc", "left").select("id", F.least("bloc", F.coalesce("further", "bloc")).alias("bloc")).checkpoint()
        moved = new.join(labels.withColumnRenamed("bloc", "old"), "id").where("bloc <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError("blocs did not settle")


def reached(seeds: DataFrame, edges: DataFrame, rounds: int = 1000, small: int = 200_000) -> DataFrame:
    """(seed, id): what the ``edges`` (a, b) connect with each of ``seeds`` (seed, id), itself included.

    Grown from the seeds only: a round joins what the last one found with the edges, so the rest of the graph is never
    labelled; what was found is broadcast while it has at most ``small`` rows, counted each round, and shuffled beyond."""
    use_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    known = front = seeds.select("seed", "id").distinct().checkpoint()
    for _ in range(rounds):
        n = front.count()
        if not n:
            return known
        met = both.join(F.broadcast(front) if n <= small else front, both["a"] == front["id"]).select("seed", F.col("b").alias("id")).distinct()
        front = met.join(known, ["seed", "id"], "left_anti").checkpoint()
        known = known.unionByName(front).checkpoint()
    raise RuntimeError("seeds are not settled")


def seeded_components(seeds: DataFrame, members: DataFrame, scope: DataFrame, min_shared: int, max_pairs: int = 200) -> DataFrame:
    """(seed, id): respondents linked with each seed, step by step, by at least ``min_shared`` shared texts.

    The walk stays in the seed's scope: ``scope`` is (id, area), and only texts shared within an area count. Members of areas
    without a seed are left out before anything is compared. A seed that is in no cluster is alone."""
    areas = scope.join(seeds.select("id"), "id", "left_semi").select("area").distinct()
    near = members.join(scope.join(areas, "area", "left_semi"), "id").select(F.struct("area", "cluster_hash").alias("cluster_hash"), "id")
    return reached(seeds, common_edges(near, min_shared, max_pairs))


def citations(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, signals, has_citation, n_urls) of answers with a signal."""
    found = answers.select(id_col, T.signals(F.col(text_col)).alias("signals"), F.size(T.find_urls(F.col(text_col))).alias("n_urls"))
    return found.where(F.size("signals") > 0).withColumn("has_citation", T.has_hard_signal(F.col("signals")))


def citation_rollup(answers: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """(id, n_signal_answers, n_hard, n_urls, domains): by respondent, answers with a signal and with a hard one, links with a
    domain, and their distinct domains in order. A respondent without any has no row."""
    x = F.col(text_col)
    signals = T.signals(x)
    domains = F.filter(F.transform(T.find_urls(x), lambda u: T.registrable_domain(u, strict)), lambda v: v != "")
    each = answers.select(F.col(id_col).alias("id"), (F.size(signals) > 0).alias("any"), T.has_hard_signal(signals).alias("hard"), domains.alias("d"))
    held = each.where("any or size(d) > 0")
    sums = held.groupBy("id").agg(F.count_if("any").alias("n_signal_answers"), F.count_if("hard").alias("n_hard"), F.sum(F.size("d")).alias("n_urls"))
    named = held.select("id", F.explode("d").alias("d")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("domains"))
    return sums.join(named, "id", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))


def linked_domains(answers: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """(domain, n_answers, n_links): registrable domains of all links."""
    urls = answers.select(id_col, F.explode(T.find_urls(F.col(text_col))).alias("url"))
    named = urls.select(id_col, T.registrable_domain(F.col("url"), strict).alias("domain")).where("domain <> ''")
    return named.groupBy("domain").agg(F.countDistinct(id_col).alias("n_answers"), F.count("*").alias("n_links"))


def junk_candidates(answers: DataFrame, id_col: str, text_col: str, min_share: float = 0.5, samples: int = 6) -> DataFrame:
    """Respondents with at least ``min_share`` gibberish answers, with a few of these as evidence."""
    bad = T.is_gibberish(F.col(text_col))
    x = answers.select(id_col, F.col(text_col).alias("t"), bad.alias("bad")).where("t <> ''")
    out = x.groupBy(id_col).agg(F.count("*").alias("n_answers"), F.count_if("bad").alias("n_gibberish"), F.slice(F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("t")))), 1, samples).alias("evidence"))
    return out.where(F.col("n_gibberish") / F.col("n_answers") >= min_share)


class WordVerdicts(dict):
    """Verdicts of words between blanks: 0 for one that does not count (empty, or with other white space in it), 1 for a
    word, 1 + BAD for gibberish as in :func:`text.is_gibberish`. Short words are kept while there are few enough of them."""

    BAD, LIMIT = 1 << 32, 100_000

    def __init__(self, max_chars: int = 20, min_vowels: float = 0.30):
        self.max_chars, self.min_vowels, self.run = max_chars, min_vowels, re.compile(T.keyboard_pattern())

    def _mashed(self, word: str) -> bool:
        low = word.lower()
        letters = low if low.isalpha() else "".join(filter(str.isalpha, low))
        if not letters or sum(map(letters.count, "aeiou")) / len(letters) < self.min_vowels:
            return True
        plain = low if low.isascii() and low.isalnum() else re.sub("[^0-9a-z]", "", low)
        return plain != "" and plain.count(plain[0]) == len(plain) or bool(self.run.search(re.sub("[^a-z]", "", plain)))

    def __missing__(self, word: str) -> int:
        if not word or re.search(r"[\t\n\f\r]", word):
            return 0
        if len(word) >= self.max_chars:
            return 1
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = 1 + self.BAD * self._mashed(word)
        return value


def gibberish_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_gibberish) for each id with a word. Words are judged where their text is, so that only sums are shuffled."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = WordVerdicts()
        for batch in batches:
            # one text at a time: a batch of them as strings would be held twice
            sums = [sum(map(verdicts.__getitem__, (t.as_py() or "").split(" "))) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([x % verdicts.BAD for x in sums], pa.int64()), pa.array([x // verdicts.BAD for x in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_gibberish"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(judge, f"`{id_col}` {kind}, n_words long, n_gibberish long").where("n_words > 0")
    return counts.groupBy(id_col).agg(F.sum("n_words").alias("n_words"), F.sum("n_gibberish").alias("n_gibberish"))


def contained_runs(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, cluster_id): clusters whose members all belong to the group (relational division).

    ``members`` (cluster_id, id) and ``groups`` (group_id, id) meet by equi-join and are counted."""
    v, g = members.select("cluster_id", "id").distinct(), groups.select("group_id", "id").distinct()
    sizes = v.groupBy("cluster_id").agg(F.count("*").alias("all"))
    held = v.join(g, "id").groupBy("group_id", "cluster_id").agg(F.count("*").alias("held"))
    return held.join(sizes, "cluster_id").where("held = all").select("group_id", "cluster_id")


def overlapping(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, cluster_id, n_shared): pairs with a member in common."""
    v, g = members.select("cluster_id", "id").distinct(), groups.select("group_id", "id").distinct()
    return v.join(g, "id").groupBy("group_id", "cluster_id").agg(F.count("*").alias("n_shared"))


def changed_answers(answers: DataFrame, pairs: DataFrame, id_col: str, key: str, text_col: str) -> DataFrame:
    """Questions that both submissions of a pair answered with different collapsed texts."""
    a = answers.select(F.col(id_col).alias("old_id"), key, T.collapse(F.col(text_col)).alias("old_text"))
    b = answers.select(F.col(id_col).alias("new_id"), key, T.collapse(F.col(text_col)).alias("new_text"))
    return pairs.join(a, "old_id").join(b, ["new_id", key]).where("old_text <> new_text")
