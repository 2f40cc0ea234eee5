"""Benchmark decontamination: a hash set of normalised test n-grams against token windows of the corpus.

DataFrame functions only. Of each window of ``window`` words, ``window // 2`` consecutive words start at a
multiple of the stride; so it is enough to look up every stride-th short run of a document among all
short runs of the benchmark. Documents with such a run are read again, and their windows around it are
compared word for word with the benchmark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import maybe_broadcast, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes (8 bytes each) of benchmark runs up to which they are broadcast.
RUNS = 2_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised_words(text: Column) -> Column:
    """A-Z lower-cased words of digits, letters and anything outside ASCII; null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def _run_hash(words: Column, at: Column, size: int, k: int) -> Column:
    """Hash of ``size`` words from ``at`` on, for windows of ``k`` words."""
    return F.xxhash64(F.lit(k), *(F.get(words, at + i) for i in range(size)))


def _upto(first: int, last: Column, step: int = 1) -> Column:
    """first, first + step, ... up to last; empty if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, last: Column, step: int, size: int, k: int) -> Column:
    """(k, at, h) of every ``step``-th run of ``size`` words up to the one at ``last``."""
    return F.transform(_upto(0, last, step), lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), _run_hash(words, i, size, k).alias("h")))


def _sampling(k: int, window: int) -> tuple[int, int]:
    """(run, step): of each window of ``k`` words a run of so many words starts at a multiple of the step."""
    run = max(1, window // 2) if k == window else k
    return run, k - run + 1


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item_id, k, key): each window of an item; an item with fewer words, but not none, is one window."""
    words = bench.select(F.col(item_col).cast("string").alias("item_id"), normalised_words(F.col(text_col)).alias("w"))
    words = words.withColumn("k", F.least(F.size("w"), F.lit(window))).where("k > 0")
    starts = _upto(0, F.size("w") - F.col("k"))
    return words.select("item_id", "k", F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i + 1, F.col("k"))))).alias("key")).distinct()


def contaminated_spans(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """(id, at, k, item_id): the words ``at .. at + k - 1`` of a document are a window of the item.

    Distinct rows; documents with a null id are left out, rows with the same id are one document. An empty
    benchmark or table gives no rows. Ids may be of any type that can be grouped; other columns are not read.
    """
    keys = materialise(benchmark_windows(bench, item_col, bench_text, window), "windows")
    n_keys, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    lengths = sorted(r.k for r in keys.select("k").distinct().collect())  # ``window`` of them at most
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not lengths:
        return named.select("id", F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit("").alias("item_id")).limit(0)
    hits = _probed(named, keys, n_keys, lengths, window)
    n_hits, places = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("c")), F.lit(0))).first()
    words = named.join(maybe_broadcast(hits, n_hits, size=16 * places), "id").select("id", "c", normalised_words(F.col("text")).alias("w"))

    def starts(x: Column) -> Column:
        """Windows around a found run, as start * window size limit + length."""
        k, at = x["k"], x["at"]
        back = F.lit(0)
        for own in lengths:
            back = F.when(k == own, own - _sampling(own, window)[0]).otherwise(back)
        first, last = F.greatest(F.lit(0), at - back), F.least(at, F.size("w") - k)
        codes = F.transform(F.sequence(first, last), lambda i: i.cast("long") * (window + 1) + k)
        return F.when(last >= first, codes).otherwise(F.array().cast("array<bigint>"))

    windows = F.transform(
        F.array_distinct(F.flatten(F.transform("c", starts))),
        lambda code: F.struct(F.floor(code / (window + 1)).cast("int").alias("at"), (code % (window + 1)).cast("int").alias("k")),
    )
    read = F.transform(windows, lambda x: F.struct(x["at"].alias("at"), x["k"].alias("k"), F.concat_ws(" ", F.slice("w", x["at"] + 1, x["k"])).alias("key")))
    seen = words.select("id", F.explode(read).alias("x")).select("id", "x.at", "x.k", "x.key")
    return seen.join(maybe_broadcast(keys, n_keys, size=size), ["k", "key"]).select("id", "at", "k", "item_id").distinct()


def _probed(docs: DataFrame, keys: DataFrame, n_keys: int, lengths: list[int], window: int) -> DataFrame:
    """(id, c): of each document with any, the places (k, at) of its sampled runs that are a benchmark's run too.

    One scan for all lengths. Beyond the broadcast limit only ids, places and hashes are shuffled.
    """
    w, split = F.col("w"), F.split("key", " ")
    probes, runs = [], F.array().cast("array<bigint>")
    for k in lengths:
        run, step = _sampling(k, window)

        none = F.array().cast("array<struct<k:int,at:int,h:bigint>>")
        probes.append(F.when(F.size(w) >= k, _runs(w, F.size(w) - run, step, run, k)).otherwise(none))
        runs = F.when(F.col("k") == k, _runs(split, F.lit(k - run), 1, run, k)["h"]).otherwise(runs)
    wanted = keys.select(F.explode(runs).alias("h")).distinct()
    found = docs.select("id", normalised_words(F.col("text")).alias("w")).select("id", F.explode(F.concat(*probes)).alias("x")).select("id", "x.k", "x.at", "x.h")
    found = found.join(maybe_broadcast(wanted, n_keys * window, RUNS), "h", "left_semi")
    return materialise(found.groupBy("id").agg(F.collect_set(F.struct("k", "at")).alias("c")), "hits")


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window, ``items`` lists the items that
    have one, sorted. Null and empty texts have no words; rows with a null id are counted, not searched.
    Repeated rows come back as often as given. No rows give no rows; an empty benchmark hits nothing.
    """
    spans = materialise(contaminated_spans(docs, bench, id_col, text_col, item_col, bench_text, window), "spans")
    places = spans.select("id", "at", "k").distinct()
    # an interval's words that no earlier one has covered: its end less the furthest end so far
    per = (
        places.groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("at", F.expr("at + k").alias("end")))).alias("x"))
        .select(
            "id",
            F.aggregate(
                "x",
                F.struct(F.lit(0).alias("far"), F.lit(0).cast("long").alias("n")),
                lambda s, v: F.struct(
                    F.greatest(s["far"], v["end"]).alias("far"),
                    (s["n"] + F.greatest(F.lit(0), v["end"] - F.greatest(s["far"], v["at"]))).alias("n"),
                ),
                lambda s: s["n"],
            ).alias("n_hit"),
        )
    )
    items = spans.select("id", "item_id").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hits = per.join(items, "id").withColumnRenamed("id", "_id")
    counted = docs.select(F.col(id_col), F.size(_counted(F.col(text_col))).cast("long").alias("n_words"))
    return counted.join(hits, counted[id_col] == hits["_id"], "left").select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _counted(text: Column) -> Column:
    """As many entries as the text has words, without lower-casing it."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window.

    Null, empty and blank texts and rows with a null id stay. Repeated rows go or stay together; columns of any
    name are kept as they are; no rows give no rows, an empty benchmark drops nothing.
    """
    gone = materialise(contaminated_spans(docs, bench, id_col, **settings).select(F.col("id").alias(id_col)).distinct(), "gone")
    return docs.join(maybe_broadcast(gone, gone.count()), id_col, "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: object) -> DataFrame:
    """``docs`` with hit documents' texts reduced to their normalised words outside all hit spans.

    All other texts stay as they are: null, empty and blank ones, those without a hit, those of a null id.
    Repeated rows are treated alike, no rows give no rows. All columns stay, whatever their names.
    """
    spans = contaminated_spans(docs, bench, id_col, text_col, **settings)
    places = spans.groupBy("id").agg(F.collect_set(F.struct("at", F.expr("at + k").alias("upto"))).alias("x"))
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(id_col).alias("i")).join(places, F.col("i") == places["id"], "left")
    words = F.transform(normalised_words(F.col("d")[text_col]), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    out = F.filter(words, lambda w: ~F.exists("x", lambda s: (s["at"] <= w["i"]) & (w["i"] < s["upto"])))
    left = F.array_join(F.transform(out, lambda w: w["w"]), " ")
    new = F.when(F.col("x").isNull(), F.col("d")[text_col]).otherwise(left)
    return joined.select(*(new.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns))
