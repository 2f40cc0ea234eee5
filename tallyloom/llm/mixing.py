"""Temperature mixing of sources to target weights.

Source token shares are raised to an exponent, which bisection sets so that the weights meet a target
entropy or a limit on repetition. The weights become token budgets, and each budget whole epochs over its
source plus a part of one more, taken from the front of a keyed permutation of the source's blocks. Only
sums by source and by block are ordered; a source has about as many blocks as a block has documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import materialise, maybe_broadcast


def token_counts(docs: DataFrame, id_col: str, text_col: str, source: str, keep: tuple[str, ...] = (), seed: int = 17) -> DataFrame:
    """(id, src, n_tokens, salt, d): words split at ASCII white space, null texts have none; ``d`` has the columns to keep.

    ``salt`` hashes the id, and the text where that is null, so that rows without an id do not fall together.
    """
    text = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, " +")))
    salt = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    kept = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep))
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("src"), n.cast("long").alias("n_tokens"), salt.alias("salt"), kept.alias("d"))


#: Bisection steps that one job looks ahead.
LEVELS = 6


def find_exponent(
    totals: DataFrame, budget: float | None, target_entropy: float | None, max_repetition: float | None, steps: int = 30
) -> tuple[float, float]:
    """(exponent, budget in tokens) for ``totals`` (src, tokens > 0).

    A larger exponent lowers the entropy of the weights and the repetition of small sources; the smallest
    one in 0 to 1 that meets the repetition limit and does not exceed the target entropy is taken, so 1
    where even that is over. Without a budget it is the least that reads every source once. Bisection; each
    job sums up for all halvings that the next ``LEVELS`` steps may come to.
    """
    low_high = totals.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not low_high[0]:
        return 1.0, 0.0
    total, high, low = (float(x) for x in low_high)
    share = F.col("tokens") / F.lit(total)

    def weigh(exponents: list[float]) -> dict[float, tuple[float, float, float]]:
        """Entropy, budget, largest repetition of each exponent."""
        p = F.pow(share, F.col("a"))
        each = totals.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        out = {}
        for a, z, zl in each.groupBy("a").agg(F.sum(p), F.sum(p * F.log(share))).collect():  # one row for each exponent
            reps = [math.pow(x / total, a) / z / x for x in (low, high)]
            b = budget if budget is not None else 1 / min(reps)
            out[a] = (math.log(z) - a * zl / z, b, b * max(reps))
        return out

    def met(entropy: float, repeats: float) -> bool:
        return (max_repetition is None or repeats <= max_repetition * (1 + 1e-9)) and (target_entropy is None or entropy <= target_entropy + 1e-9)

    known = weigh([0.0, 1.0])
    good = {x: met(known[x][0], known[x][2]) for x in known}
    a = 1.0
    if (max_repetition is not None or target_entropy is not None) and good[1.0]:
        under, a = 0.0, 0.0 if good[0.0] else 1.0
        while a and steps > 0:
            ahead = 2 ** min(LEVELS, steps)
            table = weigh([under + (a - under) * i / ahead for i in range(1, ahead)])
            points = [under, *sorted(table), a]
            low_at, high_at = 0, ahead
            while high_at - low_at > 1:
                half = (low_at + high_at) // 2
                entropy, _, repeats = table[points[half]]
                low_at, high_at = (low_at, half) if met(entropy, repeats) else (half, high_at)
            under, a = points[low_at], points[high_at]
            known |= table
            steps -= LEVELS
    b = known[a][1]
    return a, min(b, max_repetition * total) if max_repetition is not None else b


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source: str = "source",
    budget_tokens: float | None = None,
    target_entropy: float | None = None,
    max_repetition: float | None = 2.0,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, n_tokens, weight, epoch, block, block_order, doc_order, keep...): one row for each reading.

    Rows sorted by epoch, block_order and doc_order are the permutation to read; ``weight`` is the source's
    share of the tokens. Texts without tokens are not read. A null source is a source like others, a null
    id is read like others; repeated rows are read each. Ties in an order go by id. A partly read epoch
    ends before the document that would exceed the source's budget. No rows give no rows. Columns in ``keep`` come
    with each reading; others are not read, whatever their names.
    """
    sizes = materialise(token_counts(docs, id_col, text_col, source, keep, seed).where("n_tokens > 0"), "tokens")
    totals = materialise(sizes.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "totals")
    exponent, budget = find_exponent(totals, budget_tokens, target_entropy, max_repetition)
    whole = float(totals.agg(F.sum("tokens")).first()[0] or 0)
    p = F.pow(F.col("tokens") / F.lit(whole or 1.0), F.lit(exponent))
    scale = totals.agg(F.sum(p)).first()[0] or 1.0
    plan = totals.select(
        F.col("src").alias("_src"),
        "tokens",
        F.greatest(F.lit(1), F.ceil(F.sqrt("docs"))).cast("long").alias("blocks"),
        (p / F.lit(scale)).alias("weight"),
        F.round(p / F.lit(scale) * F.lit(budget)).cast("long").alias("budget"),
    ).withColumns({"full": F.expr("budget div tokens"), "part": F.expr("budget % tokens")})
    plan = materialise(plan, "plan")

    def key(*cols: Column | str) -> Column:
        return F.xxhash64(F.lit(seed), *cols)

    dealt = sizes.join(maybe_broadcast(plan, plan.count()), F.col("src").eqNullSafe(F.col("_src"))).withColumn("block", F.expr("pmod(salt, blocks)"))
    dealt = dealt.withColumns({"block_order": key(F.col("full"), "src", "block"), "doc_order": key(F.col("full"), "salt")})
    sums = dealt.where("part > 0").groupBy("src", "block", "block_order", "part").agg(F.sum("n_tokens").alias("s"))
    run = sums.withColumn("before", F.expr("sum(s) over (partition by src order by block_order, block) - s"))
    taken = run.where("before < part").select(
        F.col("src").alias("_s"), F.col("block").alias("_b"), (F.col("part") - F.col("before")).alias("room"), (F.col("before") + F.col("s") <= F.col("part")).alias("all_of_it")
    )
    taken = materialise(taken, "blocks")
    more = dealt.where("part > 0").join(maybe_broadcast(taken, taken.count()), F.col("src").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    edge = more.where(~F.col("all_of_it")).withColumn("upto", F.expr("sum(n_tokens) over (partition by src, block order by doc_order, id rows unbounded preceding)"))
    names = ["id", "src", "n_tokens", "weight", "epoch", "block", "block_order", "doc_order", "d"]
    epochs = dealt.where("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, full - 1)")))
    epochs = epochs.withColumns({"block_order": key("epoch", "src", "block"), "doc_order": key("epoch", "salt")})
    part = more.where("all_of_it").drop("all_of_it").unionByName(edge.where("upto <= room").drop("all_of_it", "upto")).withColumn("epoch", F.col("full"))
    out = epochs.select(*names).unionByName(part.select(*names)).withColumnsRenamed({"id": id_col, "src": source})
    return out.select(*(c for c in out.columns if c != "d"), *(F.col("d")[c].alias(c) for c in keep))
