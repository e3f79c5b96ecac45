"""Matching names of two dimensions by text and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.textcols import bigrams, normalize_name
from stopwise.operators.numbering import global_row_number
from stopwise.session import cut_lineage, stored


THRESHOLDS = (0.95, 0.8, 0.65, 0.5, 0.35, 0.2)  # similarities asked for in turn
WIDEST = 4  # most bigrams in a key
PAIRS_PER_ROW = 32  # pairs per text above which keys get wider
KEYS_PER_ROW = 40  # keys per candidate above which they do not
FEW_PAIRS = 10_000_000  # names times candidates that need no wider keys


def fuzzy_name_match(names: DataFrame, candidates: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """The most similar candidate for each distinct name.

    Similarity is the Dice coefficient of the bigram sets of the normalised names.
    Names ask with falling thresholds: for a threshold t a name only probes with as many of its
    rarest bigrams as a partner with similarity t cannot avoid all at once, and sizes must allow t.
    Where single bigrams meet too many candidates, combinations of several are the keys: texts that must share n bigrams
    share a combination of k <= n among a few more of the rarest. Pairs are scored where they meet and only the best of a name is written.
    A name whose best similarity reaches t is done; only the others ask again, at last for ``cutoff``
    (at 0 by every bigram, as similar names share one). The result does not depend on the thresholds.
    ``names`` has the column name, ``candidates`` the column candidate.
    """
    left = names.select("name").distinct().withColumn("_g", bigrams(normalize_name(F.col("name"))))
    right = stored(candidates.select("candidate").distinct().withColumn("_g", bigrams(normalize_name(F.col("candidate")))), "candidates")
    rarity = right.select(F.explode("_g").alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    ranks = stored(global_row_number(rarity, [F.col("freq"), F.col("gram")], "rank").select("gram", F.col("rank").cast("int").alias("rank")), "bigrams")
    waiting, right = _ranked(left, "name", ranks), _ranked(right, "candidate", ranks)
    size = right.count()
    found = None
    for threshold in [*[t for t in THRESHOLDS if t > cutoff], cutoff]:
        best = _best(waiting, right, size, threshold)
        if best is not None:
            found = best if found is None else found.unionByName(best)
            waiting = cut_lineage(waiting.join(best.select("name"), "name", "left_anti"))
            if waiting.isEmpty():
                break
    return found if found is not None else waiting.select("name", F.col("name").alias("match"), F.lit(0.0).alias("similarity")).limit(0)


def _ranked(side: DataFrame, column: str, ranks: DataFrame) -> DataFrame:
    """(text, size, ranks): the number of its bigrams, and those that candidates have by rank, rarest first."""
    rows = side.select(column, F.size("_g").alias("size"), F.explode("_g").alias("gram")).join(ranks, "gram")
    return stored(rows.groupBy(column, "size").agg(F.array_sort(F.collect_list("rank")).alias("ranks")), f"ranked_{column}")


def _needed(threshold: float) -> Column:
    """The least overlap that a partner of the threshold must have: overlap >= t/2 * (|a|+|b|) and |b| >= overlap."""
    return F.greatest(F.ceil(F.lit(threshold / (2 - threshold)) * F.col("size") - 1e-9), F.lit(1)).cast("int")


def _keys(side: DataFrame, level: int) -> DataFrame:
    """One row per text and combination of ``level`` of its rarest bigrams that a partner must share one of."""
    columns = [c for c in side.columns if c != "_need"]
    upto = F.least(F.size("ranks"), F.size("ranks") - F.col("_need") + F.lit(level))
    rows = side.withColumn("_upto", upto).select(*columns, "_upto", F.posexplode(F.slice("ranks", F.lit(1), F.col("_upto"))).alias("_at", "_x"))
    rows = rows.select(*columns, "_upto", "_at", F.xxhash64(F.lit(level), "_x").alias("key"))
    for _ in range(level - 1):
        rows = rows.select(*columns, "_upto", "_at", "key", F.posexplode(F.slice("ranks", F.col("_at") + 2, F.greatest(F.col("_upto") - F.col("_at") - 1, F.lit(0)))).alias("_off", "_x"))
        rows = rows.select(*columns, "_upto", (F.col("_at") + 1 + F.col("_off")).alias("_at"), F.xxhash64("key", "_x").alias("key"))
    return rows.select(*columns, "key")


def _both_keys(asking: DataFrame, right: DataFrame, width: int, needs: list[int]) -> tuple[DataFrame, DataFrame]:
    """Keys of names and candidates; a name that may share fewer than ``width`` bigrams has combinations of as many."""
    one, two = None, None
    for level in sorted({min(width, n) for n in needs}):
        mine, theirs = _keys(asking.filter(F.least("_need", F.lit(width)) == level), level), _keys(right, level)
        one, two = (mine, theirs) if one is None else (one.unionByName(mine), two.unionByName(theirs))
    return one, two


def _best(waiting: DataFrame, right: DataFrame, size: int, threshold: float) -> DataFrame | None:
    """(name, match, similarity) of the names with a candidate of the threshold; None if no name can have one."""
    asking = waiting.withColumn("_need", _needed(threshold)).filter(F.size("ranks") >= F.col("_need"))
    needs = {r["_need"]: r["n"] for r in asking.groupBy("_need").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length of names
    if not needs or not size:
        return None
    number = sum(needs.values())
    right = right.withColumn("_need", _needed(threshold))
    width = 1
    if number * size > FEW_PAIRS:
        while True:
            one, two = _both_keys(asking, right, width, list(needs))
            pairs = two.select("key").join(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").agg(F.sum("n")).first()[0] or 0
            if pairs <= PAIRS_PER_ROW * (number + size) or width >= min(WIDEST, max(needs)):
                break
            upto = F.least(F.size("ranks"), F.size("ranks") - F.col("_need") + width + 1)
            choices = F.lit(1.0)
            for i in range(width + 1):
                choices = choices * F.greatest(upto - i, F.lit(0)) / (i + 1)
            if (right.agg(F.sum(choices)).first()[0] or 0) > KEYS_PER_ROW * size:
                break
            width += 1
    one, two = _both_keys(asking, right, width, list(needs))
    two = two.select("key", "candidate", F.col("size").alias("size2"), F.col("ranks").alias("ranks2"))
    sizes_allow = 2 * F.least("size", "size2") >= threshold * (F.col("size") + F.col("size2")) - 1e-9
    scored = one.join(two, "key").filter(sizes_allow).select(
        "name", "candidate", (2 * F.size(F.array_intersect("ranks", "ranks2")) / (F.col("size") + F.col("size2"))).alias("similarity"))
    best = scored.filter(F.col("similarity") >= threshold).groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "candidate")).alias("b"))
    return cut_lineage(best.select("name", F.col("b.candidate").alias("match"), (-F.col("b.s")).alias("similarity")))


def best_mapping(by_text: Column, similarity: Column, by_place: Column, distance: Column, near_m: float = 5000) -> Column:
    """Exact text match, else the match both ways agree on, else a near place, else null."""
    return (F.when(similarity >= 1, by_text).when(by_text == by_place, by_text)
            .when(distance < near_m, by_place))
