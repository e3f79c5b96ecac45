"""Fuzzy removal of repeated lines, in DataFrame operations only.

Lines are normalised (lower case, digits alike, no marks, single spaces) and get two 64-bit SimHashes, of their
words and of their pairs of neighbouring words. The first is cut into six blocks; two lines that differ in at most
four bits agree in two blocks at least, and most that differ in more do. Every pair of blocks is a bucket key. Inside
a bucket lines are compared with one centre, and where groups stay apart with the rest of the bucket inside the join,
which lets only pairs near in both SimHashes and in length out. They are verified by edit similarity of the normalised
lines, with a small band first, as it settles most; linked lines form groups, and of every group the first occurrence
(smallest doc_id, then position) stays.

Documents are written once, bucketed by the task that read them. Counting words per line, reading single lines
back and deleting lines then join on that bucket, so whole texts are never shuffled. Lines are normalised and hashed
once; what follows works on their hashes.

Defined results: lines without a letter or digit are kept and take no part; null text stays null; a document may
lose all its lines and has empty text then; a line that repeats within one document is removed there as well;
rows that repeat are documents of their own; columns named like results are replaced; line feeds end lines.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.llm import common
from stopwise.llm.common import table
from stopwise.llm.jaccard import apart
from stopwise.operators.graph import connected_groups
from stopwise.session import fresh_path

SIMILARITY = 0.8
BITS = 12  # most different bits of a candidate pair in the SimHash of words
PAIR_BITS = 18  # and in that of word pairs
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit and bits
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…·•–—"
SPACES = "\t\x0b\f\r"
KEYS = tuple(enumerate(combinations(BLOCKS, 2)))  # number and blocks of a bucket key
PASSES = 3  # the keys are dealt in so many shuffles, one after the other
ROUNDS = (1, None)  # pairs between two groups that are looked at in a round; the last one takes all
FULL = 256  # lines of a bucket that are all compared with each other
RARE = r"[^\x{0}-\x{FFFF}]"  # characters of two UTF-16 units
PAIRS_PER_TASK = 2000  # whose edit similarity a task finds: their texts are small, their work is not
LINE, SAME = ("_part", "_row", "pos"), ("doc_id", "h1", "h2")  # what names a line, what goes with it
CHUNK = 7  # words that are counted in lanes of four bits, the last of which is signed
GIANT = CHUNK << 11  # words that are counted in lanes of sixteen bits
LANES = {4: 0x1111111111111111, 16: 0x000F000F000F000F, 32: 0x0000FFFF0000FFFF}  # what of a counter a lane of this width takes
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HUGE = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _with_settings(spark: SparkSession, settings: dict[str, str]):
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``common.stored``; what the job shuffled leaves the disk when it ends."""
    with _with_settings(df.sparkSession, {CLEANUP: "true"}):
        return common.stored(df, name)


def normal_words(line: Column) -> Column:
    """Words of the normalised line: blanks at either end and between words do not count."""
    plain = F.translate(F.lower(line), "0123456789" + SPACES + MARKS, "0" * 10 + " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def _bucketed(docs: DataFrame) -> DataFrame:
    """Documents with ``_row`` and ``_part``, stored in buckets of ``_part``: joins and groups on it need no shuffle."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # a bucket may hold a part of the join keys
    row = F.monotonically_increasing_id()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("_row")).withColumn("_part", F.shiftright("_row", 33).cast("int"))
    name = f"documents_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "_part").option("path", fresh_path(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _lines(docs: DataFrame) -> DataFrame:
    """(_part, _row, doc_id, pos, words, h1, h2) of every line."""
    lines = docs.filter("text is not null").select("_part", "_row", F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    named = lines.select("_part", "_row", "doc_id", "pos", normal_words(F.col("line")).alias("words"))
    return named.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")})


def _simhashes(lines: DataFrame, giants: DataFrame | None = None) -> DataFrame:
    """(_part, _row, doc_id, pos, h1, h2, size, sim, pairs): one row per line that has a word.

    A row of CHUNK words sums the bits of their hashes in lanes of four bits, by expressions; the sums of a line are added up in lanes
    of sixteen bits, which hold GIANT words. Longer lines go on to lanes of 32 bits; ``giants`` are lines among which all of these are.
    All sums stay inside the task.
    """
    wide = _line_sums(lines if giants is None else giants, f"size(words) > {GIANT}")
    counters = [F.sum(F.expr(f"shiftrightunsigned({x}{i % 16}, {i // 16 * 16}) & {LANES[32]}L")).alias(f"{x}{i}") for x in "uv" for i in range(32)]
    wide = wide.groupBy(*LINE).agg(*[F.max(c).alias(c) for c in (*SAME, "n")], F.sum("letters").alias("letters"), *counters)
    named = [*LINE, *SAME, (F.col("letters") + F.col("n") - 1).alias("size")]
    signed = lambda sums, width: sums.select(*named, _majority("u", width).alias("sim"), _majority("v", width).alias("pairs"))
    return signed(_line_sums(lines, f"size(words) between 1 and {GIANT}"), 16).unionByName(signed(wide, 32))


def _line_sums(lines: DataFrame, chosen: str) -> DataFrame:
    """Counters of the bits of the hashes of words (u) and pairs of words (v), per GIANT words of a chosen line: counter i has bits i, i + 16, i + 32 and i + 48."""
    numbers = F.expr(f"if({chosen}, sequence(0, (size(words) - 1) div {CHUNK}), null)")
    # a filter of lines, or the one that Spark puts before a plain explode, would make their words once more
    chunks = lines.select(*LINE, *SAME, "words", F.size("words").alias("n"), F.explode_outer(numbers).alias("chunk")).filter("chunk is not null")
    words = chunks.select(*LINE, *SAME, "n", "chunk", *[F.expr(f"get(words, chunk * {CHUNK} + {j})").alias(f"w{j}") for j in range(CHUNK + 1)])
    letters = F.expr(" + ".join(f"coalesce(length(w{j}), 0)" for j in range(CHUNK)))
    hashes = [F.expr(f"if(w{j} is null, 0L, xxhash64({h}))").alias(f"{x}{j}") for j in range(CHUNK) for x, h in (("u", f"w{j}"), ("v", f"2, w{j}, w{j + 1}"))]
    hashed = words.select(*LINE, *SAME, "n", "chunk", letters.alias("letters"), *hashes)
    sums = lambda x, i: F.expr(" + ".join(f"(shiftrightunsigned({x}{j}, {i}) & {LANES[4]}L)" for j in range(CHUNK))).alias(f"{x}_{i}")
    summed = hashed.select(*LINE, *SAME, "n", F.expr(f"chunk div {GIANT // CHUNK}").alias("part"), "letters", *[sums(x, i) for x in "uv" for i in range(4)])
    counters = [F.sum(F.expr(f"shiftrightunsigned({x}_{i % 4}, {i // 4 * 4}) & {LANES[16]}L")).alias(f"{x}{i}") for x in "uv" for i in range(16)]
    return summed.groupBy(*LINE, "part").agg(*[F.max(c).alias(c) for c in (*SAME, "n")], F.sum("letters").alias("letters"), *counters)


def _majority(x: str, width: int) -> Column:
    """The bits that more than half of n words have, from counters in lanes of ``width`` bits: adding what a half lacks sets the last bit but one of a lane."""
    ones = sum(1 << k for k in range(0, 64, width))
    bits = []
    for i in range(width):
        flags = f"(({x}{i} + ({1 << width - 2}L - n div 2 - 1) * {ones}L) & {ones << width - 2}L)"
        bits.append(f"shiftrightunsigned({flags}, {width - 2 - i})" if i <= width - 2 else f"shiftleft({flags}, {i - width + 2})")
    return F.expr(" | ".join(bits))


def _bands(lines: DataFrame, chosen=KEYS) -> DataFrame:
    """(bucket, node, sim, pairs, size) of every chosen pair of blocks."""
    block = lambda b: F.shiftrightunsigned("sim", b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))
    keys = [F.lit(t << 22).cast("bigint").bitwiseOR(F.shiftleft(block(a), 11)).bitwiseOR(block(b)) for t, (a, b) in chosen]
    known = lines.filter("sim is not null and pairs is not null and size is not null")  # all are: named, as both sides of a join are one shuffle then
    return known.select(F.explode(F.array(*keys)).alias("bucket"), F.col("_row").alias("node"), "sim", "pairs", "size")


def _side(lines: DataFrame, node: str, n: int) -> DataFrame:
    return lines.select(F.col("_row").alias(node), F.col("sim").alias(f"sim{n}"), F.col("pairs").alias(f"pairs{n}"), F.col("size").alias(f"size{n}"))


def _close(two: str = "{}2") -> Column:
    """Sides 1 and 2 are near in both SimHashes and their lengths allow the similarity; ``two`` is how columns of side 2 are named."""
    bits = lambda name: F.bit_count(F.col(f"{name}1").bitwiseXOR(F.col(two.format(name))))
    sizes = "size1", two.format("size")
    return (bits("sim") <= BITS) & (bits("pairs") <= PAIR_BITS) & (F.least(*sizes) >= SIMILARITY * F.greatest(*sizes))


def _met(lines: DataFrame, chosen=KEYS) -> DataFrame:
    """(a, b, crowded): near lines of one bucket. Of a bucket of more than FULL lines these are the lines near its centre, with the bucket;
    there the centre comes with itself as well.
    """
    bands, own = _bands(lines, chosen), W.partitionBy("bucket")
    one = bands.withColumns({"n": F.count(F.lit(1)).over(own), "centre": F.min("node").over(own)}).filter(f"n > 1 and (n <= {FULL} or node = centre)")
    one = one.select("bucket", "node", F.when(F.col("n") > FULL, F.col("bucket")).alias("crowded"), *[F.col(c).alias(f"{c}1") for c in ("sim", "pairs", "size")])
    two = bands.alias("two")  # no column gets another name, so that both sides read one shuffle
    once = (F.col("one.node") < F.col("two.node")) | (F.col("crowded").isNotNull() & (F.col("one.node") == F.col("two.node")))
    met = one.alias("one").hint("merge").join(two, (F.col("one.bucket") == F.col("two.bucket")) & once & _close("two.{}"))
    return met.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"), "crowded").distinct()


def _between(pairs: DataFrame, groups: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs whose lines are in different groups, ``most`` at most for every two groups."""
    label = lambda node: groups.select(F.col("node").alias(node), F.col("label").alias(f"label_{node}"))
    placed = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("one"), F.coalesce("label_b", "b").alias("two"))
    apart_ = placed.filter("one <> two")
    if most is None:
        return apart_.select("a", "b")
    dealt = apart_.groupBy(F.least("one", "two"), F.greatest("one", "two"), F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("part"))
    return dealt.agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")


def _near_outsiders(members: DataFrame, groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Near pairs of one bucket in different groups, apart from its largest group's inside and from its centre.

    Members meet inside the join and only near ones leave it.
    """
    placed = apart(members, groups)
    one = placed.filter("label <> main").join(_side(lines, "node", 1), "node")
    two = placed.select("bucket", F.col("node").alias("other"), F.col("label").alias("label2")).join(_side(lines, "other", 2), "other")
    once = (F.col("label2") == F.col("main")) | (F.col("node") < F.col("other"))  # outsiders meet from both sides
    met = one.join(two.withColumnRenamed("bucket", "bucket2"), (F.col("bucket") == F.col("bucket2")) & (F.col("label") != F.col("label2")) & once & _close())
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _similar(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose normalised lines have the edit similarity; only lines of pairs are read back."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct().join(lines.select("_row", "at"), "_row")
    wanted = wanted.select(F.col("_row").alias("node"), F.shiftright(F.col("at._row"), 33).cast("int").alias("_part"), F.col("at._row").alias("_row"), F.col("at.pos").alias("pos"))
    text = F.array_join(normal_words(F.element_at(F.split("text", "\n"), F.col("pos") + 1)), " ")
    texts = docs.select("_part", "_row", "text").join(wanted, ["_part", "_row"]).select("node", text.alias("norm"))
    texts = stored(texts.withColumn("rare", F.col("norm").rlike(RARE)), "line_texts")
    side = lambda node, n: texts.select(F.col("node").alias(node), F.col("norm").alias(f"norm{n}"), F.col("rare").alias(f"rare{n}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").withColumn("most", F.floor((1 - SIMILARITY) * F.greatest(F.length("norm1"), F.length("norm2")) + 1e-9).cast("int"))
    # what both lines begin and end with does not change their distance; the shorter rest is dealt out
    for _ in range(2):
        both = both.withColumn("same", _common_start(F.col("norm1"), F.col("norm2")))
        both = both.withColumns({f"norm{n}": F.reverse(F.expr(f"substring(norm{n}, same + 1)")) for n in (1, 2)})
    both = both.repartition(max(1, -(-pairs.count() // PAIRS_PER_TASK)), "a", "b")
    # a pair is mostly settled by a narrow band, which takes less time; only what is left goes through the whole one
    short = F.greatest(F.length("norm1"), F.length("norm2")) <= F.col("most")
    found = [_within(f"cast(most div {part} as int)") for part in (4, 1)]
    return both.withColumn("similar", short | found[0] | found[1]).filter("similar").select("a", "b")


def _within(most: str) -> Column:
    """The edit distance of norm1 and norm2 is at most so much.

    The library's bounded distance takes less than half the time of Spark's, but counts a character beyond the basic plane
    as two, so lines with one go through Spark's. As Spark holds its value for one that may change, it is not moved below the exchange.
    """
    fast = f"cast(reflect('org.apache.commons.lang3.StringUtils', 'getLevenshteinDistance', norm1, norm2, {most}) as int)"
    return F.expr(f"if(rare1 or rare2, levenshtein(norm1, norm2, {most}), {fast}) >= 0")


def _common_start(one: Column, two: Column) -> Column:
    """Length of the common beginning, up to 2^20 - 1, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(19, -1, -1)])
    shorter = F.least(F.length(one), F.length(two))
    agree = lambda p, step: (p + step <= shorter) & (F.substring(one, p + 1, step) == F.substring(two, p + 1, step))
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when(agree(p, step), p + step).otherwise(p))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Stored (_part, _row, doc_id, pos, h1, h2, size, sim, pairs) of every line of a bucketed table of documents that has a word."""
    with _with_settings(docs.sparkSession, {HUGE: "8000"}):  # the JVM does not compile longer methods
        giants = _lines(docs.filter(f"length(text) > {2 * GIANT}"))  # a word has a letter and a blank
        return stored(_simhashes(_lines(docs), giants), "hashed_lines")


def line_groups(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(h1, h2, kept): every different line of a group of two or more occurrences, and the occurrence that stays."""
    occurrence = F.struct("doc_id", "_row", "pos")
    lines = hashed.groupBy("h1", "h2").agg(
        *[F.max(c).alias(c) for c in ("sim", "pairs", "size")], F.min(occurrence).alias("at"), F.count(F.lit(1)).alias("n"))
    lines = stored(lines.withColumn("_row", F.monotonically_increasing_id()), "lines")
    check = lambda pairs: stored(_similar(pairs, lines, docs), "line_links")
    met = reduce(DataFrame.unionByName, [stored(_met(lines, KEYS[i::PASSES]), "met_lines") for i in range(PASSES)])
    pairs = met.filter("a <> b").select("a", "b").distinct()
    links = check(stored(pairs.groupBy("b").agg(F.min("a").alias("a")), "near_lines"))
    groups = connected_groups(links)
    crowded = met.filter("a = b").select(F.col("crowded").alias("bucket"), "a")
    more = _between(pairs, groups)
    if not crowded.isEmpty():
        members = _bands(lines).select("bucket", "node").join(crowded, "bucket")
        more = more.unionByName(_near_outsiders(members, groups, lines)).distinct()
    for most in ROUNDS:  # one link joins two groups, so the other pairs between them need no look
        more = stored(more, "more_lines")
        if more.isEmpty():
            break
        chosen = more if most is None else stored(_between(more, groups, most), "near_lines")
        links = links.unionByName(check(chosen))
        groups = connected_groups(links)
        more = _between(more.join(chosen, ["a", "b"], "left_anti"), groups)
    grouped = stored(lines.select("_row", "h1", "h2", "at", "n").join(groups.withColumnRenamed("node", "_row"), "_row", "left").filter("n > 1 or label is not null").select(
        "h1", "h2", "at", F.coalesce("label", "_row").alias("label")), "line_groups")
    kept = grouped.groupBy("label").agg(F.min("at").alias("kept"))
    return grouped.join(kept, "label").select("h1", "h2", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs, ``text`` without repeated lines, and ``n_lines`` and ``n_removed``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed", "_row", "_part")]
    carried = docs.select("doc_id", "text") if not others else docs.select(F.struct("doc_id", *others).alias("doc_id"), "text")
    whole = _bucketed(carried)
    own_id = whole if not others else whole.withColumn("doc_id", F.col("doc_id.doc_id"))
    hashed = hashed_lines(own_id)
    groups = stored(line_groups(own_id, hashed), "kept_lines")
    gone = hashed.select("_part", "_row", "pos", "h1", "h2").join(groups, ["h1", "h2"]).filter((F.col("_row") != F.col("kept._row")) | (F.col("pos") != F.col("kept.pos")))
    gone = gone.groupBy("_part", "_row").agg(F.collect_list("pos").alias("gone"))  # at most the lines of one document
    joined = whole.join(gone, ["_part", "_row"], "left").withColumn("_lines", F.split("text", "\n"))  # a column, or each line that stays would split the text again
    lines = F.col("_lines")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at(lines, i + 1)), "\n"))
    named = [F.col("doc_id")] if not others else [F.col("doc_id")[c].alias(c) for c in ("doc_id", *others)]
    out = joined.select(*named, text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    return out.select(*[c for c in docs.columns if c in out.columns and c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op3_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")
