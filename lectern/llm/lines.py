"""Line deduplication over the suffix array of line ids.

Documents are sequences of line ids (lines without a word stay out).  Suffixes
are ranked by distributed prefix doubling: rank k orders suffixes by their first
2**k lines; rank k + 1 is the rank of the pair (rank k here, rank k 2**k lines
on), by a range sort of the distinct pairs.  Only suffixes whose prefix occurs
again are kept from step to step, so a corpus of mostly unique lines shrinks at
once.  Suffixes with equal first n lines are an interval of the suffix array whose
longest common prefix is at least n; the interval's first suffix in document
order is the first copy of the run, the others are later copies.

A run is deleted from its later copies if it has at least `min_words` words.  The
maximal repeated runs of that size are exactly the unions of the repeated windows
that just reach `min_words` words from their first, or from their last line; the
interval of a window of n lines is found from two ranks that overlap,
(rank k at its start, rank k at its end - 2**k), 2**k <= n < 2**(k+1).

Document order is (doc_id, null first; hash of the text).  Defined results: null
text stays null; rows equal in doc_id and text are one document and are cut alike;
blank lines are never deleted, and do not interrupt a run; a text all of whose lines are
deleted becomes empty; an empty table gives no rows; only doc_id and text are
read.  Lines are equal if two 64-bit hashes of them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import prepare, stored, word_count

MIN_WORDS = 10
DOC = ["did", "th"]


def _keys() -> dict[str, Column]:
    return {"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), "th": F.xxhash64("doc_id", "text")}


def line_table(docs: DataFrame) -> DataFrame:
    """(did, th, ln, i, a, b, words): line number, number among the lines with a word, two hashes, words."""
    line = lambda x, j: F.struct(j.alias("ln"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), word_count(x).alias("words"))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["words"] > 0)
    return docs.select(*[c.alias(k) for k, c in _keys().items()], F.posexplode(lines).alias("i", "x")).select(*DOC, "i", "x.*")


def _ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """`rows` whose values of `by` occur again, with their rank r: greater values, greater rank.

    The distinct values are range-partitioned and sorted; a row's number across
    sorted partitions is the rank.  It is stored before use, so every reader sees
    the same ranks.
    """
    again = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    ranks = stored(again.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), f"{label}-ranks")
    return rows.join(ranks, by).drop(*by)


def prefix_doubling(lines: DataFrame, longest: int, tables: list[DataFrame] | None = None) -> list[DataFrame]:
    """[rank tables (did, th, i, r) for prefixes of 1, 2, 4, ... up to `longest` lines]; stored.

    A suffix is in a table if its prefix of that length lies in its document and occurs again.
    `tables` that are there already are not made again.
    """
    tables = list(tables) if tables else [stored(_ranked(lines.select(*DOC, "i", "a", "b"), ["a", "b"], "line"), "rank0")]
    while 2 << (len(tables) - 1) <= longest:
        ahead = 1 << (len(tables) - 1)
        there = Window.partitionBy(*DOC).orderBy("i").rangeBetween(ahead, ahead)
        pairs = tables[-1].withColumn("r2", F.max("r").over(there)).where("r2 is not null").withColumnRenamed("r", "r1")
        tables.append(stored(_ranked(stored(pairs, "pairs"), ["r1", "r2"], f"rank{len(tables)}"), f"rank{len(tables)}"))
    return tables


def windows(lines: DataFrame, ids: DataFrame, min_words: int) -> DataFrame:
    """(did, th, i, n): the windows of repeated lines that just reach `min_words` words, from their first or last line."""
    known = lines.select(*DOC, "i", "words").distinct().join(ids.select(*DOC, "i").distinct(), [*DOC, "i"])
    order = Window.partitionBy(*DOC).orderBy("i")

    def reach(frame, sign: int) -> Column:
        """Lines from here until the sum of words is enough; null if the repeated lines end before."""
        ahead = F.collect_list(F.struct("i", "words")).over(frame)
        ahead = ahead if sign > 0 else F.reverse(ahead)
        step = lambda acc, x: F.when((acc["words"] >= min_words) | (x["i"] != F.col("i") + sign * acc["n"]), acc).otherwise(
            F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x["words"]).alias("words")))
        return F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("words")), step)

    both = known.withColumn("f", reach(order.rowsBetween(0, min_words - 1), 1)).withColumn("b", reach(order.rowsBetween(1 - min_words, 0), -1))
    starts = F.array(F.struct(F.col("i").alias("i"), F.col("f.n").alias("n"), F.col("f.words").alias("words")),
                     F.struct((F.col("i") - F.col("b.n") + 1).alias("i"), F.col("b.n").alias("n"), F.col("b.words").alias("words")))
    return both.select(*DOC, F.explode(starts).alias("w")).where(F.col("w.words") >= min_words).select(*DOC, "w.i", "w.n").distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, ln) of the lines to delete; each line once."""
    prepare(docs.sparkSession)
    lines = stored(line_table(docs), "lines")
    tables = prefix_doubling(lines, 1)
    wins = stored(windows(lines, tables[0], min_words), "windows")
    tables = prefix_doubling(lines, wins.agg(F.max("n")).first()[0] or 1, tables)
    named = None
    for k, ranks in enumerate(tables):
        size = 1 << k
        own = wins.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        at = ranks.distinct()
        level = own.join(at.withColumnRenamed("r", "r1"), [*DOC, "i"]).withColumn("j", F.col("i") + F.col("n") - size) \
            .join(at.select(*DOC, F.col("i").alias("j"), F.col("r").alias("r2")), [*DOC, "j"]).drop("j")
        named = level if named is None else named.unionByName(level)
    # n says which ranks are meant, so (n, r1, r2) names an interval; both sides are stored, so that the join has an
    # exchange of its own on either side and the windows of a common run can be split
    named = stored(named, "named")
    firsts = stored(named.groupBy("n", "r1", "r2").agg(F.min(F.struct(*DOC, "i")).alias("first")), "firsts")
    marked = named.join(firsts, ["n", "r1", "r2"]).where(F.struct(*DOC, "i") > F.col("first")).select(*DOC, "i", "n")
    covered = marked.select(*DOC, F.explode(F.expr("sequence(i, i + n - 1)")).alias("i")).distinct()
    return covered.join(lines.select(*DOC, "i", "ln").distinct(), [*DOC, "i"]).select(*DOC, "ln")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` (all columns, text without the deleted lines) and _deleted: the numbers of those lines, from 0."""
    gone = later_copies(docs, min_words).groupBy(*[F.col(k).alias(f"_{k}") for k in DOC]).agg(F.array_sort(F.collect_list("ln")).alias("_deleted"))
    rows = docs.withColumns({f"_{k}": c for k, c in _keys().items()}).join(gone.hint("merge"), ["_did", "_th"], "left")
    rows = rows.withColumn("_lines", F.split("text", "\n"))
    # the slices between deleted lines
    cuts = F.concat(F.coalesce("_deleted", F.array().cast("array<int>")), F.array(F.size("_lines")))
    kept = F.flatten(F.transform(cuts, lambda d, k: F.slice(F.col("_lines"), F.coalesce(F.get("_deleted", k - 1), F.lit(-1)) + 2,
                                                            d - F.coalesce(F.get("_deleted", k - 1), F.lit(-1)) - 1)))
    text = F.when(F.col("_deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn("_text", text).select(*[F.col("_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                                                 F.coalesce("_deleted", F.array().cast("array<int>")).alias("_deleted"))


def op5_lines(docs: DataFrame) -> DataFrame:
    """doc_id, the text that stays, the numbers of the deleted lines and how many they are."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "text", F.col("_deleted").alias("deleted"), F.size("_deleted").alias("n_deleted"))
