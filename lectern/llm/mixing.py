"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

The mix takes `total` words in all, shared over the sources by weight; no source
gives more than `max_copies` times its words, and what a source cannot give is
shared again by weight among the others.  Within a source every document is
expected `e` times, e = target / words of the source (times its relative weight,
where documents carry weights).  floor(e) copies are certain.  For the rest
p = e - floor(e), each document gets the Pareto ranking number

    q = (u / (1 - u)) / (p / (1 - p)),    u uniform from a hash of doc_id,

and the documents with the smallest q are taken.  The sample's size is fixed in
words: the order is taken up to the source's target, and the gap that the last
document would overshoot is filled from the next `FILL` documents of the order,
each taken if it still fits, and one more if that comes nearer to the target.
As long as the room left then is at least the source's mean size, documents larger
than it are set aside, and the next cut is found in the rest of the order alike.

Finding the cut needs no global sort: ranking numbers fall into up to
`SIDE * SIDE` fixed slices of (0, 1) per source, the word sums of slices give the slice in which the
cut lies, and only that slice's documents are numbered.

Defined results: null text has size 0; a source of size 0 has target 0; null is
a source of its own, last in the order; rows with an equal doc_id draw equal
numbers and are ordered by text hash, rows without one draw by their text; of rows that are
equal in both as many are taken as the target leaves room for; an empty table gives no rows; only
doc_id, text, source (and the weight column) are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import prepare, small, stored, word_count

WEIGHTS = (3, 1, 2)
FACTOR = 1.5
MAX_COPIES = 2
SIDE = 256            # a source has SIDE to SIDE * SIDE slices, found by two steps of at most SIDE rows
FILL = 256
MANY_SOURCES = 20_000  # tables with one row per source are broadcast up to so many rows, beyond that shuffled
SEED = 42


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs): water-filling in closed form.

    Sources sorted by cap / weight reach their cap in that order as the common
    level rises, so the level is known once the number of capped sources is; one
    row per source, so the single-partition windows are small.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights)).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(factor) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(rising))
    # the first source in rising order that stays below its cap sets the level for it and all after it
    below = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("nth"))
    s = s.withColumn("level", F.min_by("level", below).over(whole))
    return s.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the md5 of the seed and the key (a string); the same on every run."""
    text = F.concat_ws(":", F.lit(str(seed)), key)
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _levels(sized: DataFrame, targets: DataFrame, weighted: bool, max_copies: int) -> DataFrame:
    """Adds c to `targets`: a document is expected min(max_copies, c * dw) times, dw its relative weight.

    Without document weights (dw = 1) c is target / source_size.  With them c
    rises until the documents below the cap carry what is left; each pass is an
    aggregate by source, and it ends when no further document reaches the cap.
    A source whose documents all weigh nothing gives nothing.
    """
    if not weighted:
        return targets.withColumn("c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    level, capped = targets.withColumn("c", F.lit(0.0)), -1
    while True:
        at = _with(sized, level)
        full = F.col("c") * F.col("dw") >= max_copies
        now = at.where(full).count()
        if now == capped:
            return level
        capped = now
        held = F.sum(F.when(full, F.col("size") * max_copies).otherwise(0))
        free = F.sum(F.when(~full, F.col("size") * F.col("dw")).otherwise(0.0))
        c = at.groupBy("source").agg(F.when(free > 0, (F.max("target") - held) / free).otherwise(F.max("c")).alias("c"))
        level = stored(_with(targets, c), "levels")


def _cut(sums: DataFrame, left: DataFrame) -> DataFrame:
    """(source, k, room): the first k of `sums` (source, k, words) whose running sum passes `left`
    (source, left), and what is left before it.  At most SIDE rows of a source come here."""
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("k")))
    return _with(run, left).where("upto > left").groupBy("source").agg(
        F.min(F.struct("k", (F.col("left") - (F.col("upto") - F.col("words"))).alias("room"))).alias("c")) \
        .select("source", "c.*")


def _with(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Joins one row per source to `rows`, null being a source; broadcast while there are few sources."""
    right = small(per_source.withColumnRenamed("source", "_s"), MANY_SOURCES)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _sized(docs: DataFrame, weight: str | None) -> DataFrame:
    dw = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    return docs.select("doc_id", F.xxhash64("text").alias("th"), _draw_key(F.col("doc_id"), F.col("text")).alias("draw"), "source",
                       word_count(F.col("text")).alias("size"), dw.alias("dw"))


def _draw_key(doc_id: Column, text: Column) -> Column:
    """What a document's random number is made of: its doc_id, or the text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def _ranked(sized: DataFrame, per_source: DataFrame, max_copies: int, seed: int) -> DataFrame:
    """Adds the source's columns, whole (certain copies), rank (in (0, 1); null: not drawn) and slice."""
    rows = _with(sized, per_source)
    e = F.least(F.lit(float(max_copies)), F.col("c") * F.col("dw"))
    rows = rows.withColumn("whole", F.floor(e)).withColumn("p", e - F.floor(e))
    # q is taken relative to the source's mean odds, so that q / (1 + q) spreads over (0, 1)
    flat = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.greatest(F.least(flat - F.floor(flat), F.lit(0.999)), F.lit(0.001))
    q = _odds(uniform(F.col("draw"), seed)) / _odds(F.col("p")) * _odds(mean)
    slices = SIDE * F.least(F.ceil(F.col("n_docs") / (SIDE * 32)), F.lit(SIDE))
    draws = (F.col("p") > 1e-12) & (F.col("size") > 0)
    return rows.withColumn("rank", F.when(draws, q / (1 + q))).withColumn("slice", F.floor(F.col("rank") * slices)).drop("p")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, max_copies: int = MAX_COPIES,
         weight: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What decides the mix: (source rows with targets and cuts, the documents picked at the cuts, all sizes); stored."""
    prepare(docs.sparkSession)
    sized = stored(_sized(docs, weight), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = stored(source_targets(totals, weights, factor, max_copies), "targets")
    targets = stored(_levels(sized, targets, weight is not None, max_copies), "expected")
    rows = _ranked(sized, targets, max_copies, seed)
    # what certain copies leave of each target, and the slice in which the order reaches it: by SIDE slices, then within
    sums = stored(rows.groupBy("source", "slice").agg(
        F.sum("size").alias("words"), F.count("*").alias("n"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target")), "slices")
    left = stored(sums.groupBy("source").agg((F.max("target") - F.sum("certain")).alias("left")), "left")
    sums = sums.where("slice is not null").select("source", "slice", "words", "n")
    cut = _bounds(sums, left)
    base = _with(targets, cut, "left")
    picked, later = _picked(_ranked(sized, base, max_copies, seed))
    base = stored(base.drop("last", "room").withColumn("bands", F.lit(None).cast(_bands_type(sized))), "bounds")
    later = stored(later, "later")
    parts, ended = [picked], None
    while later.take(1):
        parts_of, later, base, done = _again(sized, base, later, max_copies, seed)
        parts.append(parts_of)
        ended = done if ended is None else ended.unionAll(done)
    if ended is None:
        return base, picked, sized
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionAll(p)
    picked = stored(_tallied(picked), "picked")
    # one more, the smallest left, in sources that went on
    left = _with(_copies(sized, base, picked, max_copies, seed), ended.select("source", F.col("room").alias("gap")))
    one = left.where("rank is not null and copies = whole and size < 2 * gap and k is not null") \
        .groupBy("source").agg(F.min(F.struct("size", "rank", "doc_id", "th")).alias("m")).select("source", "m.doc_id", "m.th", F.lit(1).cast("long").alias("rows"))
    return base, stored(_tallied(picked.unionAll(one)), "picked"), sized


def _tallied(picked: DataFrame) -> DataFrame:
    """(source, doc_id, th, rows): how many of the rows that are equal in these are picked."""
    return picked.groupBy("source", "doc_id", "th").agg(F.sum("rows").alias("rows"))


def _bounds(sums: DataFrame, left: DataFrame) -> DataFrame:
    """(source, k, room, last) from (source, slice, words, n) and (source, left): the slice in which the order passes
    `left`, what is left before it, and the last slice that holds one of the next FILL documents; none if it never does."""
    side = F.floor(F.col("slice") / SIDE)
    coarse = stored(_cut(sums.groupBy("source", side.alias("k")).agg(F.sum("words").alias("words")), left), "coarse")
    fine = _with(sums, coarse).where(side == F.col("k")).select("source", F.col("slice").alias("k"), "words")
    cut = stored(_cut(fine, coarse.select("source", F.col("room").alias("left"))), "cut")
    # the slices after it that hold the next FILL documents of the order
    after = _with(sums, cut).where("slice > k and slice <= k + %d" % SIDE).withColumn(
        "upto", F.sum("n").over(Window.partitionBy("source").orderBy("slice"))).where(F.col("upto") - F.col("n") < FILL)
    cut = _with(cut, after.groupBy("source").agg(F.max("slice").alias("last")), "left")
    return stored(cut.select("source", "k", "room", F.coalesce("last", "k").alias("last")), "cut")


def _bands_type(sized: DataFrame) -> str:
    """A band: documents after a place in the order and before a slice, of at most a size, are taken."""
    return f"array<struct<after:struct<rank:double,doc_id:{sized.schema['doc_id'].dataType.simpleString()},th:bigint>,k:bigint,most:double>>"


PLACE = ("rank", "doc_id", "th")


def _again(sized: DataFrame, base: DataFrame, later: DataFrame, max_copies: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Goes on in sources `later` (source, room, after) that have room left, past the place `after`, with documents of
    at most the room: (documents picked at the new cuts, sources that still have room, source rows with the bands of
    this round, (source, room) of those that end here); stored."""
    rows = _with(_ranked(sized, base, max_copies, seed).drop("k"), later)
    rows = rows.where("rank is not null and size <= room").where(F.struct(*PLACE) > F.col("after")).drop("room")
    rows = stored(rows.select("source", "slice", "rank", "doc_id", "th", "size", "source_size", "n_docs"), "eligible")
    sums = stored(rows.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "slices")
    cut = _bounds(sums, later.select("source", F.col("room").alias("left")))
    near = _with(rows, cut)
    picked, more = _picked(near)
    more, picked = stored(more, "later"), stored(picked, "picked-again")
    band = F.struct(F.col("after"), F.col("bk").cast("long").alias("k"), F.col("band_room").cast("double").alias("most"))
    new = _with(later.withColumnRenamed("room", "band_room"), cut.select("source", F.col("k").alias("bk")), "left").select("source", F.array(band).alias("new"))
    base = _with(base, new, "left").withColumn("bands", F.when(F.col("new").isNull(), F.col("bands")).otherwise(
        F.concat(F.coalesce("bands", F.array().cast(_bands_type(sized))), F.col("new").cast(_bands_type(sized))))).drop("new")
    base = stored(base, "bounds")
    # what this round took, in sources that do not go on
    whole = _with(sums, cut.select("source", F.col("k").alias("bk")), "left").where("bk is null or slice < bk").groupBy("source").agg(F.sum("words").alias("words"))
    at = _with(rows.select("source", "doc_id", "th", "size"), later.select("source"))
    hit = picked.select(F.col("source").alias("ps"), F.col("doc_id").alias("pd"), F.col("th").alias("pt"))
    at = at.join(hit, F.col("source").eqNullSafe(F.col("ps")) & F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("th") == F.col("pt")), "left_semi")
    at = at.groupBy("source").agg(F.sum("size").alias("at"))
    done = _with(_with(later, whole, "left"), at, "left").select("source", (F.col("room") - F.coalesce("words", F.lit(0)) - F.coalesce("at", F.lit(0))).alias("room"))
    goes_on = more.select(F.col("source").alias("_m"))
    done = stored(done.join(goes_on, F.col("source").eqNullSafe(F.col("_m")), "left_anti"), "ended")
    return picked, more, base, done


def _fill(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each source's next documents (room, mean, rank, doc_id, th, size; at most FILL), those that still fit, in
    order, and one that does not if that leaves the sum nearer to the target; and (source, room, after) of the sources
    that go on behind their last one instead, as the room is not under the mean size."""
    zero = F.struct(F.col("room").alias("room"), F.array().cast("array<int>").alias("got"))
    nexts = rest.groupBy("source").agg(F.max("room").alias("room"), F.max("mean").alias("mean"),
                                       F.array_sort(F.collect_list(F.struct("rank", "doc_id", "th", "size"))).alias("next"))
    step = lambda acc, i: F.when(F.get("next", i)["size"] <= acc["room"], F.struct(
        (acc["room"] - F.get("next", i)["size"]).alias("room"), F.concat(acc["got"], F.array(i)).alias("got"))).otherwise(acc)
    places = F.sequence(F.lit(0), F.size("next") - 1)
    nexts = nexts.withColumn("f", F.aggregate(places, zero, step))
    # one more, the smallest left, if the mix then comes nearer to its target from above
    nearer = F.array_min(F.transform(
        F.filter(places, lambda i: (F.get("next", i)["size"] < 2 * F.col("f.room")) & ~F.array_contains("f.got", i)),
        lambda i: F.struct(F.get("next", i)["size"].alias("size"), i.alias("i"))))["i"]
    goes_on = (F.size("next") >= FILL) & (F.col("f.room") >= F.col("mean"))
    last = F.element_at("next", -1)
    later = nexts.where(goes_on).select("source", F.col("f.room").alias("room"), F.struct(*[last[c].alias(c) for c in PLACE]).alias("after"))
    taken = F.when(goes_on | nearer.isNull(), F.col("f.got")).otherwise(F.concat("f.got", F.array(nearer)))
    return nexts.select("source", F.explode(F.transform(taken, lambda i: F.get("next", i))).alias("g")).select("source", "g.doc_id", "g.th"), later


def _picked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, doc_id, th) of the documents that fit before the cut or fill the gap, from the slices around it, stored;
    and the sources that go on (see `_fill`)."""
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "th")
    near = rows.where("slice >= k and slice <= last").withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)).alias("mean")
    near = stored(near.select("source", "rank", "doc_id", "th", "size", "room", "run", mean), "near")
    head = near.where("run <= room")
    used = head.groupBy("source").agg(F.max("run").alias("used"))
    rest = near.where("run > room").withColumn("n", F.row_number().over(order)).where(F.col("n") <= FILL)
    rest = _with(rest, used, "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
    filled, later = _fill(rest)
    return stored(_tallied(head.select("source", "doc_id", "th").unionAll(filled).withColumn("rows", F.lit(1).cast("long"))), "picked"), later


def _copies(sized: DataFrame, per_source: DataFrame, picked: DataFrame, max_copies: int, seed: int) -> DataFrame:
    """Adds copies: the certain ones, and one more for what comes before the cut, is in a band or was picked at a cut.

    Of equal rows as many as were picked get one more; only rows of keys that are picked in part are numbered.
    """
    rows = _ranked(sized, per_source, max_copies, seed)
    p = small(picked.select(F.col("source").alias("ps"), F.col("doc_id").alias("pd"), F.col("th").alias("pt"), F.col("rows").alias("hits")), MANY_SOURCES)
    same = F.col("source").eqNullSafe(F.col("ps")) & F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("th") == F.col("pt"))
    band = F.exists("bands", lambda b: (F.struct(*PLACE) > b["after"]) & (b["k"].isNull() | (F.col("slice") < b["k"])) & (F.col("size") <= b["most"]))
    sure = F.col("rank").isNotNull() & (F.col("k").isNull() | (F.col("slice") < F.col("k")) | F.coalesce(band, F.lit(False)))
    rows = rows.join(p, same, "left").drop("ps", "pd", "pt").withColumn("_sure", sure).withColumn("_hit", F.col("rank").isNotNull() & F.col("hits").isNotNull() & ~F.col("_sure"))
    alone = rows.where("not _hit").withColumn("copies", F.col("whole") + F.col("_sure").cast("long"))
    nth = F.row_number().over(Window.partitionBy("source", "doc_id", "th").orderBy("th"))
    few = rows.where("_hit").withColumn("copies", F.col("whole") + (nth <= F.col("hits")).cast("long"))
    return alone.unionAll(few).drop("_sure", "_hit", "hits")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, max_copies: int = MAX_COPIES,
        weight: str | None = None, seed: int = SEED) -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target, copies, taken (words)."""
    per_source, picked, sized = plan(docs, weights, factor, max_copies, weight, seed)
    return _copies(sized, per_source, picked, max_copies, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, max_copies: int = MAX_COPIES,
          weight: str | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken.  The texts are not shuffled."""
    per_source, picked, _ = plan(docs, weights, factor, max_copies, weight, seed)
    # every column of the row travels in one struct, so that no name can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = whole.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("th"),
                         _draw_key(F.col("row.doc_id"), F.col("row.text")).alias("draw"), F.col("row.source").alias("source"),
                         word_count(F.col("row.text")).alias("size"), (F.col(f"row.{weight}") if weight else F.lit(1.0)).alias("dw"))
    rows = _copies(parts, per_source, picked, max_copies, seed).where("copies > 0")
    return rows.select("row", F.explode(F.expr("sequence(1, int(copies))"))).select("row.*")


def op2_mix(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size * 2 AS DOUBLE) AS cap FROM sums),
rising AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, coalesce(first_level * w, cap)) AS target
  FROM rising, (SELECT arg_min(lvl, nth) AS first_level FROM rising WHERE lvl * w <= cap)),
expected AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, floor(e) AS whole, e - floor(e) AS p,
         (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u,
         greatest(least(e - floor(e), 0.999::DOUBLE), 0.001::DOUBLE) AS m FROM expected),
ranked AS (
  SELECT *, CASE WHEN p > 1e-12 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) * (m / (1 - m)) END AS q FROM drawn),
lefts AS (SELECT source, max(target) - sum(whole * size) AS left_over FROM ranked GROUP BY source),
runs AS (
  SELECT r.*, l.left_over, sum(size) OVER (PARTITION BY r.source ORDER BY q / (1 + q), doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM ranked r JOIN lefts l ON r.source IS NOT DISTINCT FROM l.source WHERE q IS NOT NULL),
gaps AS (SELECT source, any_value(left_over) - coalesce(max(run) FILTER (run <= left_over), 0) AS room FROM runs GROUP BY source),
tail AS (
  SELECT source, doc_id, size, row_number() OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id) AS n
  FROM runs WHERE run > left_over QUALIFY n <= 256),
fill AS (
  SELECT source, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(room AS DOUBLE) AS room FROM gaps
  UNION ALL
  SELECT f.source, t.n, CASE WHEN t.size <= f.room THEN t.doc_id END, CASE WHEN t.size <= f.room THEN f.room - t.size ELSE f.room END
  FROM fill f JOIN tail t ON t.source IS NOT DISTINCT FROM f.source AND t.n = f.n + 1),
ends AS (SELECT source, arg_max(room, n) AS room FROM fill GROUP BY source),
nearer AS (
  SELECT t.doc_id FROM tail t JOIN ends e ON t.source IS NOT DISTINCT FROM e.source
  WHERE t.size < 2 * e.room AND t.doc_id NOT IN (SELECT doc_id FROM fill WHERE doc_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY t.source ORDER BY t.size, t.n) = 1),
picked AS (
  SELECT doc_id FROM runs WHERE run <= left_over UNION SELECT doc_id FROM fill WHERE doc_id IS NOT NULL
  UNION SELECT doc_id FROM nearer)
SELECT r.doc_id, size, source_size, target,
       CAST((whole + CASE WHEN q IS NOT NULL AND r.doc_id IN (SELECT doc_id FROM picked) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked r
"""
