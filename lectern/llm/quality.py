"""Quality rules: one threshold table, compiled into one Spark projection.

Every rule bounds a ratio of counts that Catalyst computes in the row: length,
symbol, stop-word and line ratios.  There is no user function and no exchange.
Windows that repeat are found from their 64-bit hashes, sorted within the row;
two different windows of one text collide with a chance below 1e-9 even at a
million words.

Defined results: null text has no words (all counts 0) and fails; an empty table
gives no rows; repeated rows and equal or null doc_id are judged alike, each on
its own; only doc_id and text are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACES, prepare

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is it that for on with was as at by from be this are or an "
    "le la les de des et un une du en que qui dans est pour par sur au pas avec "
    "der die das und den von zu mit ist im für auf dem ein eine nicht sich als auch "
    "el los las y una con no se su para es del al lo").split()


class Rule(NamedTuple):
    """A ratio of two counts must lie between `least` and `most` (None: no bound)."""

    name: str
    top: str
    bottom: str
    least: float | None
    most: float | None


RULES = (
    Rule("words", "n_words", "one", 50, None),
    Rule("word length", "word_chars", "n_words", 3.0, 10.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.1),
    Rule("stop words to words", "n_stop", "n_words", 0.06, None),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("lines with an ellipsis to lines", "n_ellipsis", "n_lines", None, 0.3),
    Rule("bullet lines to lines", "n_bullets", "n_lines", None, 0.9),
    Rule("repeated windows to words", "n_repeat_words", "n_words", None, 0.5),
)


def counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the counts that rules may name.

    Written as a chain of projections so that an array is made once and read by
    several expressions; Spark runs the chain as one stage without exchange.
    """
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = t.withColumn("w", F.filter(F.split("t", "[" + SPACES + "]+"), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0))
    t = t.withColumn("h", F.when(F.size("w") >= window, F.transform(
        F.slice("w", F.lit(1), F.size("w") - (window - 1)),
        lambda w, i: F.xxhash64(w, *[F.get("w", i + k) for k in range(1, window)]))))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    t = t.withColumn("s", F.when(repeats, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    t = t.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - x, F.lit(window)))),
                          F.lit(0), lambda a, x: a + x)
    folded = F.filter(F.transform("w", lambda w: F.lower(w)), lambda w: w.isin(STOP_WORDS))
    ends = lambda line: F.rtrim(line)
    long = lambda c: c.cast("long")
    made = F.struct(
        F.lit(1).alias("one"), long(F.size("w")).alias("n_words"),
        long(F.length(F.translate("t", SPACES, ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        long(F.size(folded)).alias("n_stop"),
        long(F.size(F.filter("lines", lambda x: ends(x).endswith("...") | ends(x).endswith("…")))).alias("n_ellipsis"),
        long(F.size(F.filter("lines", lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•")))).alias("n_bullets"))
    # behind a generator, so that a later filter on a count does not pull the whole chain into its condition
    return t.select("doc_id", F.explode(F.array(made)).alias("m")).select("doc_id", "m.*")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as one array column.  A ratio over nothing breaks no rule."""
    broken = []
    for r in rules:
        ratio = F.col(r.top) / F.nullif(F.col(r.bottom), F.lit(0))
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | F.coalesce(ratio < r.least, F.lit(False))
        if r.most is not None:
            bad = bad | F.coalesce(ratio > r.most, F.lit(False))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of every row of `docs`, and broken: the rules it breaks."""
    prepare(docs.sparkSession)
    return counts(docs).withColumn("broken", compile_rules(rules))


def op6_quality(docs: DataFrame) -> DataFrame:
    """The query's columns, and the broken rules."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              base.alias("base_failed"), (~base & (F.size("broken") == 0)).alias("kept"), "broken")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    parts = []
    for r in RULES:
        bounds = [f"{r.top}::DOUBLE / nullif({r.bottom}, 0) < {r.least}" if r.least is not None else "",
                  f"{r.top}::DOUBLE / nullif({r.bottom}, 0) > {r.most}" if r.most is not None else ""]
        parts.append(f"CASE WHEN {' OR '.join(b for b in bounds if b)} THEN '{r.name}' END")
    return r"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT id, i, w[i:i + 2] AS win FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
many AS (SELECT id, i FROM wins QUALIFY count(*) OVER (PARTITION BY id, win) > 1),
rep AS (SELECT id, count(DISTINCT p) AS n FROM many, unnest(range(i, i + 3)) AS u(p) GROUP BY id),
c AS (
  SELECT doc_id, 1 AS one, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS n_stop,
         len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis,
         len(list_filter(lines, lambda x: ltrim(x) LIKE '- %' OR ltrim(x) LIKE '* %' OR ltrim(x) LIKE '•%')) AS n_bullets
  FROM t LEFT JOIN rep USING (id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_filter([RULES], lambda x: x IS NOT NULL) AS broken FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND len(broken) = 0 AS kept, broken FROM v
""".replace("STOPS", stops).replace("RULES", ",\n         ".join(parts))


SQL = _sql()
