"""Secret scan by fixed patterns and a randomness test battery, in DataFrame operations only.

Patterns find assignments to secret-like names, access keys and hex strings.
Beyond them, every long token is a candidate, and so is every long part of it
between separators (a key behind a path or a prefix).  Each is tested for being
random in the smallest known alphabet that holds its characters:

- chi-squared test of uniform use of the alphabet (Wilson-Hilferty, two-sided);
- runs test of symbols in the lower and upper half of the alphabet;
- serial correlation of successive symbols.

The three p-values are combined (Bonferroni).  Benjamini-Hochberg then decides,
within bands of token length, which candidates are not random, so that at most a
share `FDR` of what is dismissed in a band is expected to be random; short and
long tokens, whose tests differ in power, do not share a cut.  The others are
reported as kind `random`, unless a pattern's span overlaps them; a part is not
reported beside the longer part or token that holds it.  The p-values
enter as counts per band and bin of -log10 p, a table of fixed size.

Positions are running sums of the lengths of matches and of the parts between
them, kept in the row: no exchange carries text.

Defined results: null text is empty; a text without a match has empty span
strings; an empty table gives no rows; repeated rows and equal or null doc_id are
scanned each on its own; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare, stored

# Matches that the length rules keep: with greedy, maximal runs of one class a minimum in the pattern is the same
# as dropping shorter matches afterwards; `assign` cannot be written so and is filtered on its second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 12

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern of the whole token, alphabet in value order, by size; the first that fits is the token's encoding, the last always does.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("hex-", r"^[0-9a-f-]+$", DIGITS + "abcdef-"),
    ("HEX-", r"^[0-9A-F-]+$", DIGITS + "ABCDEF-"),
    ("lower", r"^[a-z]+$", LOWER),
    ("UPPER", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base36-", r"^[0-9a-z_-]+$", DIGITS + LOWER + "-_"),
    ("BASE36-", r"^[0-9A-Z_-]+$", DIGITS + UPPER + "-_"),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("any", r"^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Single characters that may join a key to what stands before or after it; each set gives its own parts.
SEPARATORS = ("[/]", "[/_]", "[/-]", "[+/_-]")
LENGTH = 20  # of a candidate, as in CANDIDATE
FDR = 0.05
BANDS = (20, 24, 32, 40, 48, 64, 96, 160)  # least token length of each band
BINS = 3000                                # of -log10 p, a hundredth each; smaller p fall in the last
CHUNK = 64


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one, from sums of chunks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                         lambda j: total(F.slice(lengths, j * CHUNK + 1, F.lit(CHUNK))))
    before = F.transform(chunks, lambda _, j: total(F.slice(chunks, F.lit(1), j)))
    return F.transform(lengths, lambda _, i: F.get(before, F.floor(i / CHUNK).cast("int"))
                       + total(F.slice(lengths, (i - i % CHUNK) + 1, i % CHUNK)))


def _matches(docs: DataFrame, pattern: str, name: str, group: int = 0) -> DataFrame:
    """Adds column `name`: array of (start, end, s) of the matches in t; s is the text of `group`.

    A chain of projections: each array is made once.
    """
    some = F.col("t").rlike(pattern)
    t = docs.withColumn("_m", F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
    t = t.withColumn("_g", F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))) if group else F.col("_m"))
    t = t.withColumn("_p", F.when(some, F.transform(F.split("t", pattern, -1), lambda p: F.length(p))))
    t = t.withColumn("_l", F.transform("_m", lambda m, i: F.get("_p", i) + F.length(m)))
    t = t.withColumn("_s", _running(F.col("_l")))
    at = lambda m, i: F.get("_s", i) + F.get("_p", i)
    spans = F.transform("_m", lambda m, i: F.struct(at(m, i).alias("start"), (at(m, i) + F.length(m)).alias("end"), F.get("_g", i).alias("s")))
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return t.withColumn(name, F.coalesce(spans, empty)).drop("_m", "_g", "_p", "_l", "_s")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 of the normal distribution (rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _battery(c: DataFrame) -> DataFrame:
    """Adds encoding and p (of being random in it) to candidate rows (token)."""
    fits = F.coalesce(*[F.when(F.col("token").rlike(p), F.struct(F.lit(n).alias("encoding"), F.lit(a).alias("alphabet"))) for n, p, a in ENCODINGS])
    c = c.withColumn("f", fits).select("*", "f.*", F.length("token").alias("n"), F.length("f.alphabet").alias("k"))
    c = c.withColumn("v", F.transform(F.split("token", ""), lambda x: F.instr(F.col("alphabet"), x) - 1))
    c = c.withColumn("v", F.filter("v", lambda x: x >= 0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    n, k = F.col("n"), F.col("k")
    c = c.withColumn("squares", total(F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.pow(F.size(F.filter("v", lambda x: x == s)), F.lit(2.0)))))
    df = k - 1
    chi = F.greatest(F.col("squares") * k / n - n, F.lit(0.0))
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    c = c.withColumn("b", F.transform("v", lambda x: (2 * x >= k).cast("int")))
    c = c.withColumn("n1", F.aggregate("b", F.lit(0), lambda x, y: x + y))
    c = c.withColumn("runs", F.size(F.filter("b", lambda x, i: (i == 0) | (F.get("b", i - 1) != x))))
    n1, n0 = F.col("n1"), n - F.col("n1")
    mu = 2 * n1 * n0 / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when((n1 == 0) | (n0 == 0), F.pow(F.lit(2.0), 1 - n)).when(var > 0, _two_sided((F.col("runs") - mu) / F.sqrt(var))).otherwise(1.0)
    c = c.withColumn("m", total("v") / n)
    spread = total(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m"))))
    lag = total(F.transform("v", lambda x, i: F.coalesce((x - F.col("m")) * (F.get("v", i + 1) - F.col("m")), F.lit(0.0))))
    c = c.withColumn("spread", spread).withColumn("lag", lag)
    p_serial = F.when(F.col("spread") > 0, _two_sided((F.col("lag") / F.col("spread") + 1 / n) * F.sqrt(n.cast("double")))).otherwise(0.0)
    p = F.least(F.lit(1.0), 3 * F.least(_two_sided(z_chi), p_runs, p_serial))
    # at the length of a long word these three see little, so tokens of letters alone also undergo a runs test by vowels:
    # vowels and changes between vowel and consonant together, of which words have more than random letters
    c = c.withColumn("vowel", F.transform(F.split(F.lower("token"), ""), lambda x: F.instr(F.lit("aeiou"), x).cast("boolean").cast("int")))
    changes = F.size(F.filter("vowel", lambda x, i: (i > 0) & (F.get("vowel", i - 1) != x)))
    seen = F.aggregate("vowel", F.lit(0), lambda x, y: x + y) + changes
    q = 5 / 26
    change, both = 2 * q * (1 - q), q * (1 - q)
    # variance of the sum, per letter: of the vowels, of the changes, and twice their covariance
    var = both + change * (1 - change) + 2 * (both - change ** 2) + 4 * (both - q * change)
    z = (seen - q * n - change * (n - 1)) / F.sqrt(var * n)
    p_words = F.when(z > 0, _upper_tail(z)).otherwise(1.0)
    p = F.when(F.col("encoding").isin("lower", "UPPER", "letters"), F.least(F.lit(1.0), p * 4 / 3, 4 * p_words)).otherwise(p)
    return c.withColumn("p", p).drop("f", "alphabet", "v", "squares", "b", "n1", "runs", "m", "spread", "lag", "k", "vowel")


def _with_parts(tokens: DataFrame) -> DataFrame:
    """(row, at, start, end, token): candidates `tokens` (row, c: start, end, s, hits) and their long parts that no hit overlaps; at is the token's start."""
    t = tokens.select("row", F.col("c.start").alias("at"), F.col("c.end").alias("end"), F.col("c.s").alias("s"), F.col("c.hits").alias("hits"))
    own = F.struct(F.col("at").alias("start"), F.col("end"), F.col("s").alias("token"))
    t = t.withColumn("all", F.array(own)).drop("end")
    for separators in SEPARATORS:
        t = t.withColumn("p", F.when(F.col("s").rlike(separators), F.split("s", separators, -1)))
        t = t.withColumn("l", F.transform("p", lambda x: F.length(x) + 1)).withColumn("o", _running(F.col("l")))
        parts = F.filter(F.transform("p", lambda x, i: F.struct(
            (F.col("at") + F.get("o", i)).alias("start"), (F.col("at") + F.get("o", i) + F.length(x)).alias("end"), x.alias("token"))),
            lambda x: F.length(x["token"]) >= LENGTH)
        t = t.withColumn("all", F.concat("all", F.coalesce(parts, F.array().cast("array<struct<start:int,end:int,token:string>>"))))
    t = t.select("row", "at", "hits", F.explode(F.array_distinct("all")).alias("c"))
    return t.where(~F.exists("hits", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))).select("row", "at", "c.*")


def _band(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in BANDS]), lambda b: n >= b))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 100).cast("int"))


def dismissed(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(band, cut): candidates of the band in bin `cut` or beyond are not random.  At most one row for a band.

    Benjamini-Hochberg on binned p-values, each taken as the largest of its bin, so
    that the bound holds; both windows run over at most bands x bins rows.
    """
    from pyspark.sql import Window
    counts = tested.groupBy(_band(F.col("n")).alias("band"), _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("c"))
    smaller = F.sum("c").over(Window.partitionBy("band").orderBy(F.col("bin").desc()))
    counts = counts.withColumn("rank", smaller).withColumn("all", F.sum("c").over(Window.partitionBy("band")))
    passes = F.pow(F.lit(10.0), -F.col("bin") / 100) <= fdr * F.col("rank") / F.col("all")
    return counts.where(passes).groupBy("band").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans: arrays of (start, kind number, end), in order."""
    prepare(docs.sparkSession)
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    for name, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("candidate", CANDIDATE, 0)):
        t = _matches(t, pattern, name, group)
    of = lambda name, kind: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    t = t.withColumn("assign", F.filter("assign", lambda x: F.length(x["s"]) >= ASSIGN_LENGTH))
    t = t.withColumn("base", F.array_sort(F.concat(of("assign", 0), of("access", 1), of("hex", 2))))
    hits = lambda c: F.filter("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    tokens = F.transform("candidate", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), hits(c).alias("hits")))
    rows = stored(t.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", tokens.alias("candidate")), "spans")
    tested = _battery(_with_parts(rows.select("row", F.explode("candidate").alias("c"))))
    tested = stored(tested.select("row", "at", "start", "end", "n", "encoding", "p"), "tested")
    cuts = dismissed(tested, fdr).withColumnRenamed("band", "b")
    random = tested.join(F.broadcast(cuts), _band(F.col("n")) == F.col("b"), "left") \
        .where(F.col("cut").isNull() | (_bin(F.col("p")) < F.col("cut")))
    # of a token and its parts only those that no other holds
    of_token = random.groupBy("row", "at").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("own"))
    holds = lambda y, x: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    widest = F.filter("own", lambda x: ~F.exists("own", lambda y: holds(y, x)))
    found = of_token.groupBy("row").agg(F.flatten(F.collect_list(widest)).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.join(found, "row", "left").select("doc_id", "base", spans.alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op3_secrets(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                             F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
