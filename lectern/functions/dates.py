"""Date parsing column functions (T17-T20, T35).  Pure Catalyst: an ordered coalesce of
`try_to_timestamp` patterns, month-name normalisation, regex extraction, relative dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip_ws
from lectern.session import AS_OF

# ---- fixed values that must equal the reference ----
# Python strptime formats, tried in this order (US before European)
DATE_FORMATS = [
    "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%S",
    "%m/%d/%Y", "%m-%d-%Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y",
    "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d %B %Y", "%d %b %Y",
    "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S %Z",
    "%Y/%m/%d", "%d.%m.%y", "%d/%m/%y", "%m/%d/%y", "%Y",
]
# foreign month name -> English, in lookup order (Turkish, Spanish, French, German)
MONTH_NAMES = {
    "ocak": "january", "şubat": "february", "mart": "march",
    "nisan": "april", "mayıs": "may", "haziran": "june",
    "temmuz": "july", "ağustos": "august", "eylül": "september",
    "ekim": "october", "kasım": "november", "aralık": "december",
    "enero": "january", "febrero": "february", "marzo": "march",
    "abril": "april", "mayo": "may", "junio": "june",
    "julio": "july", "agosto": "august", "septiembre": "september",
    "octubre": "october", "noviembre": "november", "diciembre": "december",
    "janvier": "january", "février": "february", "mars": "march",
    "avril": "april", "mai": "may", "juin": "june",
    "juillet": "july", "août": "august", "septembre": "september",
    "octobre": "october", "novembre": "november", "décembre": "december",
    "januar": "january", "februar": "february", "märz": "march",
    "april": "april", "mai": "may", "juni": "june",
    "juli": "july", "august": "august", "september": "september",
    "oktober": "october", "november": "november", "dezember": "december",
}
TODAY_WORDS = ["today", "bugün"]
YESTERDAY_WORDS = ["yesterday", "dün"]
# ---- end of fixed values ----

# strptime directive -> Java DateTimeFormatter letters (lenient widths like strptime)
_DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "[SSSSSS][SSS]",
               "%B": "MMMM", "%b": "MMM", "%a": "EEE", "%z": "Z", "%Z": "z", "%y": "yy"}


def java_pattern(fmt: str) -> str:
    """Translate a strptime format into a Spark datetime pattern (literals quoted)."""
    out, lit = [], []
    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if lit:
                out.append("'" + "".join(lit) + "'")
                lit = []
            out.append(_DIRECTIVES[fmt[i:i + 2]])
            i += 2
        else:
            ch = fmt[i]
            if ch.isalpha() or ch == "'":
                lit.append("''" if ch == "'" else ch)
            else:
                if lit:
                    out.append("'" + "".join(lit) + "'")
                    lit = []
                out.append(ch)
            i += 1
    if lit:
        out.append("'" + "".join(lit) + "'")
    return "".join(out)


def _try(c: Column, fmt: str) -> Column:
    if fmt.startswith("%a, "):
        # Spark parses no day-of-week names: check the word's shape, parse the rest
        rest = F.regexp_extract(c, r"^[A-Za-z]{3,}, (.*)$", 1)
        return F.when(rest != "", F.try_to_timestamp(rest, F.lit(java_pattern(fmt[4:]))).cast("date"))
    return F.try_to_timestamp(c, F.lit(java_pattern(fmt))).cast("date")


def normalize_month_names(c: Column) -> Column:
    """First foreign month name (whole word, in lookup order) -> capitalised English.
    (Fixed: the reference matched substrings, so 'januar' hit inside 'january'.)"""
    low = F.lower(c)
    cases = []
    for foreign, english in MONTH_NAMES.items():
        pat = rf"(^|[^\p{{L}}]){foreign}([^\p{{L}}]|$)"
        cases.append(F.when(low.rlike(pat), F.regexp_replace(low, pat, f"$1{english.capitalize()}$2")))
    any_name = rf"(^|[^\p{{L}}])({'|'.join(MONTH_NAMES)})([^\p{{L}}]|$)"
    return F.when(low.rlike(any_name), F.coalesce(*cases, c)).otherwise(c)


def relative_date(c: Column, as_of: str = AS_OF) -> Column:
    """Today / yesterday (en, tr), 'N days|weeks|months ago' (months = 30 days)."""
    low = F.lower(c)
    today = F.to_date(F.lit(as_of))
    n = lambda unit: F.regexp_extract(low, rf"(\d+)\s*({unit})\s*ago", 1)
    return (F.when(F.exists(F.array(*[F.lit(w) for w in TODAY_WORDS]), lambda w: F.contains(low, w)), today)
            .when(F.exists(F.array(*[F.lit(w) for w in YESTERDAY_WORDS]), lambda w: F.contains(low, w)),
                  F.date_sub(today, 1))
            .when(n("day|days|gün") != "", F.date_sub(today, n("day|days|gün").cast("int")))
            .when(n("week|weeks|hafta") != "", F.date_sub(today, n("week|weeks|hafta").cast("int") * 7))
            .when(n("month|months|ay") != "", F.date_sub(today, n("month|months|ay").cast("int") * 30)))


def _regex_dates(c: Column) -> Column:
    iso = F.regexp_extract(c, r"(\d{4})-(\d{1,2})-(\d{1,2})", 0)
    slash = F.regexp_extract(c, r"(\d{1,2})/(\d{1,2})/(\d{4})", 0)
    year = F.regexp_extract(c, r"\b(19|20)\d{2}\b", 0)
    return F.coalesce(
        F.when(iso != "", _try(iso, "%Y-%m-%d")),
        F.when(slash != "", _try(slash, "%d/%m/%Y")),
        F.when(slash != "", _try(slash, "%m/%d/%Y")),
        F.when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1))))


def parse_date(c: Column, custom: str | None = None, as_of: str = AS_OF) -> Column:
    """Universal parser - custom format, the format list on month-normalised text,
    regex extraction on the raw text, then relative dates; null when nothing fits."""
    s = strip_ws(F.coalesce(c.cast("string"), F.lit("")))
    norm = normalize_month_names(s)
    tries = ([_try(s, custom)] if custom else []) + [_try(norm, f) for f in DATE_FORMATS]
    return F.when(s == "", F.lit(None).cast("date")).otherwise(
        F.coalesce(*tries, _regex_dates(s), relative_date(s, as_of)))


def with_parsed_date(df, text: Column, out_col: str, custom: str | None = None, as_of: str = AS_OF):
    """T18 as staged projections: the stripped and month-normalised text are columns of
    their own, evaluated once per row rather than once per tried format."""
    df = df.withColumn("_pd_s", strip_ws(F.coalesce(text.cast("string"), F.lit(""))))
    df = df.withColumn("_pd_n", normalize_month_names(F.col("_pd_s")))
    s, norm = F.col("_pd_s"), F.col("_pd_n")
    tries = ([_try(s, custom)] if custom else []) + [_try(norm, f) for f in DATE_FORMATS]
    parsed = F.when(s == "", F.lit(None).cast("date")).otherwise(
        F.coalesce(*tries, _regex_dates(s), relative_date(s, as_of)))
    return df.withColumn(out_col, parsed).drop("_pd_s", "_pd_n")


def date_range(start: Column, end: Column) -> Column:
    """(start, end) parsed, and whether each parsed."""
    a, b = parse_date(start), parse_date(end)
    return F.struct(a.alias("start"), b.alias("end"), a.isNotNull().alias("start_valid"),
                    b.isNotNull().alias("end_valid"))


def next_run(last: Column, hours: Column) -> Column:
    """Last run + interval hours."""
    return last + F.make_interval(hours=hours)
