"""Text column functions (T1-T12, T32, T33).  All are Catalyst expressions.

Regex note: Java's \\s and \\w are ASCII unless (?U) is set; the reference's
patterns are Python (Unicode).  Tokens are therefore cut with explicit
Unicode classes (\\p{L}\\p{N}_) and then tested for ASCII letters.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference (stop lists) ----
ACADEMIC_STOPWORDS = [
    "et", "al", "fig", "figure", "table", "eq", "equation",
    "ref", "cite", "ibid", "vol", "pp", "doi", "arxiv",
    "http", "https", "www", "abstract", "introduction",
    "conclusion", "acknowledgment", "acknowledgement", "reference",
    "references", "bibliography", "supplementary", "appendix",
]
BASIC_STOPWORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all",
    "can", "her", "was", "one", "our", "out", "has", "have",
    "with", "this", "that", "from", "they", "been", "will",
    "their", "would", "there", "about", "which", "when",
    "what", "some", "them", "than", "other", "into", "more",
    "these", "also", "were", "such", "each", "does",
]
# keyword scorer's extra stop words (on top of BASIC + ACADEMIC)
KEYWORD_EXTRA_STOPWORDS = [
    "based", "using", "used", "proposed", "paper", "study", "results",
    "method", "approach", "shows", "show", "present", "work",
]
# organisation patterns (findall, in this order)
ORG_PATTERNS = [
    r"(?:University|Institute|Laboratory|Department|College|School|Center|Centre)\s+(?:of\s+)?[A-Z][a-zA-Z\s]+",
    r"[A-Z][a-zA-Z]+\s+(?:University|Institute|Lab|College)",
    r"(?:MIT|Stanford|Harvard|Oxford|Cambridge|IEEE|ACM|NASA|NIH|WHO|CERN)",
]
# ---- end of fixed values ----

TOKEN_STOPS = sorted(set(BASIC_STOPWORDS) | set(ACADEMIC_STOPWORDS))
KEYWORD_STOPS = sorted(set(BASIC_STOPWORDS) | set(KEYWORD_EXTRA_STOPWORDS) | set(ACADEMIC_STOPWORDS))

# Unicode whitespace as Python's \s sees it (Java's and RE2's \s are ASCII only).
WS_BODY = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_BODY}]"
NON_WS = f"[^{WS_BODY}]"


def unicode_ws(pattern: str) -> str:
    """Rewrite a Python pattern's \\s for Java/RE2: inside a class add the Unicode
    whitespace body, outside use the class."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            out.append((WS_BODY if in_class else WS) if pair == "\\s" else pair)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


WORD_SPLIT = r"[^\p{L}\p{N}_]+"


# Python whitespace that Java's ASCII \s does not know; mapped to ' ' before the regexes
_EXOTIC_WS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000"
PY_WS_CHARS = " \t\n\x0b\x0c\r" + _EXOTIC_WS


def ascii_ws(c: Column) -> Column:
    """Map every Python-whitespace character outside Java's \\s to a plain space."""
    return F.translate(c, _EXOTIC_WS, " " * len(_EXOTIC_WS))


def strip_ws(c: Column) -> Column:
    """Python str.strip(): trim Unicode whitespace on both ends."""
    return F.btrim(c, F.lit(PY_WS_CHARS))


def clean_text(c: Column) -> Column:
    """Remove URLs, emails, DOIs, $math$ (-> space), LaTeX commands, tags; collapse whitespace.

    Exotic whitespace is first mapped to ' ' (a char translation), so Java's fast ASCII
    \\s/\\S classes see exactly Python's whitespace; every run collapses to ' ' at the
    end anyway, so the mapping does not change the result.
    """
    t = ascii_ws(F.coalesce(c, F.lit("")))
    # ---- fixed values: the patterns must match what the reference removes ----
    t = F.regexp_replace(t, r"http\S+|www\.\S+", "")
    # same matches as \S+@\S+, anchored at token starts so the scan stays linear
    t = F.regexp_replace(t, r"(?<!\S)\S+@\S+", "")
    t = F.regexp_replace(t, r"10\.\p{Nd}{4,}/\S+", "")
    t = F.regexp_replace(t, r"\$[^$]+\$", " ")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\{[^}]*\}", "")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    # ---- end of fixed values ----
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(t)


def words(c: Column) -> Column:
    """Whole words of 3+ ASCII letters (a word = maximal Unicode \\w run), lower-cased."""
    parts = F.split(F.lower(c), WORD_SPLIT)
    return F.filter(parts, lambda x: x.rlike(r"^[a-z]{3,}$"))


def tokens(c: Column, stops: list[str] = TOKEN_STOPS) -> Column:
    """Tokens of the cleaned text minus stop words; duplicates kept, order kept."""
    stop_arr = F.array(*[F.lit(s) for s in stops])
    return F.filter(words(clean_text(c)), lambda x: ~F.array_contains(stop_arr, x))


def sentences(c: Column) -> Column:
    """Split cleaned text on [.!?]+, trim, drop empty."""
    parts = F.transform(F.split(clean_text(c), r"[.!?]+"), lambda s: strip_ws(s))
    return F.filter(parts, lambda s: s != "")


def bigrams(toks: Column) -> Column:
    """Bigrams of adjacent tokens ("a b"), in order."""
    n = F.size(toks)
    m = F.greatest(n - 1, F.lit(0))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(toks, 1, F.greatest(m, F.lit(1))), F.slice(toks, 2, F.greatest(m, F.lit(1))),
                   lambda a, b: F.concat(a, F.lit(" "), b)))


def org_entities(c: Column) -> Column:
    """Organisation mentions by three patterns, findall order, stripped, no dedupe.
    Texts shorter than 10 stripped chars give an empty list."""
    t = F.coalesce(c, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(unicode_ws(p)), 0) for p in ORG_PATTERNS])
    found = F.transform(found, lambda m: strip_ws(m))
    return F.when(F.length(strip_ws(t)) < 10, F.array().cast("array<string>")).otherwise(found)


def truncate_words(c: Column, n: int = 1500) -> Column:
    """Over n chars -> first n, cut back to the last space (if any), plus '...'."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))\
        .otherwise(c)


_KW = unicode_ws(r"(?i)keywords?\s*:\s*(.+?)(?:\.|$)")


def inline_keywords(c: Column) -> Column:
    """Comma list after the first `keywords:` up to '.' or end; trimmed, non-empty."""
    grp = F.regexp_extract(c, _KW, 1)
    parts = F.transform(F.split(grp, ","), lambda x: strip_ws(x))
    return F.when(F.regexp_like(c, F.lit(_KW)), F.filter(parts, lambda x: x != "")) \
        .otherwise(F.array().cast("array<string>"))


def strip_inline_keywords(c: Column) -> Column:
    """Remove every `keywords: ...` span, then strip."""
    return strip_ws(F.regexp_replace(c, unicode_ws(r"(?i)\s*keywords?\s*:\s*.+?(?:\.|$)"), ""))


def bare_doi(c: Column) -> Column:
    """Strip a doi.org URL prefix."""
    return F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", "")


#: names that count without a semicolon too (html5 keys that lack one), the longest first
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def _character(code: Column) -> Column:
    """The character of a numeric reference; 128 to 159 read as windows-1252, what is no character as U+FFFD."""
    fixed = [(c, bytes([c]).decode("cp1252", "replace")) for c in range(128, 160)]
    point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    odd = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    table = F.from_json(F.lit(json.dumps({str(c): t for c, t in fixed if t != "\ufffd"})), "map<string,string>")
    return F.when(odd, F.lit("\ufffd")).when(code.between(128, 159), F.coalesce(F.try_element_at(table, code.cast("string")), point)).otherwise(point)


def unescape_html(c: Column) -> Column:
    """Character references decoded once, left to right: all names of HTML 5, decimal and hexadecimal numbers, the old
    names without a semicolon; what is none stays.  Text without & is passed through."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def piece(p: Column) -> Column:
        dec, hexa = F.regexp_extract(p, r"^#([0-9]{1,8})(?![0-9])", 1), F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,7})(?![0-9a-fA-F])", 1)
        name, bare = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(p, f"^({'|'.join(_BARE)})", 1)
        by_name = F.try_element_at(table, name)
        rest = lambda n: p.substr(n + 1, F.length(p))
        number = F.coalesce(F.nullif(dec, F.lit("")).cast("long"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("long"))
        return (F.when(number.isNotNull(), F.concat(_character(number), F.regexp_replace(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
                .when(by_name.isNotNull(), F.concat(by_name, rest(F.length(name))))
                .when(bare != "", F.concat(F.try_element_at(table, bare), rest(F.length(bare))))
                .otherwise(F.concat(F.lit("&"), p)))

    parts = F.split(c, "&", -1)
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def plain_text(c: Column) -> Column:
    """HTML -> plain text (tags -> one space, character references decoded), newlines -> space."""
    t = unescape_html(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(t, r"[\r\n]+", " "))


def split_name(c: Column) -> Column:
    """first/last name split on the first space -> struct(first_name, last_name)."""
    parts = F.split(c, " ", 2)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("first_name"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("last_name"))
