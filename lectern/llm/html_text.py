"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words, opening and closing tags.  Every token has
a score, words mostly positive and tags mostly negative, and one linear scan
finds the contiguous region with the greatest sum.  Text in the region is the
article, except what stands in elements that are never article text (scripts,
styles, navigation, forms, asides, footers, and elements whose class, id or role
names an advert, a notice, reader comments and the like): such elements score 0
and are passed over, so that an advert in the middle does not cut an article.
Only whole names count, or compounds all of whose parts are such names; an
element that holds the marked article, or most of the page's prose, is never
passed over, whatever its tag or name.

Scores are log odds of a token kind inside against outside the article, learned
from labelled pages: those that mark their article themselves by exactly one
`article`, or else one `main`, element.  A token kind is a tag name, or a word
with the block around it and whether it is in a link; a few hundred at most.
Counts start from `PRIOR`, so that kinds that labelled pages lack keep a sense.
At most about `LABELLED` pages, drawn by a hash of page_id, are learned from
(documented bound); all pages are extracted, whole.

Defined results: null or empty html gives an empty text, as does a page without
words in its region; a page without tags is one block; repeated rows and equal or
null page_id are extracted each on its own; an empty table gives no rows; only
page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare

LABELLED = 20_000
PSEUDO = 20.0  # weight of the prior, in tokens
MOST = 3.0     # learned scores stay between -MOST and MOST

#: HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
                   "thead tr ul".split())
CELLS = frozenset(["td", "th", "br"])  # separate words, not blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("nav aside footer form button select option label menu dialog svg canvas object audio video map head".split())
ENDED_BY_BLOCK = frozenset("p li dt dd option".split())  # a closing tag may be left out
KNOWN = BLOCKS | CELLS | VOID | RAW | NEVER | frozenset("a b i u s em strong span small big sub sup code kbd samp var q cite abbr time mark del ins font tt".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar "
    "sidebar side-bar aside rail widget widgets related recommended more-stories trending popular "
    "footer foot footnav copyright legal masthead site-header page-header site-footer page-footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall disclaimer "
    "comment comments commentlist reader-comments respond reply replies disqus discussion feedback "
    "share sharing social newsletter subscribe subscription signup login search tags taglist "
    "contentinfo complementary".split())
#: Of these, names that a section of an article can carry as its subject.
SUBJECTS = frozenset("discussion related recommended popular trending feedback notice notices alert legal copyright disclaimer search "
                     "advertising promotion sharing subscription navigation menu tags cookies gdpr consent social".split())
#: Names and tags that hold most of a page's prose only where there is no article: prose does not speak for them.
CERTAIN = frozenset("ad ads advert adverts advertisement adsense nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
                    "footer foot footnav copyright legal site-footer page-footer cookie cookies consent gdpr comment comments commentlist "
                    "reader-comments respond reply replies disqus contentinfo".split())
NO_PROSE = NEVER - frozenset(["form", "label", "dialog", "aside"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_HEADING = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|responses|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?|leave a (?:reply|comment).{0,20}", re.I)

#: Prior scores: words in prose blocks speak for an article, links and structure against it.
PRIOR = {"word": 1.0, "word:li": 0.5, "word:div": 0.3, "word:link": -1.0, "p": 0.5, "/p": 0.5, "article": 3.0, "/article": 3.0,
         "main": 2.0, "/main": 2.0, "h1": 2.0, "li": -0.3, "/li": -0.3, "a": -1.0, "/a": -1.0, "div": -1.5, "/div": -1.5,
         "td": 0.0, "th": 0.0, "/td": 0.0, "/th": 0.0, "br": 0.0, "comments": -1000.0}
TAG_PRIOR = -0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

Token = tuple[str, str, str]  # kind of piece (text, open, close), name or text, attributes


def pieces(page: str) -> Iterator[Token]:
    """Text, opening and closing tags in page order; comments and the inside of raw-text elements are left out."""
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            yield "close", name, ""
            continue
        attrs = m["attrs"] or ""
        if name in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        yield "open", name, attrs
    if at < len(page):
        yield "text", page[at:], ""


def names_of(attrs: str) -> Iterator[tuple[str, str, list[str]]]:
    """(attribute, name, its parts) of class, id and role; the parts leave out numbers."""
    for attr, *values in ATTR.findall(attrs):
        for name in "".join(values).lower().split():
            yield attr.lower(), name, [x for x in re.split(r"[-_:]|(?<=[a-z])(?=\d)", name) if x and not x.isdigit()]


def among(name: str, parts: list[str], names: frozenset[str]) -> bool:
    """Whether a name is one of `names`, or made of them alone."""
    return name in names or (bool(parts) and all(x in names for x in parts))


def boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is never article text; `inside`: it stands in an article or main element."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attrs):
        return True
    section = name == "section" or name in HEADINGS
    for attr, word, parts in names_of(attrs):
        subject = section or inside if attr == "id" else section and inside
        if among(word, parts, BOILERPLATE) and not (subject and among(word, parts, SUBJECTS)):
            return True
    return False


def certain(name: str, attrs: str) -> bool:
    """Whether a passed-over element stays so even if it holds most of the page's prose."""
    return name in NO_PROSE or bool(HIDDEN.search(attrs)) or any(among(word, parts, CERTAIN) for _, word, parts in names_of(attrs))


def prose_before(tokens: list[Token], ends: dict[int, int]) -> list[int]:
    """Number of characters of prose before each token: text outside links and elements without prose."""
    out, total, skip = [0], 0, 0
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "text":
            total += len(name.strip()) if i >= skip else 0
        elif kind == "open" and (name == "a" or name in NO_PROSE):
            skip = max(skip, ends.get(i, 0))
        out.append(total)
    return out


def elements_end(tokens: list[Token]) -> dict[int, int]:
    """Index of each opening tag -> index just after its end; without a closing tag it is absent,
    unless the end is implied by the next block."""
    open_at: dict[str, list[int]] = {}
    end: dict[int, int] = {}
    implied: list[int] = []
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "text":
            continue
        if name in BLOCKS and implied:
            for j in implied:
                end.setdefault(j, i)
            implied = []
        if kind == "open" and name not in VOID:
            open_at.setdefault(name, []).append(i)
            if name in ENDED_BY_BLOCK:
                implied.append(i)
        elif kind == "close" and open_at.get(name):
            end.setdefault(open_at[name].pop(), i + 1)
    return end


class Page:
    """A page's scored parts: token kinds with the text they carry, passed-over elements left out."""

    def __init__(self, page: str) -> None:
        self.kinds: list[str] = []
        self.words: list[str | None] = []   # a word, " " for white space alone, or None for a tag
        self.breaks: list[bool] = []        # whether a block ends here
        tokens = list(pieces(page))
        ends = elements_end(tokens)
        whole = {n: [i for i, t in enumerate(tokens) if t[0] == "open" and t[1] == n] for n in ("article", "main")}
        marked = next((own[0] for own in (whole["article"], whole["main"]) if len(own) == 1 and own[0] in ends), None)
        self.label = None
        block, links, i = "", 0, 0
        within: list[int] = []
        prose: list[int] = []

        def holds_article(i: int) -> bool:
            if marked is not None and i < marked < ends[i]:
                return True
            if certain(*tokens[i][1:]):
                return False
            if not prose:
                prose.extend(prose_before(tokens, ends))
            return 2 * (prose[ends[i]] - prose[i]) > prose[-1]

        while i < len(tokens):
            kind, name, attrs = tokens[i]
            if marked is not None and i == marked:
                first = len(self.kinds)
            if kind == "text":
                self._text(name, block, links)
            else:
                while within and within[-1] <= i:
                    within.pop()
                if kind == "open" and boilerplate(name, attrs, bool(within)) and i in ends and not holds_article(i):
                    self._add("skip", None, name in BLOCKS)
                    i = ends[i]
                    continue
                if kind == "open" and name in ("article", "main") and i in ends:
                    within.append(ends[i])
                if name == "a":
                    links = 1 if kind == "open" and i in ends else 0
                if name in BLOCKS:
                    block = name if kind == "open" else ""
                self._add(("/" if kind == "close" else "") + (name if name in KNOWN else "other"), " " if name in CELLS else None, name in BLOCKS)
            i += 1
            if marked is not None and i == ends[marked]:
                self.label = (first, len(self.kinds))

    def _add(self, kind: str, word: str | None, breaks: bool) -> None:
        self.kinds.append(kind)
        self.words.append(word)
        self.breaks.append(breaks)

    def _text(self, raw: str, block: str, links: int) -> None:
        text = html.unescape(raw)
        if block[:1] == "h" and block[1:].isdigit() and COMMENT_HEADING.fullmatch(text.strip()):
            self._add("comments", None, False)
        kind = "word:link" if links else f"word:{block}" if block in BLOCKS else "word"
        words = text.split()
        if text[:1].isspace():
            self._add("space", " ", False)
        for k, w in enumerate(words):
            if k:
                self._add("space", " ", False)
            self._add(kind, w, False)
        if words and text[-1:].isspace():
            self._add("space", " ", False)

    def region(self, scores: dict[str, float], stop: int | None = None) -> tuple[int, int]:
        """The contiguous range of tokens before `stop` with the greatest score (the first, and of equals the longest)."""
        best, found, total, start = 0.0, (0, 0), 0.0, 0
        for i, kind in enumerate(self.kinds[:stop]):
            if total < 0:
                total, start = 0.0, i
            total += score(kind, scores)
            if total > best or (total == best and start == found[0] and best > 0):
                best, found = total, (start, i + 1)
        return found

    def text(self, first: int, end: int) -> str:
        blocks, now = [], []
        for word, breaks in zip(self.words[first:end], self.breaks[first:end]):
            if breaks:
                blocks.append("".join(now).split())
                now = []
            if word is not None:
                now.append(word)
        blocks.append("".join(now).split())
        return "\n".join(" ".join(b) for b in blocks if b)


def prior(kind: str) -> float:
    if kind in ("skip", "space"):
        return 0.0
    return PRIOR.get(kind, PRIOR["word"] if kind.startswith("word") else TAG_PRIOR)


def score(kind: str, scores: dict[str, float]) -> float:
    got = scores.get(kind)
    return prior(kind) if got is None else got


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Scores of token kinds from about `labelled` of the pages that mark their article."""
    total = pages.count()
    share = min(1.0, labelled / total) if total else 0.0
    sample = pages.where((F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) & F.col("html").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for h in batch["html"]:
                page = Page(h)
                if page.label:
                    first, end = page.label
                    own = Counter(page.kinds[first:end])
                    inside.update(own)
                    outside.update(Counter(page.kinds) - own)
        kinds = sorted(inside | outside)
        yield pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "n_in": [inside[k] for k in kinds], "n_out": [outside[k] for k in kinds]})

    counts = sample.select("html").mapInPandas(count, "kind string, n_in long, n_out long") \
        .groupBy("kind").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).collect()  # a row per token kind
    out = {}
    for r in counts:
        if r.kind in ("skip", "space", "comments"):
            continue
        odds = math.exp(max(-6.0, min(6.0, prior(r.kind))))
        got = math.log((r.n_in + PSEUDO * odds / (1 + odds)) / (r.n_out + PSEUDO / (1 + odds)))
        out[r.kind] = max(-MOST, min(MOST, got))
    return out


def extract(page: str | None, scores: dict[str, float]) -> str:
    if not page:
        return ""
    p = Page(page)
    if "comments" not in p.kinds:
        return p.text(*p.region(scores))
    # no region begins at or after a heading of comments; if the learned scores see nothing before it, the prior ones look
    stop = p.kinds.index("comments")
    first, end = p.region(scores, stop)
    return p.text(*((first, end) if end else p.region({}, stop)))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of `pages`."""
    prepare(pages.sparkSession)
    scores = learn(pages)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(h, scores) for h in pages], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text"))


def op8_main_text(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
