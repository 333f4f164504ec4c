"""Personal data by weak supervision.

Fixed patterns give the base spans (e-mail, IP, card and phone numbers).  These
and looser candidates (number groups, names after a title or from a list of
first names) are judged by labelers that vote yes, no or abstain: pattern,
checksum, gazetteer, context, and shape.  Nobody labels
anything by hand: expectation-maximisation estimates each labeler's reliability
from how the votes agree, over all candidates of the corpus, and gives every vote
pattern a probability.  Those probabilities train the final classifier, a
logistic regression on kind, votes and length, which decides what is added to
the base spans.

A candidate is known to the model by its kind, votes and length class, so the
corpus enters EM and the classifier as a count for each of at most
5 * 3**5 * 4 = 4,860 keys, whatever its size; the decision goes back as a list of
keys.  Texts are read once, in the row; nothing is shuffled but key counts.

Defined results: null text is empty; a text without findings has empty span
strings; an empty table gives no rows; repeated rows and equal or null doc_id are
scanned each on its own; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare, stored

KINDS = ("email", "ip", "card", "phone", "name")
EMAIL, IP, CARD, PHONE, NAME = range(5)
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")
THRESHOLD = 0.9
CONTEXT = 40  # characters before a candidate that the context labeler reads

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does: the digits before would belong to it.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_NUMBER = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z.,/-])(?:00)?[0-9(][0-9()./ -]{5,30}[0-9](?![0-9A-Za-z])")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\b\.? +([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)")
TITLE_BEFORE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\b\.? +$")
LISTED = re.compile(r"\b([A-Z][a-z]+) [A-Z][a-z]{2,}\b")

#: Gazetteers.
FIRST_NAMES = frozenset("James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen "
                        "Pierre Jean Marie Claude Sophie Hans Peter Klaus Ursula Sabine Juan Carlos Carmen Pilar Lucía".split())
TOP_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl ch at be eu us ca au".split())
CALLING_CODES = ("1", "33", "34", "39", "41", "43", "44", "49")
FOR = re.compile(r"\b(?:call|phone|tel|telephone|mobile|fax|e-?mail|mail|contact|card|visa|credit|address|server|host|ip|"
                 r"appele[rz]|téléphone|courriel|carte|telefon|anruf|karte|teléfono|correo|tarjeta|dirección)\b", re.I)
AGAINST = re.compile(r"\b(?:version|isbn|issn|doi|order|invoice|page|pages|figure|chapter|section|vol|volume|no|nr|article|"
                     r"commande|bestellung|pedido|seite|página)\b", re.I)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain; each character is passed once or twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, EMAIL, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), IP, m.end()))
        for m in CARD_NUMBER.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in PHONE_NUMBER.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Looser spans that no base span overlaps; of overlapping ones the first."""
    found = []
    if DIGIT.search(text):
        for m in LOOSE_NUMBER.finditer(text):
            n = len(digits_of(m[0]))
            if 7 <= n <= 19:
                found.append((m.start(), CARD if n >= 14 else PHONE, m.end()))
    found += [(m.start(1), NAME, m.end(1)) for m in TITLED.finditer(text)]
    found += [(m.start(), NAME, m.end()) for m in LISTED.finditer(text) if m[1] in FIRST_NAMES]
    out, taken = [], sorted((a, e) for a, _, e in base)
    ends = 0
    at = 0
    for a, kind, e in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= ends and (at == len(taken) or taken[at][0] >= e):
            out.append((a, kind, e))
            ends = e
    return out


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 yes, -1 no, 0 abstains."""
    a, kind, e = span
    s = text[a:e]
    d = digits_of(s) if kind in (CARD, PHONE) else ""
    before = text[max(0, a - CONTEXT):a]
    pattern = 1 if is_base else (-1 if kind in (CARD, PHONE) and re.match(r"(?:19|20)\d\d[-/. ]|\d{1,2}[-/.]\d{1,2}[-/.]\d", s) else 0)
    checksum = 0
    if kind == CARD:
        checksum = 1 if luhn(d) else -1
    elif kind == PHONE:
        checksum = 1 if 10 <= len(d) <= 15 else -1
    elif kind == IP:
        checksum = -1 if s.split(".")[0].lstrip("0") in ("", "127") else 1
    gazetteer = 0
    if kind == EMAIL:
        gazetteer = 1 if s.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif kind == PHONE:
        gazetteer = 1 if s.startswith("+") and d.startswith(CALLING_CODES) else 0
    elif kind == NAME:
        gazetteer = 1 if s.split()[0] in FIRST_NAMES else 0
    groups = re.findall(r"[0-9]+", s) if d else []
    shape = 0
    if d:
        shape = 1 if len(groups) > 2 and all(2 <= len(g) <= 4 for g in groups[1:]) else (-1 if len(groups) == 1 and len(d) < 14 else 0)
    elif kind == NAME:
        shape = 1 if " " in s else 0
    context = 1 if FOR.search(before) or (kind == NAME and TITLE_BEFORE.search(before)) else (-1 if AGAINST.search(before) else 0)
    return pattern, checksum, gazetteer, context, shape


def key_of(kind: int, vote: tuple[int, ...], length: int) -> int:
    key = kind
    for v in vote:
        key = key * 3 + v + 1
    return key * 4 + min(3, length // 8)


def parts_of(key: int) -> tuple[int, tuple[int, ...], int]:
    key, length = divmod(key, 4)
    vote = []
    for _ in LABELERS:
        key, v = divmod(key, 3)
        vote.append(v - 1)
    return key, tuple(reversed(vote)), length


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """EM for labelers that vote independently given the truth; an abstention says nothing.

    The pattern labeler anchors what "yes" means: its yes (a base span) and its no
    are taken as known, all other candidates are estimated.  Returns P(yes) of
    those per kind, P(vote | truth, labeler) as [truth, labeler, yes], and P(yes)
    of each key.  Probabilities are smoothed by pseudo-votes of the start values.
    """
    keys = sorted(counts)
    kind = np.array([parts_of(k)[0] for k in keys])
    vote = np.array([parts_of(k)[1] for k in keys]).reshape(len(keys), -1)
    n = np.array([counts[k] for k in keys], float)
    known, voted, which = vote[:, 0] != 0, vote != 0, (vote > 0).astype(int)
    prior = np.full(len(KINDS), 0.5)
    start = np.array([[0.7, 0.3], [0.3, 0.7]])
    p = np.repeat(start[:, None, :], len(LABELERS), axis=1)
    at = np.arange(len(LABELERS))
    yes = np.where(vote[:, 0] > 0, 1.0, 0.0)
    for _ in range(rounds):
        log = (np.log(p[:, at, which]) * voted).sum(axis=2) + np.log([1 - prior[kind], prior[kind]])
        guess = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        yes = np.where(known, yes, guess)
        weight = np.stack([n * (1 - yes), n * yes])
        for v in range(2):
            p[:, :, v] = (weight[:, :, None] * (voted & (which == v))).sum(axis=1) + 10 * start[:, v:v + 1]
        p /= p.sum(axis=2, keepdims=True)
        for k in range(len(KINDS)):
            own = (kind == k) & ~known
            prior[k] = (weight[1][own].sum() + 5) / (n[own].sum() + 10)
    return prior, p, dict(zip(keys, yes.tolist()))


def features(key: int) -> np.ndarray:
    kind, vote, length = parts_of(key)
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 4)
    x[0] = x[1 + kind] = x[-1 - length] = 1
    for i, v in enumerate(vote):
        if v:
            x[1 + len(KINDS) + 2 * i + (v > 0)] = 1
    return x


def classifier(counts: dict[int, int], yes: dict[int, float], ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on `features`, fitted to EM's probabilities by Newton steps."""
    keys = sorted(counts)
    x = np.array([features(k) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    y = np.array([yes[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - y)) + ridge * w
        hessian = (x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def accepted(counts: dict[int, int], threshold: float = THRESHOLD) -> list[int]:
    """The keys whose candidates the trained classifier takes for personal data."""
    if not counts:
        return []
    _, _, yes = reliabilities(counts)
    w = classifier(counts, yes)
    return [k for k in sorted(counts) if 1 / (1 + np.exp(-np.clip(features(k) @ w, -30, 30))) >= threshold]


def _judged(text: str | None) -> tuple[list[Span], list[tuple[int, int, int, int]]]:
    text = text or ""
    base = base_spans(text)
    loose = candidates(text, base)
    judged = [(a, k, e, key_of(k, votes(text, (a, k, e), True), e - a)) for a, k, e in base]
    judged += [(a, k, e, key_of(k, votes(text, (a, k, e), False), e - a)) for a, k, e in loose]
    return base, judged


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans: arrays of (start, kind number, end), in order."""
    prepare(docs.sparkSession)

    @F.pandas_udf("base array<struct<start:int,kind:int,end:int>>, judged array<struct<start:int,kind:int,end:int,key:int>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [_judged(t) for t in texts]
            yield pd.DataFrame({
                "base": [[dict(zip(("start", "kind", "end"), s)) for s in b] for b, _ in found],
                "judged": [[dict(zip(("start", "kind", "end", "key"), s)) for s in j] for _, j in found]})

    rows = stored(docs.select("doc_id", look(F.col("text")).alias("r")).select("doc_id", "r.*"), "judged")
    counts = rows.select(F.explode("judged.key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    keys = accepted({r.key: r.n for r in counts.collect()}, threshold)  # at most 4,860 keys, see above
    taken = F.filter("judged", lambda j: j["key"].isin(keys)) if keys else F.filter("judged", lambda j: F.lit(False))
    taken = F.transform(taken, lambda j: F.struct(j["start"].alias("start"), j["kind"].alias("kind"), j["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.array_union("base", taken)).alias("spans"))


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; rows must have distinct doc_id."""
    spans = scan(docs, threshold).select("doc_id", "spans")

    @F.pandas_udf("string")
    def mask(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans):
            parts, done = [], 0
            for s in own:
                if s["start"] >= done:
                    parts += [t[done:s["start"]], f"[{KINDS[s['kind']]}]"]
                done = max(done, s["end"])
            out.append(None if t is None else "".join(parts) + t[done:])
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", "text").join(spans, "doc_id").select("doc_id", mask("text", "spans").alias("text"))


def _text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select("doc_id", n(EMAIL).alias("n_email"), n(IP).alias("n_ip"), n(CARD).alias("n_card"), n(PHONE).alias("n_phone"),
                             F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
