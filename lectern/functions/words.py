"""The rules of `functions.text` (T1, T2, T4, T6, T27) over Arrow batches of texts: words as numbers, counted in numpy.

A batch is taken in pieces of bounded size.  A piece's words are numbered by its dictionary; what holds for a word (letters only, a
stop word) is asked once of each entry, and terms are counted by sorting numbers.  Texts are Python strings only for
T1 and T6, whose expressions run on those that hold a character or word of theirs.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.functions.text import ORG_PATTERNS, WORD_SPLIT

PIECE_BYTES = 1 << 22  # text that is split at once, about
PIECE_TEXTS = 1 << 12  # and texts; so that (text, word, word) is one number

# ---- fixed values: the patterns must match what the reference removes; a text without one of the strings has no match ----
CLEAN = [(("http", "www."), re.compile(r"http\S+|www\.\S+"), ""),
         (("@",), re.compile(r"(?<!\S)\S+@\S+"), ""),
         (("10.",), re.compile(r"10\.\d{4,}/\S+"), ""),
         (("$",), re.compile(r"\$[^$]+\$"), " "),
         (("\\",), re.compile(r"\\[a-zA-Z]+\{[^}]*\}"), ""),
         (("<",), re.compile(r"<[^>]+>"), "")]
# ---- end of fixed values ----
_NAMES = [re.findall(r"[A-Za-z]+", re.search(r"\(\?:([A-Za-z|]+)\)", p).group(1)) for p in ORG_PATTERNS]
ORGS = [(tuple(names), re.compile(p)) for names, p in zip(_NAMES, ORG_PATTERNS)]


def cleaned(text: str) -> str:
    """T1 up to white space, which words do not see."""
    for hints, pattern, by in CLEAN:
        if any(h in text for h in hints):
            text = pattern.sub(by, text)
    return text


def organisations(text: str) -> list[str]:
    """See `text.org_entities`."""
    if len(text.strip()) < 10:
        return []
    return [m.strip() for names, pattern in ORGS if any(n in text for n in names) for m in pattern.findall(text)]


def pieces(texts: pa.Array):
    """Slices of PIECE_TEXTS and about PIECE_BYTES at most; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + PIECE_TEXTS, int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))))
        yield texts.slice(at, to - at)
        at = to


class Words(NamedTuple):
    """code and doc of each word of `n` texts; words: by code."""

    code: np.ndarray
    doc: np.ndarray
    words: pa.Array
    n: int

    def where(self, good: pa.Array) -> Words:
        """Only the words of the codes that are `good`."""
        keep = good.to_numpy(zero_copy_only=False)[self.code]
        return Words(self.code[keep], self.doc[keep], self.words, self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, code, doc, place) of neighbours."""
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        return self.code[at], self.code[at + 1], self.doc[at], at


_ASKED = np.full(0x110000, 2, np.uint8)  # 1: part of words, 0: not, 2: not asked yet


def _in_words(points: np.ndarray) -> np.ndarray:
    """Which characters, by code point, are part of words."""
    out = _ASKED[points]
    if (new := np.unique(points[out == 2])).size:
        left = pc.list_value_length(pc.split_pattern_regex(pa.array([chr(p) for p in new]), WORD_SPLIT))
        _ASKED[new] = pc.equal(left, 1).to_numpy(zero_copy_only=False)
        out = _ASKED[points]
    return out.astype(bool)


def split(texts: pa.Array) -> Words:
    """The words of lower-cased texts: what WORD_SPLIT leaves that is not empty."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if len(raw) and raw.max() >= 128:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        part = np.repeat(_in_words(points), 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    else:
        part = _in_words(raw)
    first = part.copy()
    first[1:] &= ~part[:-1]
    starts = ends[:-1][ends[:-1] < ends[1:]]
    first[starts] = part[starts]
    at = np.flatnonzero(first)
    offsets = np.r_[np.cumsum(part, dtype=np.int32)[at] - 1, part.sum()].astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw[part]))
    coded = words.dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, ends)))
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, coded.dictionary, len(texts))


def lowered(texts: list[str]) -> pa.Array:
    return pa.array([t.lower() for t in texts], pa.string())


def not_in(words: pa.Array, stops) -> pa.Array:
    return pc.invert(pc.is_in(words, pa.array(sorted(stops), pa.string())))


def term_words(w: Words, stops) -> Words:
    """Words of two characters or more without stop words."""
    return w.where(pc.and_(pc.greater_equal(pc.utf8_length(w.words), 2), not_in(w.words, stops)))


def letter_words(w: Words) -> Words:
    """T2 before stop words: three ASCII letters or more."""
    return w.where(pc.match_substring_regex(w.words, "^[a-z]{3,}$"))


def joined(words: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " ")


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a key, how many, where first) of each key, in their order."""
    order = np.argsort(key)
    key = key[order]
    start = _edges(key)
    return key[start], np.diff(np.r_[start, len(key)]), np.minimum.reduceat(order, start) if len(key) else order


def distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[_edges(key)]


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def term_counts(w: Words, chosen=None, pairs: bool = False) -> pa.Table:
    """(term, tf, df) of the words of all texts, or of the pairs of neighbours that are both `chosen` (None: all)."""
    size = max(len(w.words), 1)
    if not pairs:
        tf = np.bincount(w.code, minlength=size)
        df = np.bincount(distinct(w.doc * size + w.code) % size, minlength=size)
        there = np.flatnonzero(tf)
        return _counts(w.words.take(pa.array(there)), tf[there], df[there])
    a, b, doc, _ = w.pairs()
    if chosen is not None:
        good = pc.is_in(w.words, chosen).to_numpy(zero_copy_only=False)
        both = good[a] & good[b]
        a, b, doc = a[both], b[both], doc[both]
    pair, tf, _ = groups(a * size + b)
    df = np.diff(np.searchsorted(np.sort(distinct((doc * size + a) * size + b) % (size * size)), np.r_[pair, size * size]))
    return _counts(joined(w.words, pair // size, pair % size), tf, df)


def _counts(term: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.Table:
    return pa.table([term, pa.array(tf.astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "tf", "df"])


def added(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same terms added up."""
    t = pa.concat_tables(tables).combine_chunks().group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
    return t.select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])


def best_terms(w: Words, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """T4 for every text: how many terms, the `n` best terms and their raw scores, best first.

    Word: tf * (1 + min(len/10, 1)); pair of neighbours: occurrences * 1.5 / total.  Ties: words before pairs, first
    occurrence (the reference's stable sort over insertion order).
    """
    size, total = max(len(w.words), 1), np.maximum(np.bincount(w.doc, minlength=w.n), 1)
    length = pc.utf8_length(w.words).to_numpy(zero_copy_only=False)
    key, many, first = groups(w.doc * size + w.code)
    doc, code = key // size, key % size
    a, b, of, at = w.pairs()
    key, many2, first2 = groups((of * size + a) * size + b)
    doc2, kind = key // (size * size), key % (size * size)
    raw = many / total[doc] * (1.0 + np.minimum(length[code] / 10.0, 1.0))
    parts = [(doc, doc2), (raw, many2 * 1.5 / total[doc2]), (np.zeros(len(doc), np.int8), np.ones(len(doc2), np.int8)), (first, at[first2]),
             (code, kind // size), (code, kind % size), (many, many2)]
    doc, raw, pair, first, one, two, many = (np.concatenate(p) for p in parts)
    # what occurs once scores 2 / total at most, what occurs again more than that
    rest = (np.bincount(doc[many > 1], minlength=w.n) < n)[doc] | (many > 1)
    doc, raw, pair, first, one, two = (x[rest] for x in (doc, raw, pair, first, one, two))
    order = np.lexsort((first, pair, -raw, doc))
    own = doc[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own) < n]
    term = pc.if_else(pa.array(pair[order] == 0), w.words.take(pa.array(one[order])), joined(w.words, one[order], two[order]))
    return np.bincount(doc[order], minlength=w.n), term, raw[order]
