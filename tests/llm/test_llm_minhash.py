"""MinHash fingerprints: edited texts and classes by brute force, estimates against exact similarities."""

import hashlib
import random

import pytest

from lectern.llm import minhash
from llm_cases import LONG, ODD, documents, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    text, following = text or "", following or ""
    m = len(text) // 2
    return text[:len(text) - m] + following[:m]


def variant(seed, text, share):
    r = random.Random(seed)
    words = text.split()
    for i in r.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"v{r.randrange(10 ** 6)}"
    return " ".join(words)


def check(spark, rows, got=None):
    """Every row of distinct ids against its own text and the next document's."""
    got = {r.doc_id: r for r in got or minhash.op13_fingerprints(documents(spark, rows).repartition(5)).collect()}
    rows = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (i, text, *_), (_, following, *_) in zip(rows, rows[1:] + rows[:1]):
        r, edit = got[i], edited(text, following)
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.fingerprint == minhash.fingerprint(text) and r.edited_fingerprint == minhash.fingerprint(edit)
        assert abs(r.near_edited - similarity(text, edit)) < 0.2 and abs(r.near_next - similarity(text, following)) < 0.2
    return got


MANY = [(i * 3 + 1, None if i % 17 == 0 else "" if i % 17 == 1 else prose(i, 1 + i * 7 % 130) + (" É ß 😀" if i % 3 else "")) for i in range(150)]


@pytest.mark.parametrize("bucket", [1 << 22, 3000, 200])
def test_edited_texts_over_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET_BYTES", bucket)
    check(spark, MANY)


def test_long_and_short(spark):
    rows = [(1, LONG), (2, "x"), (3, "a" * 100_000), (4, "one two three four"), (5, LONG + " tail"), (6, None), (7, " \n "), (8, "é" * 7)]
    got = check(spark, rows)
    assert got[1].near_next == 0 and got[6].near_next == 1 and got[6].n_chars == 0
    assert (got[1].class_id, got[5].class_id) == (1, 1) and got[6].class_id == 6 and got[7].class_id == 7


def test_one_document_follows_itself(spark):
    got = check(spark, [(7, "abcd efgh")])
    assert got[7].near_next == 1
    assert minhash.op13_fingerprints(documents(spark, [])).count() == 0


def test_odd_rows(spark):
    rows = minhash.op13_fingerprints(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == sorted((i or -1, len(t or "")) for i, t, *_ in ODD)
    by = {r.doc_id: r for r in rows}
    seven = [r for r in rows if r.doc_id == 7]
    # equal rows follow one another; the first is followed by its own text, the second by the next document
    assert sorted(r.near_next for r in seven) == [0.0, 1.0] and {r.fingerprint for r in seven} == {by[6].fingerprint}
    assert {r.class_id for r in seven} == {6}
    assert len({r.fingerprint for r in rows if not (r.n_chars and r.doc_id not in (3,))}) == 1
    last = [r for r in rows if r.doc_id is None]
    firsts = {hashlib.sha256(edited(t, None).encode()).hexdigest() for i, t, *_ in ODD if i is None}
    assert any(r.edited_sha256 in firsts for r in last)  # after the last row comes the first one, which is null


def test_shared_ids_are_neighbours(spark):
    rows = [(1, prose(1)), (1, prose(2)), (2, prose(3)), (2, prose(3))]
    got = minhash.op13_fingerprints(documents(spark, rows)).collect()
    texts = {1: {prose(1), prose(2)}, 2: {prose(3)}}
    allowed = {hashlib.sha256(edited(a, b).encode()).hexdigest() for i in texts for a in texts[i] for j in texts for b in texts[j]}
    assert len(got) == 4 and all(r.edited_sha256 in allowed for r in got)


def families(n, size):
    rows = []
    for f in range(n):
        base = prose(1000 + f, 150)
        rows += [(f * 1000 + k, base if k == 0 else variant(f * 1000 + k, base, 0.005 * (1 + k % 6))) for k in range(size)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = families(6, 12) + [(90_000 + i, prose(i, 40)) for i in range(40)] + [(95_000, families(1, 1)[0][1])]
    got = {r.doc_id: r.class_id for r in minhash.op13_fingerprints(documents(spark, rows)).collect()}
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                links += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 10 ** 9), rows[i][0])
    want = {rows[i][0]: least[root(i)] for i in range(len(rows))}
    assert links > 100 and got == want


def chained(n, size):
    """Families without their origin, two words changed: texts link only where changes stand near each other, so each is
    like few of the many that it shares bands with."""
    return [(f * 1000 + k, variant(7 * f + 1000 * k, prose(2000 + f, 150), 0.014)) for f in range(n) for k in range(size)]


@pytest.mark.parametrize("block,set_bytes", [(1 << 12, 16 << 20), (7, 4000)])
def test_every_link_in_a_band_counts(spark, monkeypatch, block, set_bytes):
    """Also links to texts that are neither a band's least nor among the next in its order."""
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(minhash, "SET_BYTES", set_bytes, raising=False)
    rows = chained(6, 40)
    class_of = {i: i for i, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if b < a and class_of[a] != class_of[b] and similarity(x, y) >= 0.8:
                old, new = sorted((class_of[a], class_of[b]), reverse=True)
                class_of = {i: new if c == old else c for i, c in class_of.items()}
    assert len(set(class_of.values())) == 11
    assert {r.doc_id: r.class_id for r in minhash.op13_fingerprints(documents(spark, rows)).collect()} == class_of


def test_no_link_below_the_threshold(spark):
    base = prose(77, 150)
    rows = [(1, base), (2, variant(5, base, 0.2))]
    assert similarity(base, rows[1][1]) < 0.8
    assert {r.class_id for r in minhash.op13_fingerprints(documents(spark, rows)).collect()} == {1, 2}
