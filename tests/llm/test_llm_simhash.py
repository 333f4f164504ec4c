"""SimHash near-dedup against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.graph import components
from llm_cases import ODD, documents, prose


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, max_bits):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("k", [1, 3])
def test_fingerprint_bytes_equals_plain(k):
    for text in (None, "", " ", "one", "one Two", "a b c", "É a É b É c", prose(3), "\x1c a \x85 b", "x y z " * 50):
        got = simhash.fingerprint_bytes(None if text is None else text.encode(), k) & (1 << 64) - 1
        assert got == plain_fingerprint(text, k)


def test_odd_rows(spark):
    rows = simhash.op1_simhash(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str)
    for d, f, c in by:
        assert f in {f"{plain_fingerprint(t):016x}" for i, t, *_ in ODD if i == d}
        if f == "0" * 16:
            assert c == 1  # null and wordless texts link like any other
    assert {c for d, f, c in by if d == 7} == {6}


def test_empty(spark):
    assert simhash.op1_simhash(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("max_bits,leaf", [(2, 4), (3, 16), (0, 4), (2, 512)])
def test_trie_links_connect_what_brute_force_does(spark, max_bits, leaf):
    r = random.Random(leaf)
    seeds = [r.getrandbits(64) for _ in range(120)]
    prints = seeds + [s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) for s in seeds for _ in range(2)]
    prints += [seeds[0] ^ (1 << b) for b in range(64)]  # a dense ball
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = components(simhash.trie_links(df, max_bits, leaf)).collect()
    got = {x.node: x.root for x in links}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    want = plain_components(prints, max_bits)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, []).append(s)
    for members in groups.values():
        roots = {got.get(m, m) for m in members}
        assert len(roots) == 1 and roots == {min(members)}


def test_frontier_is_split(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    a = np.sort(np.unique(np.random.default_rng(1).integers(0, 1 << 63, 60, dtype=np.uint64) >> np.uint64(54)))
    root = np.array([[0, 0, len(a), 0, len(a), 0]])
    got = {(int(i), int(j)) for x, y in simhash.trie_pairs(a, a, root, 2) for i, j in zip(x, y)}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(a)) if bin(int(a[i]) ^ int(a[j])).count("1") <= 2}


def test_keep_one_leaves_one_of_each_group(spark):
    rows = [(10, prose(5)), (11, prose(5)), (12, prose(6)), (12, prose(6)), (None, prose(7)), (None, prose(7)), (13, prose(8).upper()), (14, prose(8))]
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [10, 12, 13]
    assert kept.where("doc_id is null").count() == 1


def test_many_copies_without_an_id_leave_one(spark):
    rows = [(None, prose(5))] * 50 + [(None, prose(5).upper())] * 3 + [(None, None)] * 4 + [(None, prose(6)), (9, prose(6))]
    kept = simhash.keep_one(documents(spark, rows).repartition(7)).collect()
    assert len(kept) == 3 and sorted((r.doc_id, (r.text or "").lower()) for r in kept if r.doc_id) == [(9, prose(6))]
    assert sorted((r.text or "").lower() for r in kept if not r.doc_id) == ["", prose(5)]


def test_keep_one_knows_documents_by_id_and_text(spark):
    a, b, c, d = prose(21), prose(22), prose(23), prose(24)
    rows = [(3, a), (5, a.upper()), (5, b), (5, b), (7, b.upper()), (8, c), (8, d), (None, a), (None, b.upper()), (None, prose(25))]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (8, c), (8, d), (None, prose(25))], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
