"""SimHash near-duplicates by a binary trie self-join.

Every text gets a 64-bit fingerprint: each bit is the majority of that bit over
the hashes of all word shingles.  Documents link when their fingerprints differ
in at most `max_bits` bits; linked documents form components.

The distinct fingerprints are the leaves of a binary trie.  The self-join walks
pairs of trie nodes from the root down, adds up the bits in which the two
prefixes differ, and drops a pair as soon as that exceeds the error budget.  The
upper levels are DataFrame joins of node counts, `STRIDE` bits at a step; a pair
whose nodes are small is left to one task, which goes on down to the leaves with
numpy.  A task returns a spanning forest of the links it found, never all pairs.

Defined results: null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle of the whole sequence; rows
with equal or null doc_id are rows of their own; an empty table gives no rows;
only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bitmap, marked, prepare, stored
from lectern.llm.graph import components

SEED = 42
BITS = 64
STRIDE = 4
LEAF = 512          # a node with at most so many fingerprints is not split further
FRONTIER = 1 << 18  # node pairs that a task holds at once


def fingerprint_bytes(raw: bytes | None, shingle: int) -> int:
    """SimHash of one text in UTF-8 (only A-Z are lower-cased), as a signed 64-bit integer."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, fp) for every row of documents; th: a hash of doc_id and text."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_bytes(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("th"), simhash(F.col("text").cast("binary")).alias("fp"))


def trie_pairs(a: np.ndarray, b: np.ndarray, roots: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i], b[j] within `max_bits` bits, below the given node pairs.

    `a` and `b` are sorted uint64; a trie node is a range of equal prefixes.
    roots: rows (depth, first and end in a, first and end in b, differing bits).
    Pairs of nodes go down one bit at a time; at most FRONTIER of them are
    expanded together, the rest waits on a stack, so memory stays bounded.
    """
    stack = [roots]
    while stack:
        at = stack.pop()
        if len(at) > FRONTIER:
            stack.append(at[FRONTIER:])
            at = at[:FRONTIER]
        depth = at[0, 0]
        if (other := at[:, 0] != depth).any():
            stack.append(at[other])
            at = at[~other]
        if depth == BITS:
            yield at[:, 1], at[:, 3]
            continue
        bit = np.uint64(1 << (BITS - 1 - int(depth)))
        upper = ~np.uint64((int(bit) << 1) - 1)

        def halves(side: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            mid = np.searchsorted(side, (side[lo] & upper) | bit).astype(np.int64)
            return [(lo, mid), (mid, hi)]

        below = []
        sides_b = halves(b, at[:, 3], at[:, 4])
        for x, (la, ha) in enumerate(halves(a, at[:, 1], at[:, 2])):
            for y, (lb, hb) in enumerate(sides_b):
                err = at[:, 5] + (x != y)
                ok = (la < ha) & (lb < hb) & (err <= max_bits)
                if ok.any():
                    below.append(np.column_stack((np.full(ok.sum(), depth + 1), la[ok], ha[ok], lb[ok], hb[ok], err[ok])))
        if below:
            stack.append(np.concatenate(below))


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> dict[int, int]:
    """Node -> root of its tree, for the nodes below n that some pair joins."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    seen: set[int] = set()
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = root(i), root(j)
            if x != y:
                up[max(x, y)] = min(x, y)
                seen.update((i, j))
    return {x: root(x) for x in seen}


def _node(depth: int):
    """The trie node of a fingerprint at `depth`: its first bits as a number."""
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def trie_links(fps: DataFrame, max_bits: int, leaf: int = LEAF, stride: int = STRIDE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints `fps` (fp) within `max_bits` bits."""
    near = lambda d, a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    depth, work = 0, None
    pairs = fps.agg(F.count("*").alias("na")).select(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "na", F.col("na").alias("nb"))
    while True:
        if depth + stride > BITS - 1:
            split, done = None, pairs
        else:
            split = pairs.where((F.col("na") > leaf) | (F.col("nb") > leaf))
            done = pairs.where((F.col("na") <= leaf) & (F.col("nb") <= leaf))
        # the pair is worked on where its owner's fingerprints are; which of the two owns it is dealt by a hash
        own = F.xxhash64("a", "b").bitwiseAND(1) == 0
        tasks = done.where("na > 0").select(
            F.lit(depth).alias("depth"), F.when(own, F.col("a")).otherwise(F.col("b")).alias("owner"),
            F.when(own, F.col("b")).otherwise(F.col("a")).alias("guest"))
        work = tasks if work is None else work.unionAll(tasks)
        if split is None or not split.take(1):
            break
        depth += stride
        nodes = stored(fps.groupBy(_node(depth).alias("node")).agg(F.count("*").alias("n")), "nodes")
        kids = nodes.withColumn("up", F.shiftrightunsigned("node", stride))
        left = kids.select(F.col("up").alias("a"), F.col("node").alias("a2"), F.col("n").alias("na"))
        right = kids.select(F.col("up").alias("b"), F.col("node").alias("b2"), F.col("n").alias("nb"))
        pairs = stored(split.select("a", "b").join(left, "a").join(right, "b")
                       .where((F.col("a2") <= F.col("b2")) & (near(depth, "a2", "b2") <= max_bits))
                       .select(F.col("a2").alias("a"), F.col("b2").alias("b"), "na", "nb"), "pairs")
    # an owner's own fingerprints come as guests of itself
    work = stored(work.unionAll(work.select("depth", "owner", F.col("owner").alias("guest"))).distinct(), "tasks")
    depths = [r[0] for r in work.select("depth").distinct().collect()]  # one for each step down
    at = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _node(d).alias("guest"))
                                             for d in sorted(depths)])).alias("n")).select("fp", "n.*") if depths else None
    if at is None:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    dealt = at.join(work, ["depth", "guest"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        depth, owner = int(pdf["depth"].iloc[0]), np.uint64(pdf["owner"].iloc[0])
        b = np.sort(fp)
        node = b >> np.uint64(BITS - depth) if depth else np.zeros(len(b), np.uint64)
        a = b[node == owner]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        end = np.r_[first[1:], len(b)]
        err = np.bitwise_count(node[first] ^ owner).astype(np.int64)
        roots = np.column_stack((np.full(len(first), depth), np.zeros(len(first), np.int64),
                                 np.full(len(first), len(a)), first, end, err))
        shift = int(np.searchsorted(node, owner))  # a[i] is b[i + shift]
        trees = forest(((i + shift, j) for i, j in trie_pairs(a, b, roots, max_bits)), len(b))
        out = [(x, r) for x, r in trees.items() if x != r]
        return pd.DataFrame({"u": b[[x for x, _ in out]].view(np.int64), "v": b[[r for _, r in out]].view(np.int64)})

    return dealt.groupBy("depth", "owner").applyInPandas(links, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, leaf: int = LEAF) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of `docs`; th: a hash of doc_id and text.

    root is the least fingerprint (as a signed number) of the component,
    component_id its least doc_id (null if it has none).
    """
    prepare(docs.sparkSession)
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    comps = components(stored(trie_links(distinct.select("fp"), max_bits, leaf), "links"))
    roots = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(roots, "roots")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "root", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """`docs` with one document of each component: the one with the least doc_id, of several texts of that doc_id
    the one with the least hash; rows without a doc_id come after all others.

    A document is known by doc_id and text: other text under the same doc_id is a document of its own, and repeated
    rows, with a doc_id or without, count as one.
    """
    key = {"_no": F.col("doc_id").isNull(), "_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))}
    rows = near_duplicates(docs, shingle, max_bits).withColumns(key).withColumnRenamed("th", "_th")
    place = ["_no", "_did", "_th"]
    keys = stored(rows.groupBy(*place).agg(F.count("*").alias("n"), F.min("root").alias("root")), "members")
    best = keys.groupBy("root").agg(F.min(F.struct(*place)).alias("best"))
    keys = keys.join(best, "root").withColumn("keep", F.struct(*place) == F.col("best"))
    keys = stored(keys.select(*place, "n", "keep").where("n > 1 or not keep"), "looked-at")
    # only texts that may go, or that are there again, are shuffled
    whole = marked(docs.withColumns(key).withColumn("_th", F.xxhash64("doc_id", "text")), F.col("_th"), bitmap(keys.select(F.col("_th").alias("h")), "looked-at-bitmap"))
    left = whole.where("_marked").join(keys.where("not keep").select(*place).hint("merge"), place, "left_anti")
    left = left.withColumn("_nth", F.row_number().over(Window.partitionBy(*place).orderBy("_th"))).where("_nth = 1")
    return whole.where("not _marked").select(*docs.columns).unionAll(left.select(*docs.columns))


def op1_simhash(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
