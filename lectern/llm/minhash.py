"""Document fingerprints by MinHash, and near duplicates by bands of them.

A text's words (ASCII white space between them, A-Z lower-cased) give the set of
its 5-word shingles; fewer words are one shingle, no words none.  A word is
hashed once, shingle hashes (32 bits) are put together from word hashes in numpy,
and `PERMUTATIONS` multiply-add functions modulo 2^32 (odd multipliers, so each
permutes the hashes) are applied to all of them at once; the least value of each is
a place of the signature, of which 16 bits are kept.  Likeness of two fingerprints
is the share of equal places, an estimate of the Jaccard similarity of the sets.

*Edited texts.*  The next document in ascending doc_id is found without a global
window: a bounded, evenly spaced selection of the keys (doc_id, text hash) cuts
the order into buckets; every bucket is sorted and read as a stream by one task,
and the row at a cut travels to the bucket before it as well, as what follows its
last row.  Texts are shuffled once, compressed.

*Near duplicates.*  Signatures are cut into `BANDS` bands of `ROWS` places; texts
that share a band are joined in Spark, first to one of them, its leader.  Bands whose texts
are not of one class after that are put in the order of the places that follow the
band, where like texts stand together, and each text is paired with the next
`NEXT`.  What is then left is compared whole: in bands that still hold several classes every two
texts of different classes meet, on a grid of tasks that hold two bounded blocks of a band
(`BLOCK` signatures, then `SET_BYTES` of the shingle sets of texts that may link).
Pairs whose signatures agree in far too few places are dropped
(`SLACK` below the threshold: over five standard deviations); the others are
verified by the exact Jaccard similarity of their shingle sets (at least `THRESHOLD`),
and verified links are closed to classes.  So no link of texts that share a band is left out of the classes;
the first two steps only spare comparisons.  Recall against brute force is measured in the tests.

Defined results: null text is empty; texts without words have equal
fingerprints, like each other entirely, and form a class of equal texts only;
documents are ordered by doc_id (null last), then by text hash, so rows that
share a doc_id are neighbours and equal rows follow one another; the only
document follows itself; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.llm.common import bitmap, marked, prepare, stored
from lectern.llm.graph import components

SHINGLE = 5
PERMUTATIONS = 100
BANDS, ROWS = 20, 5
THRESHOLD = 0.8
SLACK = 0.22               # of the signatures' likeness below the threshold
NEXT = 2
BLOCK = 1 << 12            # signatures of a band's texts that one side of a task holds
SET_BYTES = 16 << 20       # shingle sets that one side of a task holds, about
SEED = 42
WORDS_KEPT = 1 << 18       # word hashes that a task remembers
AT_ONCE = 1 << 12          # shingles that are permuted together
BUCKET_BYTES = 4 << 20     # text in a bucket, about
MAX_BUCKETS = 1 << 15      # cuts that the driver and every task hold; beyond it buckets grow
PER_BUCKET = 4             # keys looked at for each cut

_ODD, _ADD = (np.random.default_rng(SEED + k).integers(0, 1 << 32, PERMUTATIONS, np.uint32) for k in (0, 1))
_ODD |= np.uint32(1)
_MIX = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)]


class Words(dict):
    """Hash of a word (bytes), remembered; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One 32-bit number for each shingle, in text order, repeats included."""
    if not len(words):
        return words.astype(np.uint32)
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        h += words[k:k + n] * np.uint64(_MIX[k])
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(_MIX[0])) >> np.uint64(32)).astype(np.uint32)


def least(hashes: np.ndarray) -> np.ndarray:
    """The least value of every permutation; the largest number for no shingles."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), AT_ONCE):
        part = _ODD[:, None] * hashes[None, at:at + AT_ONCE]
        part += _ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def folded(mins: np.ndarray) -> np.ndarray:
    """16 bits of each place, mixed from all 32."""
    return ((mins * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def fingerprint(text: str | None) -> str:
    """Four hex digits a place."""
    return folded(least(shingle_hashes(Words().of((text or "").encode())))).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


# ---- edited texts ----

def _keyed(docs: DataFrame) -> DataFrame:
    """(nil, did, th, text): the order's key and the text's bytes."""
    did = F.col("doc_id").cast("long")
    return docs.select(did.isNull().alias("nil"), F.coalesce(did, F.lit(0)).alias("did"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _cuts(keys: DataFrame) -> list[tuple[bool, int, int]]:
    """First keys of the buckets: the least key of all, and every PER_BUCKET-th of the keys that a hash selects."""
    first = keys.agg(F.min(F.struct("nil", "did", "th")).alias("k"), F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not first.n:
        return []
    buckets = max(1, min(MAX_BUCKETS, first["size"] // BUCKET_BYTES))
    every = max(1, first.n // (buckets * PER_BUCKET))
    picked = keys.where(F.pmod(F.xxhash64("did", "th"), F.lit(every)) == 0).select("nil", "did", "th").distinct().collect() if buckets > 1 else []
    picked = sorted(tuple(r) for r in picked)
    step = max(1, len(picked) // buckets)
    return sorted({tuple(first.k), *picked[::step]})


def edits(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    classes: (doc_id, th, class_id) of the documents that stand in a class with others; of the rest class_id is doc_id.
    These narrow rows are dealt and sorted with the texts, each before the rows it belongs to.
    """
    rows = _keyed(docs)
    keys = stored(rows.select("nil", "did", "th", F.octet_length("text").alias("size")), "keys")
    cuts = _cuts(keys)
    rows = rows.withColumn("class_id", F.lit(None).cast("long"))
    if classes is not None:
        did = F.col("doc_id")
        rows = rows.unionAll(classes.select(did.isNull(), F.coalesce(did, F.lit(0)), "th", F.lit(None).cast("binary"), "class_id"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, gone, first = zstandard.ZstdCompressor(level=3), set(), set(cuts)
        for batch in batches:
            out = []
            for nil, did, th, text, class_id in zip(*(c.to_pylist() for c in batch.columns)):
                key, blob = (nil, did, th), None if text is None else pack.compress(text)
                at = bisect_right(cuts, key) - 1
                out.append((at, False, *key, blob, class_id))
                if blob is not None and key in first and key not in gone:
                    gone.add(key)
                    out.append(((at - 1) % len(cuts), True, *key, blob, None))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "follows", "nil", "did", "th", "blob", "class_id"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, words, now, told = zstandard.ZstdDecompressor(), Words(), None, ()
        for batch in batches:
            out = []
            for _, follows, nil, did, th, blob, class_id in zip(*(c.to_pylist() for c in batch.columns)):
                key = (nil, did, th)
                if blob is None:
                    told = (key, class_id)
                elif not follows or now is not None:  # a bucket's last row is followed once
                    nxt = Document(unpack.decompress(blob).decode(), words)
                    if now is not None:
                        out.append((*head, *now.compared(nxt, words), its_class))
                    now, head = None if follows else nxt, (None if nil else did,)
                    its_class = class_id_of(told, key)
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))

    def class_id_of(told: tuple, key: tuple) -> int | None:
        return told[1] if told and told[0] == key else None if key[0] else key[1]

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
             "near_edited": pa.float64(), "near_next": pa.float64(), "class_id": pa.int64()}
    dealt = rows.mapInArrow(deal, "bucket int, follows boolean, nil boolean, did long, th long, blob binary, class_id long")
    dealt = dealt.repartitionById(max(1, len(cuts)), F.col("bucket")).sortWithinPartitions("bucket", "follows", "nil", "did", "th", F.col("blob").isNotNull())
    return dealt.mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


class Document:
    """A text in the stream and its signature."""

    def __init__(self, text: str, words: Words):
        self.text, self.cut = text, len(text) - len(text) // 2
        hashes = shingle_hashes(words.of(text.encode()))
        # shingles wholly inside the half that stays are those of the edited text too
        whole = len(text[:self.cut].encode().lower().split()) - 1
        self.same = max(0, whole - SHINGLE + 1)
        self.head = least(hashes[:self.same])
        self.mins = folded(np.minimum(self.head, least(hashes[self.same:])))

    def compared(self, following: Document, words: Words) -> tuple:
        """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
        edited = (self.text[:self.cut] + following.text[:len(self.text) // 2]).encode()
        mins = folded(np.minimum(self.head, least(shingle_hashes(words.of(edited))[self.same:])))
        string = lambda m: m.astype(">u2").tobytes().hex()
        return (len(self.text), hashlib.sha256(edited).hexdigest(), string(self.mins), string(mins),
                likeness(self.mins, mins), likeness(self.mins, following.mins))


# ---- near duplicates ----

def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, sig) of every row; sig: the signature as bytes, null for texts without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = Words(), {}
        for batch in batches:
            sigs = []
            for th, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if len(done) >= WORDS_KEPT >> 4:
                    done.clear()
                if th not in done:  # copies often stand together
                    hashes = shingle_hashes(words.of(text))
                    done[th] = folded(least(hashes)).tobytes() if len(hashes) else None
                sigs.append(done[th])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sigs, pa.binary())], names=["nil", "did", "th", "sig"])

    out = _keyed(docs).mapInArrow(sign, "nil boolean, did long, th long, sig binary")
    return out.select(F.when(~F.col("nil"), F.col("did")).alias("doc_id"), "th", "sig")


def shared_bands(texts: DataFrame) -> DataFrame:
    """(band, at, th, after) of the bands that two of `texts` (th, sig) or more share; after: the places that follow the band; stored."""
    wide = 2 * ROWS
    at = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("at")
    bands = texts.select("th", "sig", at).select(
        F.xxhash64("at", F.expr(f"substring(sig, at * {wide} + 1, {wide})")).alias("band"), "at", "th",
        F.expr(f"substring(concat(sig, sig), (at + 1) * {wide} + 1, {2 * wide})").alias("after"))
    met = bands.groupBy("band").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("band")
    met = stored(met, "met")
    # only rows of such bands are shuffled again
    likely = marked(bands, F.col("band"), bitmap(met.select(F.col("band").alias("h")), "met-bitmap")).where("_marked").drop("_marked")
    return stored(likely.join(met, "band", "left_semi"), "bands")


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal places of two signatures."""
    read = lambda c: np.frombuffer(b"".join(c), np.uint16).reshape(len(c), -1)
    return pd.Series((read(a) == read(b)).mean(axis=1) if len(a) else [], dtype="float64")


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingle hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([resemblance(x, y) for x, y in zip(a, b)], dtype="float64")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, own): the shingle hashes of the texts `wanted` (th), each once, as bytes; stored."""
    rows = marked(_keyed(docs), F.col("th"), bitmap(wanted.select(F.col("th").alias("h")), "wanted-bitmap")).where("_marked").select("th", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = Words(), set()
        for batch in batches:
            th, own = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(done) >= WORDS_KEPT:
                    done.clear()
                if t not in done:
                    done.add(t)
                    th.append(t)
                    own.append(np.unique(shingle_hashes(words.of(text))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(own, pa.binary())], names=["th", "own"])

    return stored(rows.mapInArrow(shingles, "th long, own binary").dropDuplicates(["th"]).join(wanted, "th", "left_semi"), "sets")


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of texts whose shingle sets have at least `threshold` Jaccard similarity; stored."""
    def beside(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
        met = pairs.join(table.select(F.col("th").alias("u"), F.col(what).alias("_a")), "u")
        return met.join(table.select(F.col("th").alias("v"), F.col(what).alias("_b")), "v")

    likely = beside(pairs, texts, "sig").where(agreement("_a", "_b") >= threshold - SLACK).select("u", "v")
    likely = stored(likely, "likely")
    wanted = likely.select(F.col("u").alias("th")).unionAll(likely.select(F.col("v").alias("th"))).distinct()
    return stored(beside(likely, shingle_sets(docs, stored(wanted, "wanted")), "own").where(jaccard("_a", "_b") >= threshold).select("u", "v"), "links")


def tiles(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """`rows` (band, th, ...) dealt to tasks: the rows of a band go to blocks x of about `most` weight, and each row to
    every pair of blocks i <= j that has its own.  Sorted, so that a tile (band, i, j) is read as a stream."""
    blocks = rows.groupBy("band").agg(F.ceil(F.sum(weight) / most).alias("blocks"))
    dealt = rows.join(blocks, "band").withColumn("x", F.pmod(F.xxhash64("th"), F.col("blocks")))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x",
                         *[c for c in rows.columns if c != "band"])
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "x")


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of every tile."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now:
                if rows:
                    yield dict(zip(names, zip(*rows)))
                now, rows = row[:3], []
            rows.append(row)
    if rows:
        yield dict(zip(names, zip(*rows)))


def contested(tile: dict[str, list], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(p, qs): texts of a tile of different roots whose signatures agree in at least the share `least`.  Texts that share
    several bands count in the first of them; it too holds both roots, so it is compared."""
    n, x, at = len(tile["th"]), np.array(tile["x"]), tile["at"][0]
    sigs, root = np.frombuffer(b"".join(tile["sig"]), np.uint16).reshape(n, -1), np.array(tile["root"])
    bands = sigs.reshape(n, BANDS, ROWS)
    one = tile["i"][0] == tile["j"][0]
    ours = n if one else int(np.searchsorted(x, tile["j"][0]))
    for p in range(ours):
        start = p + 1 if one else ours
        qs = start + np.flatnonzero(root[start:] != root[p])
        qs = qs[(sigs[qs] == sigs[p]).sum(axis=1) / PERMUTATIONS >= least]
        if len(qs):
            shared = (bands[qs] == bands[p]).all(axis=2)
            qs = qs[shared[:, at] & ~shared[:, :at].any(axis=1)]
        if len(qs):
            yield p, qs


def remaining_links(docs: DataFrame, texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that join all classes of `members` (band, at, th, root) that some link of texts of one band joins; stored."""
    least = threshold - SLACK

    def open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiled(batches):
            found = sorted({int(k) for p, qs in contested(tile, least) for k in (p, *qs)})
            if found:
                cols = {c: pa.array([tile[c][k] for k in found], t) for c, t in (("band", pa.int64()), ("at", pa.int32()), ("th", pa.int64()), ("root", pa.int64()))}
                yield pa.RecordBatch.from_pydict(cols)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiled(batches):
            up, out = {}, []

            def top(r: int) -> int:
                while r in up:
                    r = up[r]
                return r

            own, root, th = tile["own"], tile["root"], tile["th"]
            for p, qs in contested(tile, least):
                for q in qs.tolist():
                    a, b = top(root[p]), top(root[q])
                    sizes = len(own[p]), len(own[q])
                    if a != b and min(sizes) / max(sizes) >= threshold and resemblance(own[p], own[q]) >= threshold:
                        up[max(a, b)] = min(a, b)
                        out.append((th[p], th[q]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    rows = members.select("band", "at", "th", "root").join(texts, "th")
    found = tiles(rows, F.lit(1), BLOCK).mapInArrow(open_texts, "band long, at int, th long, root long")
    found = stored(found.distinct(), "open")
    sets = shingle_sets(docs, stored(found.select("th").distinct(), "wanted"))
    rows = found.join(texts, "th").join(sets, "th")
    return stored(tiles(rows, F.octet_length("own"), SET_BYTES).mapInArrow(links, "u long, v long"), "links")


def unsettled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(th, root) of the texts that `links` join, and the rows of bands whose texts are not of one class, with root; stored."""
    roots = stored(components(links).withColumnRenamed("node", "th"), "roots")
    members = members.drop("root").join(roots, "th", "left").withColumn("root", F.coalesce("root", "th"))
    several = members.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
    return roots, stored(members.join(several, "band", "left_semi"), "unsettled")


def near_links(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(th, root) of the texts that verified links join; root is the least text hash of the class."""
    texts = stored(signed.where("sig is not null").groupBy("th").agg(F.first("sig").alias("sig")), "texts")
    members = shared_bands(texts)
    some = stored(texts.join(members.select("th").distinct(), "th", "left_semi"), "sharing")
    led = members.groupBy("band").agg(F.min("th").alias("leader"))
    pairs = members.join(led, "band").where("th <> leader").select(F.col("th").alias("u"), F.col("leader").alias("v")).distinct()
    links = verified(docs, some, stored(pairs, "led"), threshold)
    roots, members = unsettled(members, links)
    order = Window.partitionBy("band").orderBy("after", "th")
    nexts = F.array(*[F.lead(F.struct("th", "root"), k).over(order) for k in range(1, NEXT + 1)])
    pairs = members.withColumn("nexts", nexts).select("th", "root", F.explode("nexts").alias("n")).where("root <> n.root")
    pairs = stored(pairs.select(F.least("th", F.col("n.th")).alias("u"), F.greatest("th", F.col("n.th")).alias("v")).distinct(), "neighbours")
    more = verified(docs, some, pairs, threshold)
    if more.take(1):
        links = links.unionAll(more)
        roots, members = unsettled(members, links)
    rest = remaining_links(docs, some, members, threshold)
    return stored(components(links.unionAll(rest)).withColumnRenamed("node", "th"), "roots") if rest.take(1) else roots


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, class_id) of documents whose text occurs more than once or links with another: class_id is the
    least doc_id of the class (null if it has none)."""
    prepare(docs.sparkSession)
    signed = stored(signatures(docs), "signatures")
    roots = near_links(docs, signed, threshold)
    texts = signed.groupBy("th").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    known = texts.join(roots, "th", "left").where("many > 1 or root is not null").withColumn("root", F.coalesce("root", "th"))
    known = stored(known, "known")
    classes = known.join(known.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("th", "class_id")
    return signed.select("doc_id", "th").distinct().join(classes, "th").select("doc_id", "th", "class_id")


def op13_fingerprints(docs: DataFrame) -> DataFrame:
    """The query's columns, and class_id: the least doc_id of the document's class of near duplicates."""
    prepare(docs.sparkSession)
    return edits(docs, stored(near_classes(docs), "classes"))
