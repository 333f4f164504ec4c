"""Token ids, packed into rows of fixed length by best-fit decreasing.

Texts are encoded with a public byte-level vocabulary (a rank file, given by
path), each document closed by the id `eos`.  A document longer than a row is
split without loss into pieces of a row's length and a rest.  Pieces are dealt by
a hash of document, piece number and content into shards of about `shard_bytes` of
text, so that a long document, a large source or rows that share a doc_id spread
over many.  Rows equal in doc_id and text whose equal pieces make up more than 1 / `HEAVY`
of a shard are encoded once and their copies, numbered, are dealt apart.  Within a shard,
pieces in falling length go to the open row with the least room that is still
enough, found by a successor search in a segment tree over capacities.

A packed row holds its ids padded with `eos` to the row length, the cumulative
lengths of its segments (the last is the number of ids in use), and position ids
that start again at 0 with each segment.  Ids and positions are little-endian
unsigned 16-bit where the vocabulary and the row length allow, else 32-bit; the
rows of a shard in order are its id matrix.

Defined results: null or empty text has no ids and is in no row; rows with equal
or null doc_id are packed as documents of their own; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bitmap, marked, prepare, small, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's text is split before merging (see the vocabulary's description).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOS = 50256
ROW = 2048
PER_PARTITION = 256  # shards: a task packs one after the other
SHARD_BYTES = 1 << 20
HEAVY = 8      # equal rows are counted and dealt copy by copy if one piece of each makes more than shard_bytes / HEAVY in all
BLOCK = 1024   # copies of a piece made by one task at a time
BROADCAST_ROWS = 200_000
SCHEMA = ("shard long, row int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, n_tokens int, "
          "ids binary, positions binary")


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary; read once in a Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(eos: int, row: int) -> str:
    return "<u2" if max(eos, row) < 1 << 16 else "<u4"


class Capacities:
    """Segment tree over remaining capacities 0..top: how many open rows have each."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of an open row with the least capacity that is at least `need`; it is removed."""
        at = need + self.size
        while not self.count[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
            if not at:
                return None
            at += 1  # the right sibling
            if at == 1:
                return None
        while at < self.size:
            at *= 2
            if not self.count[at]:
                at += 1
        capacity = at - self.size
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], row: int) -> list[int]:
    """The row of each piece (lengths in falling order, at most `row`)."""
    open_rows, out, n = Capacities(row), [], 0
    for need in lengths:
        found = open_rows.take(need)
        if found is None:
            found, n = (row, n), n + 1
        capacity, at = found
        out.append(at)
        if capacity > need:
            open_rows.add(capacity - need, at)
    return out


def pieces(docs: DataFrame, path: str, row: int, eos: int) -> DataFrame:
    """(doc_id, piece, n, ids, th, copies): the ids of every document (doc_id, text, th, copies) in pieces of at most `row`."""
    kind = id_type(eos, row)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = encoding(path)
        for batch in batches:
            out = []
            for doc_id, text, th, copies in zip(batch["doc_id"], batch["text"], batch["th"], batch["copies"]):
                ids = np.array([*ranks.encode_ordinary(text), eos], dtype=kind)
                out += [(doc_id, k, len(part), part.tobytes(), th, copies) for k, at in enumerate(range(0, len(ids), row))
                        for part in (ids[at:at + row],)]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "n", "ids", "th", "copies"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", "th", "copies") \
        .mapInPandas(encode, "doc_id long, piece int, n int, ids binary, th long, copies long")


def _dealt(docs: DataFrame, path: str, row: int, eos: int, shard_bytes: int) -> DataFrame:
    """The pieces of every row, with copy: a number among rows equal in doc_id and text (0 for all where these are few)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("th")).where("text <> ''")
    heavy = rows.groupBy("th").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")) \
        .where((F.col("n") > 1) & (F.col("n") * F.least("size", F.lit(4 * row)) > shard_bytes / HEAVY))
    heavy = stored(heavy.select("th"), "heavy")
    if not heavy.take(1):
        return pieces(rows.withColumn("copies", F.lit(1).cast("long")), path, row, eos).withColumn("copy", F.lit(0).cast("long"))
    # only rows whose hash the bitmap holds are looked up
    rows = marked(rows, F.col("th"), bitmap(heavy.select(F.col("th").alias("h")), "heavy-bitmap"))
    heavy = small(heavy, BROADCAST_ROWS)
    looked = rows.where("_marked")
    few = rows.where("not _marked").drop("_marked").unionAll(looked.join(heavy, "th", "left_anti").select("doc_id", "text", "th"))
    few = pieces(few.withColumn("copies", F.lit(1).cast("long")), path, row, eos).withColumn("copy", F.lit(0).cast("long"))
    # equal rows are combined before the exchange and encoded once; the copies are made of pieces, block by block
    many = looked.join(heavy, "th", "left_semi").groupBy("doc_id", "text", "th").agg(F.count("*").alias("copies"))
    many = pieces(many, path, row, eos).withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BLOCK})"))) \
        .repartition("th", "piece", "block")
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(block * {BLOCK}, least(copies, (block + 1) * {BLOCK}) - 1)"))).drop("block")
    return few.unionAll(many)


def pack(docs: DataFrame, path: str = VOCABULARY, row: int = ROW, eos: int = EOS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per packed row (SCHEMA): doc_ids and pieces name its segments in order."""
    prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    kind = id_type(eos, row)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        # falling length; ties by document and piece, so that a second run packs alike
        pdf = pdf.sort_values(["n", "doc_id", "piece", "ids"], ascending=[False, True, True, True], kind="stable")
        rows = best_fit_decreasing(pdf["n"].tolist(), row)
        segments: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            segments.setdefault(r, []).append(i)
        doc_ids, numbers, ns, ids = (pdf[c].tolist() for c in ("doc_id", "piece", "n", "ids"))
        out = []
        for r, own in segments.items():
            lengths = [ns[i] for i in own]
            ends = np.cumsum(lengths)
            used = int(ends[-1])
            line = np.full(row, eos, kind)
            line[:used] = np.frombuffer(b"".join(ids[i] for i in own), kind)
            starts = np.repeat(ends - lengths, lengths)
            positions = np.zeros(row, kind)
            positions[:used] = np.arange(used) - starts
            positions[used:] = np.arange(row - used)  # padding is a segment of its own
            out.append((int(pdf["shard"].iloc[0]), r, [None if pd.isna(doc_ids[i]) else int(doc_ids[i]) for i in own],
                        [numbers[i] for i in own], [0, *ends.tolist()], used, line.tobytes(), positions.tobytes()))
        return pd.DataFrame(out, columns=["shard", "row", "doc_ids", "pieces", "cu_seqlens", "n_tokens", "ids", "positions"])

    dealt = _dealt(docs, path, row, eos, shard_bytes).withColumn("shard", F.pmod(F.xxhash64("th", "piece", "copy"), F.lit(shards)))
    dealt = dealt.select("doc_id", "piece", "n", "ids", "shard")
    # partitions of about PER_PARTITION shards; fewer shards each only as long as tasks would be left without work
    tasks = max(shards // PER_PARTITION, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(max(1, min(shards // 8, tasks)), "shard").groupBy("shard").applyInPandas(packed, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, shard by shard and row by row (binary columns: one matrix line each)."""
    packed.sortWithinPartitions("shard", "row").write.parquet(path)


def unpacked(packed: DataFrame, path: str = VOCABULARY, row: int = ROW, eos: int = EOS) -> DataFrame:
    """(doc_id, text) again from packed rows (documents with distinct ids): the lossless round trip."""
    kind = id_type(eos, row)
    seg = packed.select("doc_ids", "pieces", "cu_seqlens", "ids", F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1)).alias("s"))
    width = np.dtype(kind).itemsize
    at, end = F.get("cu_seqlens", F.col("s")), F.get("cu_seqlens", F.col("s") + 1)
    seg = seg.select(F.get("doc_ids", F.col("s")).alias("doc_id"), F.get("pieces", F.col("s")).alias("piece"),
                     F.substring(F.col("ids"), at * width + 1, (end - at) * width).alias("ids"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("piece")["ids"])
        ids = np.frombuffer(raw, kind)[:-1].tolist()
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "text": [encoding(path).decode(ids)]})

    return seg.groupBy("doc_id").applyInPandas(join, "doc_id long, text string")


def op4_pack(docs: DataFrame) -> DataFrame:
    """The query's rows: every packed row."""
    return pack(docs)
