"""Exact top-k items per query by dot product, pruned by bounds.

The reference scans every profile for every query.  Here the items are put into
cells around centroids (k-means over a bounded selection of items; every item is
assigned).  A cell keeps its radius, so that by Cauchy-Schwarz no item x of it can score above

    q . x  <=  q . centroid + |q| * radius.

A query's running threshold is the (k + extra)-th best score among the selected
items, which are items like all others, and then among all that it has met: no true candidate
lies below it.

Queries and items are dealt to a grid of `groups` x `slices` tasks.  A task holds the
queries of its group and reads the items of its slice as a stream, cell by cell: the queries whose
bound does not reach their threshold are left out, for the others the exact scores are one matrix
product, and k + extra candidates of a query are kept.  Where vectors are clustered most cells are
never met; where they point in all directions alike (then no exact bound helps) every cell is.  What is
shuffled is `groups` copies of the items and `slices` copies of the queries and of their
candidates; the grid with the least of it is taken.  No cross join, and memory does not depend on
the size of the tables: the more candidates there are in all, the more groups.

Exactness: a query row may carry `extra` = number of candidates a later
filter can remove (e.g. items the user already saw); k + extra candidates are kept
(plus scores that tie with the last within 1e-9; of entirely equal scores those with the least ids), so filtering afterwards still leaves the exact top k.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import stored

TIE_EPS = 1e-9
MAX_CELLS = 1024     # centroids held by every task
PER_CELL = 8         # selected items for each centroid
SELECTED = 1024      # selected items that give a query its threshold
LLOYD = 5            # k-means steps over the selected items
KEPT = 1 << 21       # candidates that the queries of a task keep, about
HELD_BYTES = 1 << 26  # query vectors that a task holds, about
SCORES = 1 << 20     # scores that are made at once
WORK = 1 << 22       # scores below which one more task is not worth while


def _centroids(x: np.ndarray, c: int) -> np.ndarray:
    """c centroids of the selected vectors x."""
    mu = x[:c].copy()
    for _ in range(LLOYD if c > 1 else 1):
        near = ((mu * mu).sum(axis=1) - 2 * x @ mu.T).argmin(axis=1)
        for j in range(c):
            if (own := near == j).any():
                mu[j] = x[own].mean(axis=0)
    return mu


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The vectors of the rows `at`, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    d = int(ends[at[0] + 1] - ends[at[0]])
    return flat[ends[at][:, None] + np.arange(d)]


def _by_length(column: pa.Array):
    """(length, rows) of each length of vector in a batch; empty and null vectors meet nothing."""
    n = np.diff(column.offsets.to_numpy())
    for d in np.unique(n[n > 0]):
        yield int(d), np.flatnonzero(n == d)


class Cells:
    """Centroids, radii and sizes of the cells of each vector length, and the selected items."""

    copies = 1  # most selected items of one id

    def __init__(self, selected: pa.Array, n: int, block_rows: int):
        self.block_rows = block_rows
        self.selected: dict[int, np.ndarray] = {}
        self.centroids: dict[int, np.ndarray] = {}
        self.sizes: dict[int, np.ndarray] = {}
        self.radii: dict[int, np.ndarray] = {}
        for d, at in _by_length(selected):
            x = _rows(selected, at).astype(np.float64)
            c = max(1, min(MAX_CELLS, len(x), math.ceil(n * len(x) / len(selected) / block_rows)))
            self.centroids[d], self.selected[d] = _centroids(x, c), x[:SELECTED]

    def centroids_of(self, d: int) -> np.ndarray:
        return self.centroids.get(d, np.zeros((1, d)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centroid) of every vector."""
        mu = self.centroids_of(x.shape[1])
        near = ((mu * mu).sum(axis=1) - 2 * x @ mu.T).argmin(axis=1)
        return near, np.sqrt(((x - mu[near]) ** 2).sum(axis=1))

    def learn(self, stats: list) -> None:
        for d in {r["_dim"] for r in stats}:
            c = len(self.centroids_of(d))
            self.sizes[d], self.radii[d] = np.zeros(c, np.int64), np.zeros(c)
        for r in stats:
            self.sizes[r["_dim"]][r["_cell"]], self.radii[r["_dim"]][r["_cell"]] = r["n"], r["radius"]

    def parts(self, d: int) -> np.ndarray:
        """Blocks in each cell."""
        return -(-self.sizes[d] // self.block_rows)

    def thresholds(self, q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The need-th best score among the selected items; minus infinity where there are not so many."""
        out = np.full(len(q), -np.inf)
        x = self.selected.get(q.shape[1])
        if x is not None and (some := np.flatnonzero(need <= len(x))).size:
            best = q[some] @ x.T
            best[~np.isfinite(best)] = -np.inf  # no candidates
            best.sort(axis=1)
            out[some] = best[np.arange(len(some)), len(x) - need[some]]
        return out

    def reached(self, q: np.ndarray, tau: np.ndarray, cell: int) -> np.ndarray:
        """Which queries must meet a cell; bounds that are no numbers exclude nothing."""
        d = q.shape[1]
        bound = q @ self.centroids_of(d)[cell] + np.sqrt((q * q).sum(axis=1)) * (self.radii[d][cell] * (1 + 1e-9))
        return ~(bound < tau - TIE_EPS * (1 + np.abs(bound)))

    def met(self, q: np.ndarray, tau: np.ndarray) -> np.ndarray:
        """Which cells each query must meet."""
        sizes = self.sizes[q.shape[1]]
        return np.column_stack([self.reached(q, tau, c) if sizes[c] else np.zeros(len(q), bool) for c in range(len(sizes))])


def _whole():
    return F.forall("_vec", lambda v: v.isNotNull())


def _selected(items: DataFrame, n: int, wanted: int) -> pa.Table:
    """The `wanted` rows (_iid, _vec, _whole) with the least hashes of ids, or about so many where ids are repeated.

    Only rows below a cut of the hash, about 2 * `wanted`, are sorted, and tasks do it: were every partition's best sent to
    the driver, that would be `wanted` vectors for each of them.
    """
    h = F.xxhash64("_iid")
    share = 2 * wanted / max(n, 1)
    few = items if share >= 1 else items.where(h < int(-(1 << 63) + share * (1 << 64)))
    return stored(few.select("_iid", "_vec", F.coalesce(_whole(), F.lit(False)).alias("_whole")).orderBy(h, "_iid").limit(wanted), "selected").toArrow()


def _cells(items: DataFrame, i_id: str, i_vec: str, block_rows: int) -> tuple[DataFrame, Cells, int]:
    """Items (_dim, _cell, _part, _iid, _vec) in their cells, the cells, and the number of items."""
    kind = dict(items.dtypes)[i_vec]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    items = stored(items.select(F.col(i_id).alias("_iid"), F.col(i_vec).cast(kind).alias("_vec")), "items")
    n = items.count()  # from the table's footers
    wanted = max(SELECTED, PER_CELL * min(MAX_CELLS, math.ceil(n / block_rows)))
    selected = _selected(items, n, wanted)
    cells = Cells(selected.filter(pc.field("_whole")).column("_vec").combine_chunks(), n, block_rows)
    cells.copies = max(Counter(selected.column("_iid").to_pylist()).values(), default=1)
    i_type = dict(items.dtypes)["_iid"]

    def assign(batches):
        for b in batches:
            for d, at in _by_length(b.column(1)):
                cell, far = cells.assign(_rows(b.column(1), at))
                own = b.take(pa.array(at))
                # a cell's blocks are known once its size is
                part = own.column(2).to_numpy() % cells.parts(d)[cell] if d in cells.sizes else np.zeros(len(at))
                cols = [own.column(0), own.column(1), *(pa.array(x.astype(np.int32)) for x in (np.full(len(at), d), cell, part)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(cols, names=["_iid", "_vec", "_dim", "_cell", "_part", "_far"])

    whole = items.where(_whole())
    placed = whole.withColumn("_h", F.xxhash64("_iid"))
    put = lambda: placed.mapInArrow(assign, f"_iid {i_type}, _vec {kind}, _dim int, _cell int, _part int, _far double")
    cells.learn(put().groupBy("_dim", "_cell").agg(F.count("*").alias("n"), F.max("_far").alias("radius")).collect())  # a row per cell
    return put().select("_dim", "_cell", "_part", "_iid", "_vec"), cells, n


def _asked(queries: DataFrame, q_id: str, q_vec: str, extra: str | None) -> DataFrame:
    more = F.col(extra).cast("long") if extra else F.lit(0).cast("long")
    return queries.select(F.col(q_id).alias("_qid"), F.col(q_vec).cast("array<double>").alias("_vec"), F.greatest(more, F.lit(0)).alias("_need"))


def plan_cells(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, q_vec: str, i_vec: str,
               extra: str | None = None, exclude_same_id: bool = False, block_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(item rows, query rows) by block (_dim, _cell, _part): what must meet for the exact top k by the first thresholds."""
    item_rows, cells, _ = _cells(items, i_id, i_vec, block_rows)
    q_type = dict(queries.dtypes)[q_id]

    def deal(batches):
        for b in batches:
            for d, at in _by_length(b.column(1)):
                if d not in cells.sizes:
                    continue
                q = _rows(b.column(1), at)
                need = b.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False) + k
                row, cell = np.nonzero(cells.met(q, cells.thresholds(q, need + exclude_same_id * cells.copies)))
                many = cells.parts(d)[cell]
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                cols = [pa.array(np.full(len(row), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), b.column(0).take(pa.array(at[row]))]
                yield pa.RecordBatch.from_arrays(cols, names=["_dim", "_cell", "_part", "_qid"])

    return item_rows, _asked(queries, q_id, q_vec, extra).mapInArrow(deal, f"_dim int, _cell int, _part int, _qid {q_type}")


def _grid(n_q: int, need: float, q_bytes: float, n_i: int, i_bytes: float, tasks: int) -> tuple[int, int]:
    """(groups of queries, slices of items): the least that is shuffled by so many tasks of bounded memory."""
    tasks = max(1, min(tasks, math.ceil(n_q * n_i / WORK)))
    least = max(1, math.ceil(n_q * need / KEPT), math.ceil(n_q * q_bytes / HELD_BYTES))
    shuffled = lambda g: g * n_i * (i_bytes + 40) + math.ceil(tasks / g) * n_q * (q_bytes + 40 + 40 * need)
    g = min(range(least, max(least, tasks) + 1), key=shuffled)
    return g, math.ceil(tasks / g)


class _Best:
    """The best candidates of a group's queries, all of one length, as items come by."""

    def __init__(self, ids: pa.Array, q: np.ndarray, need: np.ndarray, tau: np.ndarray):
        self.ids, self.q, self.need, self.tau = ids, q, need, tau
        self.items, self.n = [], 0                  # ids met
        self.found: list[tuple] = []                # (row, item, score)
        self.held, self.limit = 0, KEPT

    def meet(self, x: np.ndarray, ids: pa.Array, cells: Cells, cell: int, exclude_same_id: bool) -> None:
        rows = np.flatnonzero(cells.reached(self.q, self.tau, cell))
        step = max(1, SCORES // len(x))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            s = self.q[some] @ x.T
            r, c = np.nonzero(s >= (self.tau[some] - TIE_EPS)[:, None])
            score, r = s[r, c], some[r]
            fine = np.isfinite(score)
            if exclude_same_id and len(r):
                fine &= ~pc.fill_null(pc.equal(self.ids.take(pa.array(r)), ids.take(pa.array(c))), False).to_numpy(zero_copy_only=False)
            self.found.append((r[fine].astype(np.int32), (c[fine] + self.n).astype(np.int32), score[fine]))
            self.held += int(fine.sum())
            if self.held > self.limit:
                self.items.append(ids)
                self.shrink()
                self.items.pop()
        self.items.append(ids)
        self.n += len(x)

    def shrink(self) -> None:
        """Keeps what can be among the `need` best of a query; raises the thresholds."""
        r, c, s = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((-s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.searchsorted(r, np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(first) >= self.need)
        self.tau[full] = np.maximum(self.tau[full], s[first[full] + self.need[full] - 1])
        keep = s >= self.tau[r] - TIE_EPS
        r, c, s = r[keep], c[keep], s[keep]
        starts = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(s) != 0)]) if len(r) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(r)])
        many = np.repeat(size, size) > self.need[r]  # equal scores of a query, more than it needs
        if many.any():
            at = np.flatnonzero(many)
            by_id = pc.rank(pa.chunked_array(self.items).take(pa.array(c[at])), sort_keys="ascending", tiebreaker="dense", null_placement="at_start").to_numpy()
            run = np.repeat(starts, size)[at]
            order = np.lexsort((by_id, run))
            at, run = at[order], run[order]
            place = np.arange(len(at)) - np.searchsorted(run, run)
            keep = np.ones(len(r), bool)
            keep[at[place >= self.need[r[at]]]] = False
            r, c, s = r[keep], c[keep], s[keep]
        self.found, self.held = [(r, c, s)], len(r)
        self.limit = max(KEPT, 2 * self.held)

    def result(self, names: list[str]):
        if self.found:
            self.shrink()
            (r, c, s), items = self.found[0], pa.chunked_array(self.items)
            for at in range(0, len(r), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(r[own])), items.take(pa.array(c[own])).combine_chunks(), pa.array(s[own])], names=names)


def block_top_k(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str,
                q_vec: str, i_vec: str, extra: str | None = None, exclude_same_id: bool = False,
                block_rows: int = 2048, final: bool = True) -> DataFrame:
    """Top-k items per query by dot product (exact).

    Returns (q_id, i_id, score) - when `final`, only the k best per query (rank by
    score rounded to 9 dp desc, then item id); otherwise the candidates of each slice
    (a superset that a caller filters before ranking).
    Vectors of unequal length never meet.
    """
    item_rows, cells, n = _cells(items, i_id, i_vec, block_rows)
    i_type, q_type = dict(items.dtypes)[i_id], dict(queries.dtypes)[q_id]
    asked = stored(_asked(queries, q_id, q_vec, extra), "asked")
    told = asked.agg(F.count("*").alias("n"), F.avg("_need").alias("need"), F.avg(F.size("_vec")).alias("dim")).first()
    i_kind, dim = dict(item_rows.dtypes)["_vec"], max(told["dim"] or 0, 0)
    groups, slices = _grid(told["n"], k + (told["need"] or 0), 8 * dim, n, (4 if i_kind == "array<float>" else 8) * dim, 4 * asked.sparkSession.sparkContext.defaultParallelism)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    part = (F.col("_g") * slices + F.col("_s")).alias("_at")
    q = asked.select("*", own("_qid", groups).alias("_g"), every(slices).alias("_s")).select(
        part, F.lit(0).alias("_kind"), F.size("_vec").alias("_dim"), F.lit(0).alias("_cell"), "_qid", F.col("_vec").alias("_q"), "_need", none(i_type).alias("_iid"), none(i_kind).alias("_x"))
    x = item_rows.select("*", own("_iid", slices).alias("_s"), every(groups).alias("_g")).select(
        part, F.lit(1), "_dim", "_cell", none(q_type), none("array<double>"), none("long"), "_iid", F.col("_vec"))
    both = q.where("_dim > 0").unionAll(x).repartitionById(groups * slices, F.col("_at")).sortWithinPartitions("_at", "_kind", "_dim", "_cell")
    names = [q_id, i_id, "score"]

    def score(batches):
        at, best, queries = None, {}, {}
        for b in batches:
            keys = np.column_stack([b.column(j).to_numpy() for j in range(4)])
            edge = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(keys)]):
                if hi == lo:
                    continue
                (here, kind, d, cell), run, rows = keys[lo].tolist(), b.slice(lo, hi - lo), np.arange(hi - lo)
                if here != at:
                    for found in best.values():
                        yield from found.result(names)
                    at, best, queries = here, {}, {}
                if kind == 0:
                    queries.setdefault(d, []).append((run.column(4), _rows(run.column(5), rows), run.column(6).to_numpy()))
                elif d in queries or d in best:
                    if d not in best:
                        ids, vecs, need = zip(*queries.pop(d))
                        vecs, need = np.concatenate(vecs), np.concatenate(need) + k
                        tau = np.concatenate([cells.thresholds(vecs[i:i + 1024], need[i:i + 1024] + exclude_same_id * cells.copies) for i in range(0, len(vecs), 1024)])
                        best[d] = _Best(pa.concat_arrays(ids), vecs, need, tau)
                    best[d].meet(_rows(run.column(8), rows).astype(np.float64), run.column(7), cells, cell, exclude_same_id)
        for found in best.values():
            yield from found.result(names)

    cands = both.mapInArrow(score, f"`{q_id}` {q_type}, `{i_id}` {i_type}, score double")
    return top_k_per(cands, q_id, i_id, k) if final else cands


def top_k_per(df: DataFrame, key: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows per key by (score rounded to 9 dp desc, item id asc); adds `rank`."""
    w = Window.partitionBy(key).orderBy(F.round(F.col(score), 9).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
