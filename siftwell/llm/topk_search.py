"""Exact k nearest vectors by inner product: a Voronoi kNN join.

Vectors are integers: floor(scale * component).  Pivots, distinct vectors of least hash, cut data and queries
to cells of the nearest pivot.  Each cell is summed up by its pivot and the members nearest to it.  The k + 1
best of those real members bound from below what a query's k-th best score can be; with it, a query cannot
need a vector x of a cell unless q.p + |q| |x - p| reaches that bound.  The least distance |x - p| over the
queries of a group, from which a group needs a cell's vectors, is a small table; a vector is copied to those
groups alone.  Groups are cells near each other; cells are packed into blocks in the same order, so a
group's queries go only to the blocks that hold a vector that the group may need.  There they are scored, and
the best are merged.

Equal vectors share one row that keeps its k + 1 smallest ids (no other can be in a result), so large groups
of copies never meet in a task.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import map_arrow, pick, written

#: Pivots at most; queries of a group and vectors of a block, about.
PIVOTS, GROUP, BLOCK = 4096, 2048, 8192
#: Components up to this size (after scaling); 8,192 products of them fit into 64 bits.
LARGEST = 2**25


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, filled up by zeros to ``width``."""
    off = np.asarray(column.offsets).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), width))
    n = np.diff(off)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in floats where they stay below 2**53, else in 64-bit integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _place(pivots: np.ndarray, width: int):
    """Adds the cell (nearest pivot) and the distance to its pivot."""

    def run(batches):
        norms = (pivots**2).sum(1)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            square = norms - 2 * x @ pivots.T
            cell = square.argmin(1) if len(x) else np.zeros(0, np.int64)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(d)], ["x", "ids", "query", "cell", "d"])

    return run


def _reach(pivots: np.ndarray, summary: np.ndarray, copies: np.ndarray, width: int, k: int, groups: np.ndarray):
    """For each group of queries and cell, the least distance from the pivot that some query needs."""

    def run(batches):
        out = np.full((int(groups.max(initial=0)) + 1, len(pivots)), np.inf)
        for batch in batches:
            q, cell = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            for a in range(0, len(q), 1024):
                part = q[a : a + 1024]
                score = np.repeat(part @ summary.T, copies, axis=1) if len(summary) else np.zeros((len(part), 0))
                bound = -np.partition(-score, k, axis=1)[:, k] if score.shape[1] > k else np.full(len(part), -np.inf)
                norm = np.sqrt((part**2).sum(1))
                top = part @ pivots.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = (bound[:, None] - top) / norm[:, None]
                need[norm == 0] = -np.inf
                need -= 1e-6 * (1 + np.abs(need))
                np.minimum.at(out, groups[cell[a : a + 1024]], need)
        g, c = np.nonzero(out < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(out[g, c])], ["grp", "cell", "need"])

    return run


def _solve(width: int, k: int):
    def run(table):
        """The k + 1 best of one block of vectors for each query of a group."""
        side = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        mine = table.filter(pa.array(side)).combine_chunks()
        data = table.filter(pa.array(~side)).combine_chunks()
        get = lambda t: _matrix(t.column("x").combine_chunks() if isinstance(t.column("x"), pa.ChunkedArray) else t.column("x"), width)
        if not mine.num_rows or not data.num_rows:
            return pa.table({"q": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, x = get(mine), get(data)
        lists = data.column("ids").combine_chunks()
        off, ids = np.asarray(lists.offsets).astype(np.int64), lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(x)), np.diff(off))
        keys = mine.column("key").to_pylist()
        best_q, best_id, best_s = [], [], []
        for a in range(0, len(q), 256):
            for i, s in enumerate(_scores(q[a : a + 256], x)):
                if len(s) > k + 1:
                    rows = np.flatnonzero(s >= -np.partition(-s, k)[k])
                    sel = np.isin(owner, rows) if len(rows) * 8 > len(x) else np.concatenate([np.arange(off[r] - off[0], off[r + 1] - off[0]) for r in rows])
                else:
                    sel = np.arange(len(ids))
                mine_ids, mine_s = ids[sel], s[owner[sel]]
                order = np.lexsort((mine_ids, -mine_s))[: k + 1]
                best_q += [keys[a + i]] * len(order)
                best_id.append(mine_ids[order])
                best_s.append(mine_s[order])
        return pa.table({"q": pa.array(best_q, pa.binary()), "vec_id": pa.array(np.concatenate(best_id), pa.int64()), "score": pa.array(np.concatenate(best_s), pa.int64())})

    return run


def _groups(pivots: np.ndarray, count: int) -> np.ndarray:
    """The group of each cell: that of the nearest of ``count`` pivots far from each other."""
    leaders, far = [0], ((pivots - pivots[0]) ** 2).sum(1)
    nearest = np.zeros(len(pivots), int)
    for g in range(1, count):
        leaders.append(int(far.argmax()))
        d = ((pivots - pivots[leaders[-1]]) ** 2).sum(1)
        nearest[d < far] = g
        far = np.minimum(far, d)
    return nearest


def _blocks(sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each cell, and into how many its block is split: cells of a group together, about BLOCK vectors."""
    block, splits, at, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for c in np.argsort(groups, kind="stable"):
        if held and held + sizes[c] > BLOCK:
            at, held = at + 1, 0
        block[c], held = at, held + sizes[c]
        splits[c] = max(1, -(-int(sizes[c]) // BLOCK))
    return block, splits


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query vector with all other rows, ties to the smaller id.

    Queries: rows whose id is divisible by ``every``; candidates: every row but the query's own.  Returns
    query_id long, rank int (from 1), vec_id long, score long; fewer than k rows where there are fewer others.

    Null vectors, and those with null, NaN or infinite components, take no part; nor do those with a component
    beyond ``LARGEST`` after scaling, whose scores may leave 64 bits, or rows with a null id.
    Vectors of unequal length are filled up by zeros.  Rows that repeat an id count once for equal vectors;
    a query's own id is never its result.  An empty table gives an empty result.  Other columns are ignored.
    """
    df = pick(vectors, id=f"{id_col}:long", v=f"{vector_col}:array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x * scale) < LARGEST))  # NaN is above all numbers
    x = F.transform("v", lambda c: F.floor(c * scale))
    base = df.filter("id IS NOT NULL AND v IS NOT NULL").filter(fine).select("id", x.alias("x")).withColumn("key", F.unhex(F.sha2(F.to_json("x"), 256))).dropDuplicates(["id", "key"])
    base = written(base)
    wanted = base.filter(F.pmod("id", F.lit(every)) == 0)
    w = Window.partitionBy("key").orderBy("id")
    few = base.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1)
    distinct = few.groupBy("key").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("id")).alias("ids"))
    asks = wanted.select("key").distinct().withColumn("query", F.lit(True))
    distinct = written(distinct.join(asks, "key", "left").select("x", "ids", F.coalesce("query", F.lit(False)).alias("query")))
    n, width, queries = distinct.agg(F.count("*"), F.max(F.size("x")), F.count_if("query")).first()
    width = int(width or 0)
    if not n or not width:
        return wanted.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).filter("1 = 0")

    first = distinct.orderBy(F.xxhash64("x")).limit(max(1, min(PIVOTS, round(sqrt(n))))).select("x").toArrow()
    pivots = _matrix(first.column(0).combine_chunks(), width)
    placed = written(map_arrow(distinct, _place(pivots, width), "x array<long>, ids array<long>, query boolean, cell int, d double"))
    near = Window.partitionBy("cell").orderBy("d", F.element_at("ids", 1))
    held = placed.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).select("x", "ids").toArrow()  # (k + 1) rows a pivot
    summary = _matrix(held.column(0).combine_chunks(), width)
    copies = np.diff(np.asarray(held.column(1).combine_chunks().offsets))

    cells = {r[0]: r[1:] for r in placed.groupBy("cell").agg(F.count("*"), F.count_if("query"), F.max("d")).collect()}  # a row a pivot
    sizes, asking, radius = (np.array([cells.get(c, (0, 0, -1.0))[i] for c in range(len(pivots))]) for i in range(3))
    groups = _groups(pivots, max(1, min(len(pivots), ceil(queries / GROUP))))
    parts = np.maximum(1, -(-np.bincount(groups, asking).astype(int) // GROUP))  # of a group with too many queries
    block, splits = _blocks(sizes, groups)
    asked = placed.filter("query").select("x", "cell")
    reach = map_arrow(asked, _reach(pivots, summary, copies, width, k, groups), "grp int, cell int, need double").groupBy("grp", "cell").agg(F.min("need").alias("need"))
    of = lambda table: F.get(F.lit(table.tolist()).cast("array<double>"), F.col("cell"))
    reach = written(reach.filter(F.col("need") <= of(radius)).select("grp", "cell", "need", of(block).cast("int").alias("bin"), of(splits).cast("int").alias("splits")))
    spread = F.pmod(F.xxhash64("x"), F.col("splits")).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.get(F.lit(parts.tolist()).cast("array<int>"), F.col("grp")) - 1)).alias("part")
    data = placed.join(reach, "cell").filter("d >= need").select("grp", every_part, "bin", spread.alias("split"), "x", "ids", F.lit(None).cast("binary").alias("key"), F.lit(False).alias("is_query"))
    bins = reach.groupBy("grp", "bin").agg(F.max("splits").alias("splits"))
    mine = placed.filter("query").select(of(groups).cast("int").alias("grp"), "x").join(bins, "grp")
    part = F.pmod(F.xxhash64("x", F.lit(1)), F.get(F.lit(parts.tolist()).cast("array<int>"), F.col("grp"))).cast("int").alias("part")
    mine = mine.select("grp", part, "bin", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "x", F.lit(None).cast("array<long>").alias("ids"), F.unhex(F.sha2(F.to_json("x"), 256)).alias("key"), F.lit(True).alias("is_query"))
    found = data.union(mine).groupBy("grp", "part", "bin", "split").applyInArrow(_solve(width, k), "q binary, vec_id long, score long")
    merged = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(merged)).filter(F.col("r") <= k + 1).select("q", "vec_id", "score")
    pairs = wanted.select(F.col("id").alias("query_id"), F.col("key").alias("q")).join(best, "q").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
