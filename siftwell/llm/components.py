"""Connected components of a graph given as edges, by large-star and small-star rounds.

Every round is a min aggregate and a join, so no component is gathered in one place; rounds are
written to the shared folder, so a lost executor costs one round at most.  Rounds end when nothing changes.
A graph that has been counted to be small (``SMALL`` edges of 16 bytes, so 8 MB) is solved in one task
instead, with the same result, which spares it the rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import discard, written


#: Edges that one task may take.
SMALL = 500_000


def _at_once(batches):
    above: dict = {}

    def root(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = [x for x in above if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges: columns a and b (longs, no nulls).  Returns node, root: root is the smallest
    node that node reaches; nodes without an edge to another node are not listed."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    held, before = edges, _state(edges)
    if before[0] <= small:
        return edges.coalesce(1).mapInArrow(_at_once, "node long, root long")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        last, edges = held, written(edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        discard(last)
        held, after = edges, _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
