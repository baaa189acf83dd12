"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

The words of a source, its documents in a seeded order, are dealt to shards of a bounded number of
documents and words.  Highest quotients (target / (2 * blocks + 1)) give each source a whole number of
blocks, and each of its shards its part of them, again by highest quotients of the shards' sizes.  A shard
takes its stream of words as often as its quota holds it and, for the rest, blocks in a seeded order.

The driver sees a row per source; shards of a source meet in one task as a row each; documents only within
their shard.
"""

from __future__ import annotations

import heapq
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import mix, pick, written

#: Words and documents of a shard, about.
SHARD_WORDS, SHARD_DOCS = 1 << 22, 100_000
#: Words of a block at most, and blocks of the smallest target at least.
BLOCK_WORDS, LEAST_BLOCKS = 256, 32


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Splits share * sum(sizes) by weight; nobody above most * size, the excess shared again by weight."""
    out, rest, active = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while active:
        whole = sum(weights[i] for i in active)
        over = {i for i in active if rest * weights[i] / whole > most * sizes[i]}
        if not over:
            for i in active:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in over)
        active -= over
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients vote / (2 * seats + 1), ties to the first; most: nobody gets more."""
    most = most or [seats] * len(votes)
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    seats = min(seats, sum(most))
    give = lambda d: [min(m, floor(v / d + 0.5)) for v, m in zip(votes, most, strict=True)]
    low, high = 0.0, 4 * max(votes) + 1  # divisors; the lower, the more seats
    for _ in range(200):
        d = (low + high) / 2
        if sum(give(d)) > seats:
            low = d
        else:
            high = d
    out = give(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if n < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _quotas(block: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The quota of each shard of one source."""
        rows = rows.sort_values("shard")
        words = [int(x) for x in rows.words]
        rows["quota"] = sainte_lague([float(x) for x in words], int(rows.blocks.iloc[0]), [ceil(int(m) * x / block) for x, m in zip(words, rows.most, strict=True)])
        return rows[["place", "shard", "words", "quota"]]

    return run


def _taken(block: int, seed: int):
    def run(batches):
        """Adds to each document how often it is taken whole, and which spans of the stream are taken once more."""
        for rows in batches:
            taken, passes = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            ranges: list[list[int]] = [[] for _ in range(len(rows))]
            keys = rows.place.to_numpy() * (1 << 32) + rows.shard.to_numpy()
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                one = rows.iloc[at[0]]
                length, most = int(one.words), int(one.most)
                wanted = min(int(one.quota) * block, most * length)
                if not length or not wanted:
                    continue
                whole, rest = divmod(wanted, length)
                n = -(-length // block)
                order = np.argsort(mix(np.arange(n, dtype=np.uint64) + mix(np.array([key * 31 + seed], np.int64).view(np.uint64))), kind="stable")
                size = np.full(n, block, np.int64)
                size[-1] = length - block * (n - 1)
                before = np.cumsum(size[order]) - size[order]
                chosen = np.zeros(n, np.int64)
                chosen[order] = np.clip(rest - before, 0, size[order])
                total = np.concatenate([[0], np.cumsum(chosen)])
                upto = lambda x: total[np.minimum(x // block, n - 1)] + np.minimum(x - np.minimum(x // block, n - 1) * block, chosen[np.minimum(x // block, n - 1)])
                start, words = rows.start.to_numpy()[at], rows["size"].to_numpy()[at]
                taken[at], passes[at] = whole * words + upto(start + words) - upto(start), whole
                for i, a, w in zip(at, start, words, strict=True):
                    for b in range(a // block, -(-(a + w) // block)):
                        x, y = max(a, b * block), min(a + w, b * block + chosen[b])
                        if x < y:
                            own = ranges[i]
                            if own and own[-1] == x - a:
                                own[-1] = int(y - a)
                            else:
                                own += [int(x - a), int(y - a)]
            yield rows[["row", "doc_id", "size", "source_size", "target"]].assign(taken=taken, passes=passes, ranges=ranges)

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """How much of each document a mixture takes.

    Size: words ``[^\\x20\\x09-\\x0D]+`` of the text.  Sources in order of code points, null last, weigh
    ``weights``, repeating; see targets() for ``share`` and ``most``.

    Returns per input row: doc_id long, size long, source_size long and target double (its source's), taken
    long (words taken, repeats counted; ``most`` * size at most), passes long (times that the text is taken
    whole), ranges array<long> (from, to, from, to, ... in words: what is taken once more), text_key long
    (tells texts of a repeated doc_id apart).

    Null, empty or blank text: size 0, taken 0.  A null source is a source.  Null doc_id is taken like any
    other.  Rows that repeat a doc_id are taken each.  A source without words: target 0.  An empty table
    gives an empty result.  Other columns are ignored.  The same rows give the same result in any order,
    but for rows equal in doc_id, source and text, which are interchangeable.
    """
    docs = pick(docs, doc_id=f"{id_col}:long", source=f"{source_col}:string", text=f"{text_col}:string")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("row")))
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r.words for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, most)
    block = int(max(1, min([BLOCK_WORDS, *(x / LEAST_BLOCKS for x in goal if x)])))
    blocks = sainte_lague(goal, round(sum(goal) / block), [ceil(most * x / block) for x in sizes])
    shards = [max(1, ceil(r.words / SHARD_WORDS), ceil(r.docs / SHARD_DOCS)) for r in found]
    spark = docs.sparkSession
    sources = spark.createDataFrame([(i, r.source, int(s), float(g), int(b), int(n)) for i, (r, s, g, b, n) in enumerate(zip(found, sizes, goal, blocks, shards, strict=True))], "place long, name string, source_size long, target double, blocks long, shards long")

    key = F.xxhash64(F.lit(seed), "doc_id", "row")
    placed = sized.join(sources, sized.source.eqNullSafe(sources.name)).withColumn("shard", F.pmod(key, F.col("shards")))
    quota = placed.groupBy("place", "shard", "blocks").agg(F.sum("size").alias("words")).withColumn("most", F.lit(most)).groupBy("place").applyInPandas(_quotas(block), "place long, shard long, words long, quota long")
    w = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "row"), "doc_id", "row")
    streams = placed.withColumn("start", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna({"start": 0})
    streams = streams.join(F.broadcast(quota) if sum(shards) <= 50_000 else quota, ["place", "shard"]).withColumn("most", F.lit(most))
    out = streams.select("row", "doc_id", "size", "source_size", "target", "place", "shard", "start", "words", "quota", "most").mapInPandas(_taken(block, seed), "row long, doc_id long, size long, source_size long, target double, taken long, passes long, ranges array<long>")
    return out.withColumnRenamed("row", "text_key")
