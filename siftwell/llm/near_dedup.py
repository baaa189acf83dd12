"""MinHash near-duplicates by bottom-k sketches of one hash function.

1. One pass over the texts gives each document its set of distinct word shingles (64-bit hashes), the
   k smallest of them (the sketch) and a key of the whole set.  Documents with equal sets fall
   together to one class, so groups of exact copies cost one row from here on.
2. Two sets of Jaccard similarity t share at least ``need`` retained values (all but ``MISS`` of the
   time, a binomial tail).  So, in any fixed total order of the values, they share one among the first
   ``len - need + 1``: only those go into inverted lists.  The order puts values first that few sketches
   retain, by a table of counts of fixed size; the order affects cost, never the result.
3. Each list holds its members against a few of them; the estimate from the sketch of the union drops
   unlikely pairs, the exact Jaccard of full sets decides.  Components of those links come next.
4. A link between two components shows in a list that spans them, and in ``need`` values of either sketch that
   other components have, too.  The sets of members of such lists that have so many are listed again, whole, by
   their rarest values, as far as these tell of partners.  Every link lies within a loose group that such lists
   tie together; texts that only have common values in common are in none.  In such a group an index of
   the rarest values names the members to compare across components: sets are compared whole, or for very
   long ones first by larger sketches of the union and then exactly.  So no link between different components is
   lost, and members of one component are never paired with each other.

Nothing but the table of counts (``BUCKETS`` numbers) is sent to all executors.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.shared import LOWER, discard, likely, map_arrow, mix, pick, release, shingle_sets, slices, text_buffers, written

#: Chance that a pair at the threshold fails the tests on sketches.
MISS = 1e-10
BUCKETS = 1 << 18
#: Members of a loose group that are compared in one task; larger groups are cut into such blocks.
BLOCK = 2048
#: Sets up to this size are compared whole across components.
WHOLE = 512
#: Members of a list that all its members are held against first; how far below the threshold the
#: estimate for such a pair may lie, and how many of those pairs, by lists shared, each document tries.  All
#: three only decide what is left for the step across components, which takes every pair that is.
LEADERS, NEAR, TRIED = 4, 0.06, 2


def tail(k: int, t: float) -> int:
    """The largest x with P(Bin(k, t) < x) <= MISS."""
    total, x = 0.0, 0
    while x < k and (total := total + comb(k, x) * t**x * (1 - t) ** (k - x)) <= MISS:
        x += 1
    return x


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two longs that name a set of 64-bit hashes."""
    n = np.uint64(len(s))
    return int((s.sum(dtype=np.uint64) + n).view(np.int64)), int((np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) ^ n).view(np.int64))


def _sets(width: int, keep: int | None, has=None):
    """Rows of id, n, key and more (which name the set), the shingles (the ``keep`` smallest, or all) and further columns.  has: ids to take."""

    def run(batches):
        for part in slices(batches, "text"):
            if has is not None:
                part = part.filter(pa.array(has(part.column(0).to_numpy(zero_copy_only=False))))
                if not part.num_rows:
                    continue
            data, off = text_buffers(part.column(1))
            n, key, values = [], [], []
            for s in shingle_sets(LOWER[data], off, width):
                n.append(len(s))
                key.append(set_key(s))
                values.append((s if keep is None else s[:keep]).view(np.int64))
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()), lists, *part.columns[2:]], ["id", "n", "key", "more", "values", *part.schema.names[2:]])

    return run


def _firsts(table: np.ndarray, k: int, need: int, percent: int):
    """The values of each sketch under which it stands in inverted lists."""

    def run(batches):
        for batch in batches:
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            off = np.asarray(batch.column(2).offsets)
            flat = batch.column(2).values.to_numpy()
            count = table[flat & (len(table) - 1)]
            doc = np.repeat(np.arange(len(nodes)), np.diff(off))
            flat = flat[off[0] : off[-1]]
            order = np.lexsort((flat, count[off[0] : off[-1]], doc))
            length = np.diff(off).astype(np.int64)
            shared = np.minimum(need, -(-percent * sizes // 100))
            first = np.maximum(length - shared + 1, 1)
            rank = np.arange(len(flat)) - np.repeat(off[:-1] - off[0], length)
            keep = rank < np.repeat(first, length)
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep]), pa.array(nodes[doc[keep]])], ["v", "node"])

    return run


SETS = "id long, n long, key long, more long, values array<long>"


def _named(sets: DataFrame) -> DataFrame:
    """key, more, id, node: each class by both halves of its key, its least id, and the one long that stands for it.

    That is the first half, but where classes share it (expected once in 2**64 / classes**2 tables) only the first
    of them has it and the others a hash of both.
    """
    chosen = sets.filter("n > 0 AND id IS NOT NULL").groupBy("key", "more").agg(F.min("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("more"))
    return chosen.withColumn("node", F.when(rank == 1, F.col("key")).otherwise(F.xxhash64("key", "more")))


def _full(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, values of the nodes listed (node, key, more, id), read from their texts again."""
    full = map_arrow(docs.filter("id IS NOT NULL"), _sets(width, None, likely(wanted.select("id"))), SETS)
    return written(full.join(wanted, ["key", "more", "id"]).dropDuplicates(["node"]).select("node", "n", "values"))


def _exact(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have the similarity."""
    A, B = (full.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}")) for x in "ab")
    inter = F.size(F.array_intersect("va", "vb"))
    return written(pairs.join(B, "b").join(A, "a").filter(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b"))


def _spanning(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists (v, node, ...) whose value several components list."""
    placed = lists.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    wide = placed.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("v")
    return placed.join(wide, "v")


def _prefixes(full: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """v, node, n, comp, at, key: of each set the rarest values, as far as they tell of partners.

    A partner of no fewer shingles shares 2 t / (1 + t) of n, any partner t of n; so it has one of the first values
    after the rest of n, up to here ``key`` in the former case.  ``at``: place in that order.  Values of one set only
    come first and stand in no list; they are counted and not sorted.
    """
    values = full.select("node", "n", F.explode("values").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("sets")).filter("sets > 1")
    own = Window.partitionBy("node")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "v")) - 1
    placed = values.join(shared, "v").withColumn("at", at).filter(f"at <= n - ceil({percent} * n / 100)")
    key = F.expr(f"at <= n - ceil(2 * {percent} * n / (100 + {percent}))")
    return placed.join(roots, "node", "left").select("v", "node", "n", F.coalesce("root", "node").alias("comp"), "at", key.alias("key"))


def _loose(lists: DataFrame) -> DataFrame:
    """node, g: groups of nodes that lists of several components tie together, if any member could be the smaller of a pair there."""
    heads = lists.groupBy("v").agg(F.min("node").alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("key").alias("any")).filter("low <> high AND any").select("v", "head")
    tied = written(components(lists.join(heads, "v").select(F.col("node").alias("a"), F.col("head").alias("b"))))
    return tied.union(tied.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("g"))


def _spread(members: DataFrame) -> DataFrame:
    """Of g, node, comp the groups that span components, cut to pairs of blocks: g, node, comp, side, block.

    Members of one component of g (that of a random member, so as a rule the largest) need not meet each other:
    each goes once to every block of the others, of which there may be few however many it has.
    """
    open_ = members.groupBy("g").agg(F.min_by("comp", F.xxhash64("node")).alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("g", "main")
    rest = members.join(open_, "g").withColumn("inner", F.col("comp") == F.col("main"))
    sizes = rest.groupBy("g").agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("inner") == x) / BLOCK)).cast("int").alias(n) for x, n in ((True, "mains"), (False, "others"))))
    rest = rest.join(sizes, "g").withColumn("side", F.when(F.col("inner"), F.pmod(F.xxhash64("node"), F.col("mains")) + F.col("others")).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    meets = F.when(F.col("inner"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rest = rest.withColumn("other", F.explode(meets))
    return rest.select("g", "node", "comp", "side", F.concat_ws(",", F.least("side", "other"), F.greatest("side", "other")).alias("block"))


def _groups(batches):
    """Rows sorted by (g, block), one table for each."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        g, b = t.column("g").to_numpy(), np.array(t.column("block").to_pylist(), object)
        edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1])) + 1).tolist()]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(x, y - x)
        held = t.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held
    release()


class _Group:
    """Members of a loose group, with an index of the values that come first, and one of all where it is asked for.

    needs: how many values a partner shares with each member at least.  A member's values are ordered by how many
    members have them, rarest first; two that share enough have one in common before the last ``needs`` of either.
    """

    def __init__(self, t: pa.Table, percent: int, whole: int, least: int):
        get = lambda c: t.column(c).to_numpy()
        self.node, self.n, self.side, self.percent = get("node"), get("n"), get("side"), percent
        block = t.column("block")[0].as_py().split(",")
        self.cut = block[0] != block[1]
        lists = t.column("values").combine_chunks()
        off = np.asarray(lists.offsets)
        self.off, self.flat = off - off[0], lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
        _, self.at = np.unique(get("comp"), return_inverse=True)
        self.main = np.bincount(self.at).argmax()
        self.short = self.n <= whole
        needs = np.where(self.short, np.minimum(-(-percent * self.n // 100), least), least)
        length = np.diff(self.off)
        self.owner = np.repeat(np.arange(len(self.node), dtype=np.int32), length)
        _, back, count = np.unique(self.flat, return_inverse=True, return_counts=True)
        order = np.lexsort((self.flat, count.astype(np.int32)[back], self.owner))
        del back, count
        rank = np.arange(len(self.flat)) - np.repeat(self.off[:-1], length)
        first = order[rank < np.repeat(np.maximum(length - needs + 1, 1), length)]
        del order, rank
        self.first, self.first_off = self.flat[first], np.searchsorted(self.owner[first], np.arange(len(self.node) + 1))
        self.every, self.early = None, self._index(self.first, self.owner[first])

    @staticmethod
    def _index(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(values, kind="stable")
        return values[by], owner[by]

    @staticmethod
    def _holders(index: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
        """The owners of the values, once for each value."""
        lo, hi = np.searchsorted(index[0], values, "left"), np.searchsorted(index[0], values, "right")
        span = hi - lo
        return index[1][np.repeat(lo - np.cumsum(span) + span, span) + np.arange(span.sum())]

    def outside(self) -> np.ndarray:
        """Members beside the component that most are in."""
        return np.flatnonzero(self.at != self.main)

    def values(self, i: int) -> np.ndarray:
        return self.flat[self.off[i] : self.off[i + 1]]

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that i is to be held against and may share enough values with, and how many they share."""
        found = np.unique(self._holders(self.early, self.first[self.first_off[i] : self.first_off[i + 1]]))
        may = (self.at[found] != self.at[i]) & ((self.at[found] == self.main) | (found > i)) & (100 * np.minimum(self.n[found], self.n[i]) >= self.percent * np.maximum(self.n[found], self.n[i]))
        if self.cut:
            may &= self.side[found] != self.side[i]
        found = found[may]
        if len(found) > 64:  # one pass over the whole index costs less
            self.every = self.every or self._index(self.flat, self.owner)
            return found, np.bincount(self._holders(self.every, self.values(i)), minlength=len(self.node))[found]
        return found, np.array([np.isin(self.values(j), self.values(i), assume_unique=True).sum() for j in found.tolist()], np.int64)


def _across(whole: int, percent: int, least: int):
    """For loose groups: links between members of different components.

    ``values`` are whole sets up to ``whole`` shingles, else their smallest ``whole``.  Pairs of whole sets
    are decided here (sure), of which only those that join two components go on; others go to the exact test.
    """

    def solve(one: _Group):
        above = list(range(int(one.at.max()) + 1))

        def root(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        n, at, short = one.n, one.at, one.short
        for i in one.outside():
            found, both = one.candidates(i)
            sure = short[found] & short[i]
            for j in found[sure & (100 * both >= percent * (n[found] + n[i] - both))]:
                if (x := root(at[i])) != (y := root(at[j])):
                    above[x] = y
                    yield int(one.node[i]), int(one.node[j]), True
            for j in found[~sure & (both >= least)]:
                if root(at[i]) != root(at[j]):
                    a, b = one.values(i), one.values(j)
                    union = np.union1d(a, b)[:whole]
                    if len(np.intersect1d(np.intersect1d(a, b, True), union, True)) * whole >= least * len(union):
                        yield int(one.node[i]), int(one.node[j]), False

    def run(batches):
        for t in _groups(batches):
            found = list(solve(_Group(t, percent, whole, least)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(p[:2]) for p in found], pa.int64()), pa.array([max(p[:2]) for p in found], pa.int64()), pa.array([p[2] for p in found], pa.bool_())], ["a", "b", "sure"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, k: int = 64) -> DataFrame:
    """Groups documents of which a chain of pairs has a Jaccard similarity of ``percent`` / 100 or more.

    Similarity: of the sets of distinct shingles of ``width`` words, A-Z lower-cased, words being
    ``[^\\x20\\x09-\\x0D]+``.  A text of fewer words has its whole sequence as the one shingle.

    Returns per input row: doc_id long, n_shingles long, component_id long (the smallest doc_id in the
    group), kept boolean (doc_id = component_id).

    Null, empty or blank text: n_shingles 0, its own group, kept.  Rows that repeat a doc_id are judged
    each on its own text; each is kept if its doc_id is its group's smallest.  Null doc_id: such rows take
    no part in linking; component_id is null, kept is true.  An empty table gives an empty result.
    Columns other than the two named are ignored, whatever their names.
    """
    return grouped(docs, id_col, text_col, percent, width, k).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, k: int = 64) -> DataFrame:
    """As near_duplicates, with text_key long (xxhash64 of the text) and group long (of the rows linked; null for no shingles or no id)."""
    if not 0 < percent <= 100:
        raise ValueError("percent lies in 1..100")
    docs = pick(docs, id=f"{id_col}:long", text=f"{text_col}:string")
    t, need = percent / 100, tail(k, percent / 100)
    raw = written(map_arrow(docs.withColumn("text_key", F.xxhash64("text")), _sets(width, k), SETS + ", text_key long"))
    sets = written(raw.select("id", "n", "key", "more", "text_key"))
    nodes = written(raw.drop("text_key").join(_named(sets), ["key", "more", "id"]).dropDuplicates(["node"]).select("node", "key", "more", "id", "n", "values"))
    discard(raw)

    known = nodes.select("node", "key", "more", "id")
    table = np.zeros(BUCKETS, np.int64)
    counts = nodes.select(F.explode("values").alias("v")).select((F.col("v").bitwiseAND(BUCKETS - 1)).alias("at")).groupBy("at").count()
    for at, n in counts.toLocalIterator():
        table[at] = n
    lists = written(map_arrow(nodes.select("node", "n", "values"), _firsts(table, k, need, percent), "v long, node long"))
    lead = [F.min("node").alias("l0"), *(F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(1, LEADERS))]
    heads = lists.groupBy("v").agg(F.count("*").alias("members"), *lead).filter("members > 1")
    stars = lists.join(heads, "v").select("node", F.explode(F.array_distinct(F.array(*(f"l{i}" for i in range(LEADERS))))).alias("l"))
    shares = Window.partitionBy("node").orderBy(F.desc("count"), "l")
    pairs = stars.filter("node <> l").groupBy("node", "l").count().withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= TRIED)
    pairs = written(pairs.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct())
    A, B = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"s{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    near = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= (t - NEAR) * F.size(union)
    probable = pairs.join(A, "a").join(B, "b").filter(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")).filter(near).select("a", "b")
    probable = written(probable)
    some = probable.select(F.col("a").alias("node")).union(probable.select(F.col("b").alias("node"))).distinct()
    full = _full(docs, written(some.join(known, "node")), width)
    first = _exact(probable, full, percent)
    discard(full)
    roots = written(components(first))

    asked = lambda *n: F.least(F.lit(need), F.ceil(F.lit(percent) * (F.greatest(*n) if len(n) > 1 else F.col(n[0])) / 100))
    placed = written(_spanning(lists, roots).select("node").distinct())
    discard(lists)
    few = nodes.join(placed, "node").select("node", asked("n").alias("asked"), F.explode("values").alias("v"))
    wanted = _spanning(few, roots).groupBy("node", "asked").agg(F.count("*").alias("shared")).filter("shared >= asked").select("node")
    full = _full(docs, written(wanted.join(known, "node")), width)
    tied = _loose(written(_prefixes(full, roots, percent)))
    members = written(_spread(tied.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("comp"))))
    cut = full.select("node", "n", F.slice("values", 1, WHOLE).alias("values"))
    rows = members.join(cut, "node").select("g", "block", "node", "n", "comp", "side", "values").repartition("g", "block").sortWithinPartitions("g", "block")
    found = written(map_arrow(rows, _across(WHOLE, percent, tail(WHOLE, t)), "a long, b long, sure boolean").distinct())
    second = found.filter("sure").select("a", "b").union(_exact(found.filter("NOT sure").select("a", "b"), full, percent))
    discard(full)
    roots = components(first.union(second))

    named = known.join(roots, "node", "left").select("key", "more", "id", F.coalesce("root", "node").alias("root"))
    least_id = named.groupBy("root").agg(F.min("id").alias("component"))
    named = named.join(least_id, "root").select("key", "more", "component", "root")
    out = sets.join(named, ["key", "more"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).cast("long")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "text_key", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("root")).alias("group"))
