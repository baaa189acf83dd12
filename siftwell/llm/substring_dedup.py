"""Substring deduplication by recompression of the token sequences.

Rounds name neighbouring symbols: a pair of which the left symbol has coin 0 and the right one coin 1 in
this round becomes one symbol, named by a hash of the two names.  Coins and names are functions of
content, so they hold globally without a dictionary being sent about, equal substrings get equal symbols
in their interior, and all rounds of a partition run in one Spark pass.  Symbols of a run are equal, so
they have equal coins and stay apart: a window that shows a part of a run sees the same symbols anywhere.

Whether a gap between two words outlives round r depends on 2**(r - 1) words at either side (a pair cannot
overlap another pair).  So a gap that outlives three rounds, with its four words at either side, is a
high-level symbol boundary that every copy of these eight words has, too.  In every window of 13 words
one boundary is picked: the one with the least name that outlives three rounds and has its eight words in
the window, or else two rounds (symbols of two rounds have four words at most, so there is one).  The pick
depends on the window's words alone.

1. Picks (about one for four words) are grouped by name: names in one document only are no repeats.
2. Documents with shared names list the two hashes (95 bits) of each window with such a pick; the least doc_id
   of each window decides.  3. The words covered by a window that a smaller doc_id also has are removed.
Copies of a whole text are put aside first: besides one row each for its key, a large group of them costs
what one text does, and its names once more for each task that reads some of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import discard, grams, map_arrow, mix, pick, slices, span_hashes, text_buffers, words, written

_SIDE = 4
_NONE = np.uint64(2**64 - 1)
#: Texts whose names a task remembers to have given.
MEMORY = 1_000_000


def surviving_rounds(h: np.ndarray, fresh: np.ndarray, rounds: int = 3) -> np.ndarray:
    """For each word, how many rounds the gap before it outlives.  fresh: words that begin a document."""
    level = np.zeros(len(h), np.int8)
    at, symbol = np.arange(len(h)), h
    for r in range(1, rounds + 1):
        coin = mix(symbol + np.uint64(r * 0x9E3779B9)) >> np.uint64(63)
        pair = (coin[:-1] == 0) & (coin[1:] == 1) & ~fresh[at[1:]]
        left = np.append(pair, False)
        named = symbol.copy()
        named[left] = mix(symbol[:-1][pair] * np.uint64(0xC2B2AE3D27D4EB4F) + symbol[1:][pair] * np.uint64(0x165667B19E3779F9) + np.uint64(r))
        keep = np.append(True, ~pair)
        at, symbol = at[keep], named[keep]
        level[at] = r
    return level


def picks(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows, the name that each picks); first: index of each document's first word, and the end."""
    n = len(h)
    count = np.maximum(np.diff(first) - window + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.repeat(first[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    fresh = np.zeros(n, bool)
    fresh[first[:-1][first[:-1] < n]] = True
    level = surviving_rounds(h, fresh)
    value = np.full(n + 1, _NONE)
    name = grams(h, 2 * _SIDE) >> np.uint64(2)
    inner = np.append(level, 0)[_SIDE : n - _SIDE + 1]
    value[_SIDE : n - _SIDE + 1] = np.where(inner == 3, name, np.where(inner == 2, name | np.uint64(1 << 62), _NONE))
    least = value[starts + _SIDE]
    for j in range(_SIDE + 1, window - _SIDE + 1):
        np.minimum(least, value[starts + j], out=least)
    return starts, least


def _parse(part: pa.RecordBatch):
    data, off = text_buffers(part.column(1))
    starts, ends, first = words(data, off)
    return data, off, starts, ends, first, span_hashes(data, starts, ends)


def _sequence_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two numbers for each document that name its sequence of words."""
    place = mix(np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64))
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place * np.uint64(odd)))]) for odd in (3, 0xD6E8FEB86659FD93)]
    return np.stack([t[first[1:]] - t[first[:-1]] for t in total], 1)


def _keys(batches):
    """id and hash of the text, number of words, and the key of the sequence of words."""
    for part in slices(batches, "text"):
        *_, first, h = _parse(part)
        key = _sequence_keys(h, first)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first)), pa.array(key[:, 0].copy().view(np.int64)), pa.array(key[:, 1].copy().view(np.int64))], ["id", "t", "n", "node", "more"])


def _named(window: int):
    """name, node: the names that the windows of a text pick; a text is known by half its key here.

    A task gives the names of a text for the first of its copies only (as far as it remembers).
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for part in slices(batches, "text"):
            *_, first, h = _parse(part)
            starts, least = picks(h, first, window)
            doc = np.searchsorted(first, starts, "right") - 1
            new = np.ones(len(starts), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            key = _sequence_keys(h, first).view(np.int64)
            node = key[:, 0].copy()
            own = np.zeros(len(node), bool)
            for i in np.flatnonzero(np.diff(first) >= window).tolist():
                if (x := (int(key[i, 0]), int(key[i, 1]))) not in seen:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen.add(x)
                    own[i] = True
            new &= own[doc]
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(node[doc[new]])], ["name", "node"])

    return run


def _whole(part: pa.RecordBatch, window: int):
    """Words as _parse, and two independent hashes (64 and 32 bits) of the window from each word on, side by side."""
    data, off, starts, ends, first, h = _parse(part)
    twice = np.stack([grams(h, window), grams(span_hashes(data, starts, ends, seed=1), window) >> np.uint64(33)], 1)
    return data, off, first, h, np.ascontiguousarray(twice).view("i8,i8").ravel()


def _windows(window: int):
    def run(batches):
        for part in slices(batches, "text"):
            *_, first, h, whole = _whole(part, window)
            starts, least = picks(h, first, window)
            whole = whole[starts]
            doc = np.searchsorted(first, starts, "right") - 1
            names, at = part.column(2).combine_chunks() if isinstance(part.column(2), pa.ChunkedArray) else part.column(2), np.searchsorted(doc, np.arange(part.num_rows + 1))
            values, ids = [], []
            for i in range(part.num_rows):
                own = whole[at[i] : at[i + 1]][np.isin(least[at[i] : at[i + 1]].view(np.int64), names[i].values.to_numpy())]
                own = np.unique(own)
                values.append(own)
                ids.append(np.full(len(own), i))
            values = np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array(values["f0"].copy()), pa.array(values["f1"].astype(np.int32)), part.column(0).take(pa.array(np.concatenate(ids)))], ["w", "u", "id"])

    return run


def _cut(window: int):
    def run(batches):
        for part in slices(batches, "text"):
            data, off, first, h, whole = _whole(part, window)
            copy, gone = part.column(2).to_pylist(), part.column(3)
            total, removed, texts = [], [], []
            for i in range(part.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                n, out = b - a, 0
                tokens = data[off[i] : off[i + 1]].tobytes().split()
                if n >= window and copy[i]:
                    out, tokens = n, []
                elif n >= window and gone[i].is_valid:
                    listed = gone[i].values
                    listed = np.stack([listed.field(0).to_numpy(), listed.field(1).to_numpy().astype(np.int64)], 1).view("i8,i8").ravel()
                    hit = np.isin(whole[a : b - window + 1], listed)
                    edge = np.zeros(n + 1, np.int64)
                    edge[: len(hit)] += hit
                    edge[window : window + len(hit)] -= hit
                    keep = np.cumsum(edge[:n]) == 0
                    out = n - int(keep.sum())
                    tokens = [tokens[j] for j in np.flatnonzero(keep)]
                total.append(n)
                removed.append(out)
                texts.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _held(known: DataFrame, window: int, twins: DataFrame | None = None) -> DataFrame:
    """node, names: for each text, once however many copies it has, the names that another text has, too.

    twins: nodes that stand for several texts; all their names count as shared.
    """
    named = map_arrow(known, _named(window), "name long, node long")  # made twice rather than stored
    ends = [F.min("node").alias("low"), F.max("node").alias("high")]
    if twins is None:
        shared = named.groupBy("name").agg(*ends).filter("low < high").select("name")
    else:
        judged = named.join(twins.withColumn("twin", F.lit(1)), "node", "left")
        shared = judged.groupBy("name").agg(*ends, F.max("twin").alias("twin")).filter("low < high OR twin = 1").select("name")
    return named.join(shared, "name").groupBy("node").agg(F.collect_set("name").alias("names"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Removes each word covered by ``window`` consecutive words that also start in a smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input.  Returns per input row:
    doc_id long, n_words long, n_removed long, kept_text string (kept words joined by one space).

    Null, empty or blank text: no words, empty kept_text.  Texts shorter than a window keep all words.
    Rows that repeat a doc_id are judged each on its own text and do not remove each other's words.  Null doc_id: nothing is removed and
    nothing is removed on its account.  An empty table gives an empty result.  Other columns are ignored.
    """
    if window < 2 * _SIDE + 3:
        raise ValueError(f"a window has {2 * _SIDE + 3} words at least")
    docs = pick(docs, id=f"{id_col}:long", text=f"{text_col}:string").withColumn("t", F.xxhash64("text"))
    known = docs.filter("id IS NOT NULL")
    keyed = written(map_arrow(known, _keys, "id long, t long, n long, node long, more long").filter(f"n >= {window}"))
    least = keyed.groupBy("node", "more").agg(F.min("id").alias("least"), F.min_by("t", "id").alias("own"))
    copies = written(keyed.join(least, ["node", "more"]).filter("id > least").groupBy("id").agg(F.collect_set("t").alias("copies")))

    twins = least.groupBy("node").agg(F.count("*").alias("texts")).filter("texts > 1").select("node")
    held = written(_held(known, window, None if twins.isEmpty() else twins))
    held = held.join(least.select("node", F.col("least").alias("id"), F.col("own").alias("t")), "node").select("id", "t", "names")

    windows = written(map_arrow(docs.join(held, ["id", "t"]).select("id", "text", "names"), _windows(window), "w long, u int, id long"))
    first = windows.groupBy("w", "u").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("w", "u", "first")
    gone = written(windows.join(first, ["w", "u"]).filter("id > first").groupBy("id").agg(F.collect_set(F.struct("w", "u")).alias("gone")))

    discard(windows)

    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    plan = copies.select("id", "copies", none("struct<w:long,u:int>").alias("gone")).union(gone.select("id", none("long"), "gone"))
    plan = plan.groupBy("id").agg(F.first("copies", True).alias("copies"), F.first("gone", True).alias("gone"))  # an id may have both
    copy = F.coalesce(F.array_contains("copies", F.col("t")), F.lit(False)).alias("copy")
    return map_arrow(docs.join(plan, "id", "left").select("id", "text", copy, "gone"), _cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
