"""Packing documents into training sequences by best-fit decreasing.

A document is tokenised, closed by an id, and cut into full windows; what is left over (shorter than a
window) is packed by size, largest first: a segment tree indexed by remaining capacity finds the tightest
open window that takes it.  Windows that stay far from full are then closed with cuts of the emptiest
ones, and what remains of the last is cut to powers of two, which need no padding.

Each task packs its own rows, so there is no shuffle and no group to hold: tails wait in blocks of
``BLOCK_TAILS`` at most.  Sequence ids carry the task's partition number; as splits of stored files are
fixed, a task that runs again gives the same rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftwell.llm.shared import SPACE, eights, pick, slices, span_hashes, text_buffers

BLOCK_TAILS = 16384
#: Padding of a sequence, in tokens, that is left as it is.
SLACK = 4
#: Distinct pieces of text whose ids a task remembers.
MEMORY = 1_500_000

_SAFE = re.compile(r"[\x09-\x0d\x20-\x7e¡-ɏ]*\Z")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The spans whose bytes are not those of the span that ``model`` names for them."""
    n, m, view = ends - starts, (ends - starts)[model], eights(data)
    head = lambda at, length: view[at] << (8 * (8 - np.minimum(length, 8))).astype(np.uint64)
    other = (n != m) | ((n > 0) & (head(starts, n) != head(starts[model], m)))
    mid = np.flatnonzero((n > 8) & (n == m))
    other[mid] |= view[ends[mid] - 8] != view[ends[model[mid]] - 8]
    for i in np.flatnonzero((n > 16) & ~other & (model != np.arange(len(n)))).tolist():
        other[i] = data[starts[i] : ends[i]].tobytes() != data[starts[model[i]] : ends[model[i]]].tobytes()
    return np.flatnonzero(other)


class Ids:
    """Token ids of texts by a byte-level BPE of ``tokenizers``, remembering those of pieces between white space.

    The tokenizer splits a text by a pattern that never matches across the start of a run of white space
    (unless runs of other kinds of space touch it), so the ids of such pieces are those of the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        import public_tokenizers

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, raw: list[bytes]) -> None:
        """Number new pieces on and keep their ids."""
        known, split, safe = self.pieces, self.split, _SAFE.match
        flat: list[int] = []
        ends: list[int] = []
        for b in raw:
            text = b.decode()
            if safe(text):
                for x in split(text):
                    try:
                        flat += known[x]
                    except KeyError:
                        known[x] = ids = [t.id for t in self.tokenizer.model.tokenize(x.encode().decode("latin-1").translate(self.letters))]
                        flat += ids
            else:
                flat += self.whole(text)
            ends.append(len(flat))
        n, total = len(self.known), len(self.known) + len(raw)
        while total > len(self.start):
            self.start, self.length = np.append(self.start, self.start), np.append(self.length, self.length)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        self.pool[self.used : self.used + len(flat)] = flat
        bounds = np.array([0, *ends], np.int64)
        self.start[n:total], self.length[n:total] = self.used + bounds[:-1], np.diff(bounds)
        self.used += len(flat)
        self.known.update(zip(raw, range(n, total), strict=True))

    def of_texts(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; data and off as from text_buffers."""
        if len(self.known) > MEMORY or len(self.pieces) > MEMORY:
            self.clear()
        gap = SPACE[data]
        head = gap.copy()
        head[1:] &= ~gap[:-1]
        head[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        if len(starts):
            _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            pieces = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            at = np.array([self.known.get(x, -1) for x in pieces])
            new = np.flatnonzero(at < 0)
            self.learn([pieces[i] for i in new.tolist()])
            at[new] = np.arange(len(self.known) - len(new), len(self.known))
            strange = unlike(data, starts, ends, first[back])
            at = at[back]
            n = self.length[at]
            to = np.cumsum(n)
            ids = self.pool[np.repeat(self.start[at] - to + n, n) + np.arange(to[-1])]
            bound = np.append(0, to)[np.searchsorted(starts, off)]
        else:
            ids, bound, strange = np.zeros(0, np.uint32), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
        out = [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        if np.isin(data, np.array([0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3], np.uint8)).any():
            raw = data.tobytes()
            for i in range(len(out)):
                text = raw[off[i] : off[i + 1]].decode()
                if _ODD_SPACE.search(text):
                    out[i] = np.array(self.whole(text), np.uint32)
        for i in set((np.searchsorted(off, starts[strange], "right") - 1).tolist()):
            out[i] = np.array(self.whole(data[off[i] : off[i + 1]].tobytes().decode()), np.uint32)
        return out


class Tightest:
    """Segment tree over capacities 0..size: the least capacity of at least c that some window has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, c: int) -> tuple[int, int] | None:
        """Takes out a window with the least capacity of at least c."""
        count, at = self.count, c + self.leaves
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not count[at]
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.windows[capacity].pop()


def pack_tails(sizes: list[int], window: int, slack: int = SLACK) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Packs pieces of 1..window - 1 tokens.  Returns sequences: (their length, [(piece, from, to), ...])."""
    tree, bins = Tightest(window), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = window, len(bins)
            bins.append([])
        bins[found[1]].append((i, 0, sizes[i]))
        if left := found[0] - sizes[i]:
            tree.add(left, found[1])
    fill = lambda b: sum(y - x for _, x, y in b)
    bins.sort(key=fill, reverse=True)
    done, at, end = [], 0, len(bins)
    spare: list[tuple[int, int, int]] = []
    while at < end:
        room = window - fill(bins[at])
        while room > slack and (spare or at < end - 1):
            if not spare:
                end -= 1
                spare = bins[end]
            i, x, y = spare.pop()
            if y - x > room:
                spare.append((i, x + room, y))
                y = x + room
            bins[at].append((i, x, y))
            room -= y - x
        done.append((fill(bins[at]), bins[at]))
        at += 1
    if spare:
        done.append((fill(spare), spare))
    out = []
    for n, pieces in done:
        while window - n > slack and n & (n - 1):  # cut to powers of two
            part, rest, room = [], [], 1 << (n.bit_length() - 1)
            n -= room
            for i, x, y in pieces:
                cut = min(y - x, room)
                room -= cut
                if cut:
                    part.append((i, x, x + cut))
                if x + cut < y:
                    rest.append((i, x + cut, y))
            out.append((sum(y - x for _, x, y in part), part))
            pieces = rest
        out.append((n, pieces))
    return out


def _pack(path: str, window: int, end_id: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]

    def run(batches):
        ids = Ids(path)
        base, made = TaskContext.get().partitionId() << 40, 0
        tails: list[tuple] = []

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)] + [pa.array([r[6] for r in rows], pa.binary())], names)

        def flush():
            nonlocal made
            rows = []
            for _, pieces in pack_tails([len(t[2]) for t in tails], window):
                at = 0
                for i, x, y in pieces:
                    doc, start, own, total = tails[i]
                    rows.append((doc, start + x, y - x, total, base + made, at, own[x:y].tobytes()))
                    at += y - x
                made += 1
            tails.clear()
            return batch(rows)

        for part in slices(batches, "text", 1 << 20):
            rows = []
            for doc, own in zip(part.column(0).to_pylist(), ids.of_texts(*text_buffers(part.column(1))), strict=True):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                full = len(own) // window * window
                for at in range(0, full, window):
                    rows.append((doc, at, window, len(own), base + made, 0, own[at : at + window].tobytes()))
                    made += 1
                if full < len(own):
                    tails.append((doc, full, own[full:], len(own)))
                if len(tails) >= BLOCK_TAILS:
                    yield flush()
            yield batch(rows)
        if tails:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs all texts into sequences of at most ``window`` tokens.

    Returns per piece: doc_id long, start long (tokens of its document before it), length long, doc_tokens
    long (with the closing id), sequence_id long, offset long (place in the sequence, gapless from 0) and
    tokens binary (unsigned 32-bit little-endian).  A sequence shorter than ``window`` has a power of two
    as its length or at most SLACK tokens of padding.

    Null or empty text: the closing id alone.  Null doc_id stays null; repeated rows are packed each.
    An empty table gives an empty result.  Other columns are ignored.
    """
    if window < 2:
        raise ValueError("a window has two tokens at least")
    docs = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    return docs.mapInArrow(_pack(tokenizer_path, window, end_id), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary")
