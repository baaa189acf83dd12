"""Text quality by a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text.  Expectation-maximisation over the counts of
vote patterns of the whole corpus (a bounded number) estimates how often each labeller votes
how on good and on bad texts, without any label.  The posterior of a pattern is the training label of its
texts for a linear scorer on hashed features of the text's shape.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.linear import Dense, fit, margins, sigmoid
from siftwell.llm.shared import LOWER, feature_hashes, map_arrow, mix, pick, slices, text_buffers, words

#: Texts that the scorer is fitted on, at most: those of least hash of doc_id.  Hashed features.
SAMPLE, WIDTH = 4000, 2048
ROUNDS = 60

_CLASS = np.full(256, 9, np.uint64)  # other signs
_CLASS[0x80:] = 0
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c, _k in ((" ", 3), ("\t", 3), ("\n", 4), ("\r", 4), (".", 5), (",", 6), (";", 6), (":", 6), ("!", 7), ("?", 7), ("|", 8), ("-", 10), ("'", 10), ('"', 10), ("(", 10), (")", 10)):
    _CLASS[ord(_c)] = _k

#: (measure, good if at most, bad from); a labeller without a good side or bad side does not vote there.
#: Each kind of junk that they know has two labellers, so that they overlap.
LABELLERS = (
    ("sign_share", None, 0.08),
    ("sign_ends", None, 0.25),
    ("upper_share", None, 0.35),
    ("shout_share", None, 0.20),
    ("bar_share", None, 0.12),
    ("bar_bytes", None, 0.03),
    ("repeat_share", None, 0.15),
    ("sameness", None, 0.80),
    ("stop_gap", 30.0, None),
    ("worst", 0.5, None),
)


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each labeller; texts without words: all zero."""
    kind = _CLASS[data]
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[off]).astype(float)
    size = np.maximum(np.diff(off), 1)
    low = LOWER[data]
    starts, ends, first = words(low, off)
    n = np.diff(first).astype(float)
    h = feature_hashes(low, starts, ends)
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    per_word = lambda x: np.bincount(doc, x, len(n)) / np.maximum(n, 1)
    distinct = np.bincount(np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)[0].astype(np.int64), minlength=len(n)) if len(h) else np.zeros(len(n))
    letters = total(kind <= 1)
    last = kind[ends - 1] if len(ends) else np.zeros(0)
    bar = (ends - starts == 1) & (last == 8) if len(ends) else np.zeros(0)
    stops = np.bincount(doc, last == 5, len(n)) if len(ends) else np.zeros(len(n))
    long = n >= 30
    out = np.stack([
        total(kind == 9) / size,
        per_word(last == 9),
        total(kind == 1) / np.maximum(letters, 1),
        per_word(last == 7),
        per_word(bar),
        total(kind == 8) / size,
        per_word(again),
        np.where(long, 1 - distinct / np.maximum(n, 1) ** 0.9, 0.5),
        np.where(long, n / np.maximum(stops, 0.5), 50.0),
    ], 1)
    bad = np.array([x[2] or np.inf for x in LABELLERS[:-1]])
    out = np.column_stack([out, (out / bad).max(1)])
    out[n == 0] = 0
    return out


def votes(m: np.ndarray) -> np.ndarray:
    good = np.array([-1.0 if x[1] is None else x[1] for x in LABELLERS])
    bad = np.array([np.inf if x[2] is None else x[2] for x in LABELLERS])
    some = m.any(1, keepdims=True)
    return np.where(some & (m <= good), 1, np.where(m >= bad, -1, 0)).astype(np.int8)


def patterns(v: np.ndarray) -> np.ndarray:
    """A number for each row of votes, in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def unpack(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


#: Bounds of what one vote may say: how many times likelier it is on texts of its own side.
LEAST_SAYS, MOST_SAYS = 1.5, 200.0


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """P(good) of each pattern by expectation-maximisation over patterns and their counts.

    Each round reckons, from the present posteriors, how often a labeller votes so on good and on bad texts;
    their ratio is what its vote says.  Abstentions say nothing.  It starts from the belief that a text is
    bad as soon as a labeller says so.
    """
    p = np.where((v < 0).any(1), 0.1, 0.9)
    if not count.sum():
        return p
    for _ in range(rounds):
        good, bad = count * p, count * (1 - p)
        odds = np.full(len(p), np.log((good.sum() + 1) / (bad.sum() + 1)))
        for j in range(v.shape[1]):
            for side, own, other in ((1, good, bad), (-1, bad, good)):
                cast = v[:, j] == side
                says = ((own * cast).sum() + 0.5) / (own.sum() + 1) * (other.sum() + 1) / ((other * cast).sum() + 0.5)
                odds += side * cast * np.log(np.clip(says, LEAST_SAYS, MOST_SAYS))
        p = sigmoid(odds)
    return p


def shape(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed features of each text: shares of kinds of four characters, repeated words, measures."""
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.float32)
    kind = _CLASS[data]
    if len(kind) > 3:  # every four neighbouring characters of one text
        code = mix(kind[:-3] * np.uint64(1331) + kind[1:-2] * np.uint64(121) + kind[2:-1] * np.uint64(11) + kind[3:]) % np.uint64(WIDTH - len(LABELLERS))
        doc = np.repeat(np.arange(n), np.diff(off))[: len(code)]
        doc_last = np.repeat(np.arange(n), np.diff(off))[3:]
        same = doc == doc_last
        out[:] = np.bincount(doc[same] * WIDTH + code[same].astype(np.int64), minlength=n * WIDTH).reshape(n, WIDTH)
    out /= np.maximum(np.diff(off), 1)[:, None]
    np.log1p(1000 * out, out=out)
    bad = np.array([x[2] or x[1] for x in LABELLERS])
    out[:, WIDTH - len(LABELLERS) :] = np.minimum(3 * measures(data, off) / bad, 6)
    return out


@dataclass
class Scorer:
    posterior: dict[int, float]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(margins(Dense(x), np.zeros((len(x), 0)), self.weights))


def _votes(batches):
    for part in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(patterns(votes(measures(*text_buffers(part.column(1))))))], ["id", "pattern"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Votes and posteriors over all texts; the scorer's weights on at most ``sample`` of them.

    An empty table gives a scorer that calls all texts good.
    """
    texts = pick(docs, id=f"{id_col}:long", text=f"{text_col}:string")
    found = map_arrow(texts, _votes, "id long, pattern long").groupBy("pattern").count().collect()
    if not found:
        return Scorer({}, np.append(np.zeros(WIDTH), 1.0))
    found.sort(key=lambda r: r[0])
    pattern, count = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    p = estimate(unpack(pattern), count)
    posterior = dict(zip(pattern.tolist(), p.tolist(), strict=True))

    def extract(batches):
        for part in slices(batches, "text", 1 << 20):
            x = text_buffers(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(patterns(votes(measures(*x)))), pa.array([r.tobytes() for r in shape(*x).astype(np.float16)], pa.binary())], ["id", "pattern", "x"])

    ids = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows at most: safe to broadcast
    rows = map_arrow(texts.join(F.broadcast(ids), "id"), extract, "id long, pattern long, x binary").orderBy(F.xxhash64("id"), "id", "pattern", "x").limit(sample).toArrow()
    if not rows.num_rows:
        return Scorer(posterior, np.append(np.zeros(WIDTH), 1.0))
    x = np.stack([np.frombuffer(b, np.float16) for b in rows.column("x").to_pylist()]).astype(np.float32)
    y = np.array([posterior[k] for k in rows.column("pattern").to_pylist()])
    return Scorer(posterior, fit(Dense(x), np.zeros((len(x), 0)), y, penalty=1e-3, rounds=120))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """Scores every whole text.

    Returns per input row: doc_id long, posterior double (P(good) by the votes alone), score double (by the
    linear scorer), kept boolean (score of ``keep`` or more).  Null, empty and blank texts have no votes and
    nothing to score: posterior and score 0, not kept.  Null and repeated ids stay row for row.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    docs = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        scorer = sent.value
        for part in slices(batches, "text", 1 << 20):
            data, off = text_buffers(part.column(1))
            m = patterns(votes(measures(data, off)))
            some = np.diff(words(data, off)[2]) > 0
            p = np.where(some, [scorer.posterior.get(k, 0.5) for k in m.tolist()], 0.0)
            s = np.where(some, scorer.score(shape(data, off)), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(s), pa.array(s >= keep)], ["doc_id", "posterior", "score", "kept"])

    return map_arrow(docs, run, "doc_id long, posterior double, score double, kept boolean")
