"""Toxicity by a chain of linear classifiers.

Categories in order: ``insult`` (labelled texts with a term that names a person), ``contempt`` (with a term
that belittles), ``veiled`` (without any such term), ``toxic`` (the label itself).  The model of each sees
the text's features and the log-odds of all categories before it; in training those are out-of-fold
predictions, so a later model learns from what earlier ones say of texts they have not seen.

Features: words (runs of letters, A-Z lower-cased) and their beginnings, by their share of the words.  Those
that tell the labels apart are chosen from aggregates over the labelled sample; a text is scored in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.linear import Sparse, best_threshold, fit, logit, margins, sigmoid
from siftwell.llm.shared import LOWER, discard, feature_hashes, map_arrow, pick, slices, text_buffers, words, written

#: Labelled rows that the models are fitted on, at most: those of least hash of doc_id.
SAMPLE = 12_000
#: Features, at most, and labelled texts that hold one, at least.
CHOSEN, SEEN = 4000, 4
FOLDS = 4
PREFIXES = (6, 8)

# Terms that tell the categories apart in labelled texts.
INSULT = ("idiot", "moron", "loser", "clown", "stupid", "fool", "dumb", "jerk")
CONTEMPT = ("trash", "worthless", "pathetic", "disgusting", "scum", "garbage", "filth", "vermin")
CATEGORIES = ("insult", "contempt", "veiled", "toxic")

_GAP = np.ones(256, bool)
_GAP[ord("a") : ord("z") + 1] = _GAP[ord("A") : ord("Z") + 1] = False
_GAP[0x80:] = False


def _hash_words(terms) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return feature_hashes(data, ends - [len(r) for r in raw], ends)


def _features(data: np.ndarray, off: np.ndarray):
    """(text, feature hash, share of words in 1/100) of each feature of each text, sorted; words of each text; word hashes."""
    data = LOWER[data]
    starts, ends, first = words(data, off, _GAP)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    whole = feature_hashes(data, starts, ends)
    parts, docs = [whole], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        parts.append(feature_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(parts), np.diff(first), whole, first


def _counted(doc: np.ndarray, feature: np.ndarray, size: np.ndarray, n: int):
    """Distinct (text, feature index) and value; n: number of features."""
    key, count = np.unique(doc * n + feature, return_counts=True)
    doc, feature = key // n, key % n
    return doc, feature, np.log1p(100 * count / size[doc])


@dataclass
class Chain:
    hashes: np.ndarray  # sorted
    scale: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[self.hashes >> np.uint64(44)] = True

    def matrix(self, data: np.ndarray, off: np.ndarray) -> Sparse:
        doc, h, size, *_ = _features(data, off)
        hit = self.near[h >> np.uint64(44)]
        doc, h = doc[hit], h[hit]
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        same = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        doc, at, value = _counted(doc[same], at[same], size, max(1, len(self.hashes)))
        return Sparse(doc, at, value / self.scale[at] if len(at) else value, (len(off) - 1, len(self.hashes)))

    def predict(self, x: Sparse) -> np.ndarray:
        """Probabilities, a column for each category."""
        out = np.zeros((x.shape[0], len(self.weights)))
        for j, w in enumerate(self.weights):
            out[:, j] = sigmoid(margins(x, logit(out[:, :j]), w))
        return out


def _statistics(batches):
    """Of each feature in a partition: texts and sums of values by label."""
    names, sums = [], []
    for part in slices(batches, "text"):
        doc, h, size, *_ = _features(*text_buffers(part.column(1)))
        y = np.asarray(part.column(2).to_numpy(zero_copy_only=False)) > 0
        name, at = np.unique(h, return_inverse=True)
        doc, at, value = _counted(doc, at, size, max(1, len(name)))
        z = y[doc]
        names.append(name)
        sums.append(np.stack([np.bincount(at, w, len(name)) for w in (np.ones(len(at)), value * z, value * ~z, value * value)], 1) if len(name) else np.zeros((0, 4)))
    if names:
        name, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.concatenate(sums)
        cols = [np.bincount(at, total[:, i], len(name)) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *(pa.array(c) for c in cols)], ["h", "n", "sp", "sn", "ss"])


def _terms(batches):
    """Of each labelled text its label and which lists of terms it has."""
    insult, contempt = _hash_words(INSULT), _hash_words(CONTEMPT)
    for part in slices(batches, "text"):
        *_, whole, first = _features(*text_buffers(part.column(1)))
        out = []
        for terms in (insult, contempt):
            total = np.append(0, np.cumsum(np.isin(whole, terms)))
            out.append(total[first[1:]] > total[first[:-1]])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(out[0]), pa.array(out[1])], ["id", "text", "y", "insult", "contempt"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain:
    """Fits the chain on at most ``sample`` labelled texts.

    Labels: 1 or more is toxic, 0 not; null labels or ids are left out, of several labels of an id the
    largest counts.  Without labelled texts, or with one class, nothing is ever toxic.
    """
    texts = pick(docs, id=f"{id_col}:long", text=f"{text_col}:string")
    y = pick(labels, id=f"{id_col}:long", y=f"{label_col}:int").dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows at most: safe to broadcast
    held = written(map_arrow(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]), _terms, "id long, text string, y int, insult boolean, contempt boolean"), free=False)
    count = {bool(r[0]): r[1] for r in held.groupBy(F.col("y") > 0).count().collect()}
    if len(count) < 2:
        discard(held)
        return Chain(np.zeros(0, np.uint64), np.ones(1), [np.array([0.0] * j + [-9.0]) for j in range(len(CATEGORIES))], 1.01)
    np_, nn = float(count[True]), float(count[False])
    stats = map_arrow(held.select("id", "text", "y"), _statistics, "h long, n double, sp double, sn double, ss double").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "sp", "sn", "ss")))
    gap = F.col("sp") / np_ - F.col("sn") / nn
    apart = F.abs(gap) * (np_ * nn / (np_ + nn)) ** 0.5 / F.sqrt(F.col("ss") / (np_ + nn))
    top = stats.filter(F.col("n") >= SEEN).orderBy(F.desc(apart), "h").limit(CHOSEN).select("h", "n", "ss").collect()
    top.sort(key=lambda r: r.h % 2**64)
    chain = Chain(np.array([r.h for r in top], np.int64).view(np.uint64), np.array([(r.ss / r.n) ** 0.5 for r in top]) if top else np.ones(1), [], 0.5)

    def extract(batches):
        for part in slices(batches, "text"):
            x = chain.matrix(*text_buffers(part.column(1)))
            at = np.searchsorted(x.row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (x.column.astype(np.int64), x.value.astype(float))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 2, 3, 4)), *lists], ["id", "y", "insult", "contempt", "columns", "values"])

    rows = map_arrow(held.select("id", "text", "y", "insult", "contempt"), extract, "id long, y int, insult boolean, contempt boolean, columns array<long>, values array<double>").toArrow().sort_by("id")
    discard(held)
    get = lambda c: rows.column(c).combine_chunks()
    length = np.diff(np.asarray(get("columns").offsets))
    x = Sparse(np.repeat(np.arange(len(length)), length), get("columns").flatten().to_numpy(), get("values").flatten().to_numpy(), (len(length), len(top)))
    toxic = get("y").to_numpy() > 0
    insult, contempt = (toxic & get(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("insult", "contempt"))
    goals = [insult, contempt, toxic & ~insult & ~contempt, toxic]
    fold = np.random.default_rng(11).permutation(len(toxic)) % FOLDS
    held_out = np.zeros((len(toxic), 0))
    for goal in goals:
        goal = goal.astype(float)
        own = np.zeros(len(goal))
        for k in range(FOLDS):
            inside = fold != k
            if inside.any() and not inside.all():
                w = fit(x.take(inside), logit(held_out[inside]), goal[inside])
                own[~inside] = margins(x.take(~inside), logit(held_out[~inside]), w)
        chain.weights.append(fit(x, logit(held_out), goal))
        held_out = np.column_stack([held_out, sigmoid(own)])
    chain.threshold = max(0.05, best_threshold(held_out[:, -1], toxic))
    return chain


def rejected(chain: Chain, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether the chain calls each text toxic; texts without any known feature never are."""
    x = chain.matrix(data, off)
    return (chain.predict(x)[:, -1] >= chain.threshold) & (np.bincount(x.row, minlength=x.shape[0]) > 0)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text by a trained chain.

    Returns per input row: doc_id long, p_<category> double, toxic boolean.  A null, empty or wordless text
    gets the bias alone and is never toxic.  Null and repeated ids stay row for row.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        chain = sent.value
        for part in slices(batches, "text"):
            x = chain.matrix(*text_buffers(part.column(1)))
            p = chain.predict(x)
            some = np.bincount(x.row, minlength=x.shape[0]) > 0
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array((p[:, -1] >= chain.threshold) & some)], ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    return map_arrow(docs, run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")
