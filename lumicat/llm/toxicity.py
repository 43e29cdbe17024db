"""Toxicity by a linear-chain conditional random field over tokens.

Training (on a bounded sample of labelled rows): words and word beginnings that occur in toxic documents far more often
than chance label tokens; evidence, bias and transition scores of a two-state CRF are fitted to those token labels by
forward-backward expectations; a logistic layer from the forward-backward marginals of a document to its label is fitted to ``labels.toxic``.
Scoring: tokens without any known feature share one transfer matrix, so forward and backward sums jump over runs of them
by matrix powers; marginals at the other tokens are exact.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, lean, materialise, slices, texts

#: Labelled rows used for training at most, and the bytes of their texts at most.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
#: Transition probabilities before training, and how strongly scores are held to them.
MOVE, HOLD = ((0.97, 0.03), (0.7, 0.3)), 2.0
#: Documents with a feature at least, and how unlikely (natural logarithm) its share of toxic ones must be by chance.
SUPPORT, CHANCE = 4, -12.0
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str, pool: dict[str, str] | None = None) -> list[str]:
    """The words of a text; with a pool equal words are one object."""
    words = _WORD.findall(text.lower())
    return words if pool is None else [pool.setdefault(w, w) for w in words]


class ToxicCRF:
    def __init__(self, features: dict[str, float], bias: float, move: np.ndarray, layer: np.ndarray):
        #: evidence for the toxic state by feature; bias for it; log scores of transitions; document layer
        self.features, self.bias, self.move, self.layer = features, bias, move, layer
        self.dull: set[str] = set()
        self.step = np.exp(move) * np.array([1.0, exp(bias)])
        self.powers = {0: np.eye(2)}

    def evidence(self, word: str) -> float:
        return sum(self.features.get(f, 0.0) for f in word_features(word))

    def run(self, k: int) -> np.ndarray:
        """The scaled transfer matrix of k tokens without evidence."""
        if k not in self.powers:
            half = self.run(k // 2)
            m = half @ half @ (self.step if k % 2 else np.eye(2))
            if len(self.powers) > 5000:
                self.powers = {0: np.eye(2)}
            self.powers[k] = m / m.max()
        return self.powers[k]

    def marginals(self, at: list[int], evidence: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens ``at`` of n tokens, the others having no evidence."""
        fwd, bwd, out = [], [None] * len(at), []
        v, last = np.array([1.0, 0.0]), -1
        for i, e in zip(at, evidence, strict=True):
            v = v @ self.run(i - last - 1) @ (self.step * np.array([1.0, exp(min(e, 50.0))]))
            v /= v.sum()
            fwd.append(v)
            last = i
        b = self.run(n - 1 - at[-1]) @ np.ones(2)
        for j in range(len(at) - 1, -1, -1):
            bwd[j] = b = b / b.max()
            if j:
                b = self.run(at[j] - at[j - 1] - 1) @ (self.step * np.array([1.0, exp(min(evidence[j], 50.0))])) @ b
        for f, b in zip(fwd, bwd, strict=True):
            p = f * b
            out.append(float(p[1] / p.sum()))
        return out

    def tag(self, text: str) -> tuple[list[float], list[tuple[int, int]]]:
        """Marginals of the tokens with evidence, and the offsets of those that are likelier toxic than not."""
        words = words_of(text)
        new = set(words) - self.dull
        hot = {}
        for w in new:
            if e := self.evidence(w):
                hot[w] = e
            else:
                self.dull.add(w)
        if len(self.dull) > 150_000:
            self.dull.clear()
        if not hot:
            return [], []
        at = [i for i, w in enumerate(words) if w in hot]
        p = self.marginals(at, [hot[words[i]] for i in at], len(words))
        flagged = {i for i, x in zip(at, p, strict=True) if x >= 0.5}
        if not flagged:
            return p, []
        low = text.lower()
        spans = [m.span() for i, m in enumerate(_WORD.finditer(low)) if i in flagged]
        if len(low) != len(text):  # a capital became two characters
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            spans = [(origin[a], origin[b - 1] + 1) for a, b in spans]
        return p, spans

    def score(self, p: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(summary(p) @ self.layer, -30, 30))))


class Expectations:
    """Expected transitions into and within the toxic state, and expected toxic tokens, of a chain.

    Matrices carry their derivatives with respect to the two scores and the bias ([M, dM/d score 1, ...], multiplied by the
    product rule), so that runs of tokens without evidence are powers here too: the derivatives of log Z are the sums of
    edge and node marginals over all tokens.
    """

    def __init__(self, move: np.ndarray, bias: float):
        m = np.exp(move) * np.array([1.0, exp(bias)])
        self.step = np.stack((m, m * [[0, 1], [0, 0]], m * [[0, 0], [0, 1]], m * [0, 1]))
        self.powers = {0: np.stack((np.eye(2), *np.zeros((3, 2, 2))))}

    @staticmethod
    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a[0] @ b
        out[1:] += a[1:] @ b[0]
        return out / out[0].max()

    def run(self, k: int) -> np.ndarray:
        if k not in self.powers:
            half = self.run(k // 2)
            whole = self.product(half, half)
            self.powers[k] = self.product(whole, self.step) if k % 2 else whole
        return self.powers[k]

    def of(self, at: list[int], evidence: list[float], n: int) -> np.ndarray:
        chain, last = self.powers[0], -1
        for i, e in zip(at, evidence, strict=True):
            chain = self.product(self.product(chain, self.run(i - last - 1)), self.step * np.array([1.0, exp(min(e, 50.0))]))
            last = i
        z = self.product(chain, self.run(n - 1 - last))[:, 0].sum(1)
        return z[1:] / z[0]


def observed(at: list[int], y: int) -> np.ndarray:
    """The same counts where the tokens ``at`` are toxic if y is, and the others are not."""
    within = sum(b == a + 1 for a, b in zip(at, at[1:], strict=False))
    return np.array([len(at) - within, within, len(at)], float) * y


def summary(p: list[float]) -> np.ndarray:
    """Of a document's marginals: a constant, the largest, the chance of any, and the expected number up to 3."""
    return np.array([1.0, max(p, default=0.0), 1 - float(np.prod([1 - x for x in p])), min(3.0, sum(p)) / 3])


def _tail(n: int, k: int, share: float) -> float:
    """Logarithm of the binomial tail P(X >= k), by its first term and the ratio of the next."""
    if k <= n * share:
        return 0.0
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)
    ratio = (n - k) / (k + 1) * share / (1 - share)
    return min(0.0, first - log(1 - min(ratio, 0.99)))


def without_copies(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Without rows that share one of the four smallest hashes of word triples with an earlier one: copies would count as
    independent evidence."""
    seen: set[int] = set()
    out = []
    for words, y in rows:
        mark = heapq.nsmallest(4, {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))})
        if seen.isdisjoint(mark):
            out.append((words, y))
        seen.update(mark)
    return out


def train(rows: list[tuple[str, int]], rounds: int = 25) -> ToxicCRF:
    """Fits the model to (text, toxic) rows.  Without both labels it finds nothing toxic."""
    pool: dict[str, str] = {}
    rows = without_copies([(words_of(t, pool), int(y)) for t, y in rows])
    toxic = sum(y for _, y in rows)
    move = np.log(np.array(MOVE))
    if not 0 < toxic < len(rows):
        return ToxicCRF({}, -8.0, move, np.array([-3.0 if toxic == 0 else 3.0, 0.0, 0.0, 0.0]))
    share = toxic / len(rows)
    bad: Counter[str] = Counter()
    for words, y in rows:
        if y:
            bad.update({f for w in set(words) for f in word_features(w)})
    bad = Counter({f: k for f, k in bad.items() if k >= 0.9 * SUPPORT})
    total = Counter()  # only of what toxic documents repeat: the others' words would fill the driver
    for words, _ in rows:
        total.update({f for w in set(words) for f in word_features(w) if f in bad})
    seeds = {f for f, k in bad.items() if total[f] >= SUPPORT and k >= 0.9 * total[f] and _tail(total[f], k, share) < CHANCE}
    # token labels: tokens of toxic documents with such a feature; the CRF sees all features of those words
    index = {f: i for i, f in enumerate(sorted(seeds))}
    weights, bias = np.zeros(len(index)), -4.0
    docs = []
    for words, y in rows:
        at = [i for i, w in enumerate(words) if any(f in index for f in word_features(w))]
        if at:
            docs.append((len(words), at, [[index[f] for f in word_features(words[i]) if f in index] for i in at], y))
    power, rest_power, start = np.full(len(index), 1e-2), np.full(3, 1e-2), move.copy()
    for _ in range(rounds):  # gradient: labels less marginals, summed over tokens and over edges
        model, chain = ToxicCRF({}, bias, move, np.zeros(4)), Expectations(move, bias)
        grad, rest = np.zeros(len(index)), np.array([*HOLD * (start - move)[:, 1], 0.0])
        for n, at, fs, y in docs:
            evidence = [float(weights[f].sum()) for f in fs]
            for f, x in zip(fs, model.marginals(at, evidence, n), strict=True):
                grad[f] += y - x
            rest += observed(at, y) - chain.of(at, evidence, n)
        grad -= 0.05 * weights
        power += grad * grad
        rest_power += rest * rest
        weights += 2.0 * grad / np.sqrt(power)
        step = 0.2 * rest / np.sqrt(rest_power)
        move = move + np.array([[0, step[0]], [0, step[1]]])
        bias = bias + step[2]
    features = {f: float(weights[i]) for f, i in index.items() if weights[i]}
    model = ToxicCRF(features, bias, move, np.zeros(4))
    x, y = [], []
    for words, label in rows:
        at = [(i, e) for i, w in enumerate(words) if (e := model.evidence(w))]
        x.append(summary(model.marginals([i for i, _ in at], [e for _, e in at], len(words)) if at else []))
        y.append(label)
    x, y = np.array(x), np.array(y, float)
    layer = np.zeros(4)
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        layer += np.linalg.solve(h, x.T @ (y - p) - 0.05 * layer)
    model.layer = layer
    return model


def fold(doc_id) -> object:
    """The fold of a row: crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicCRF:
    """Trains on at most ``sample`` labelled rows outside fold 0, the first in an order by a hash of the id, as far as
    their texts have ``sample_bytes`` together.  Rows with a null label or id are left out; of rows that share an id the
    first text in order counts, of labels that share one the smallest."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.where(fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # ``sample`` rows of two numbers
    rows = materialise(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")), "labelled")
    taken, room = [], sample_bytes
    for r in rows.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if (room := room - r.n) < 0:
            break
        taken.append(r.id)
    got = rows.where(F.col("id").isin(taken)).select("text", "toxic").collect() if taken else []
    discard(rows)
    return train(sorted((r.text, r.toxic) for r in got))


def toxicity(docs: DataFrame, model: ToxicCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans): spans as start:end of toxic tokens, in code points.

    Null texts count as empty; texts without evidence get the layer's constant.  Rows are scored one by one; an empty
    table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                got = [m.tag(t) for t in part["text"].to_pylist()]
                score = [m.score(p) for p, _ in got]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([",".join(f"{a}:{b}" for a, b in s) for _, s in got])], names=["doc_id", "score", "predicted", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double, predicted int, spans string")


def reject_toxic(docs: DataFrame, model: ToxicCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under one half, with all their columns."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([m.score(m.tag(t or "")[0]) < 0.5 for t in part[place].to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
