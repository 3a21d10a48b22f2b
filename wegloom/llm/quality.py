"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and web text without labels train a small network on counts of the text and its
hashed byte trigrams. The risk is the non-negative unbiased one: prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior *
E_p[loss(-)]); where the second part falls below zero, the step climbs back instead of descending.

The features of all texts are computed once into a table. A first network is fitted on samples; under its scores the
class prior is estimated from the trusted positives against all unlabelled texts; then steps over all unlabelled texts,
summed up by Spark, finish the fit.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SAMPLE = 20_000  # bound on labelled rows used for fitting, and on unlabelled texts in the first fit; drawn by a hash
PASSES = 8  # steps over all unlabelled texts
BINS = 1000
UNIT = 1 << 30

_KINDS = np.full(256, 7, np.uint8)  # by byte: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 line end, 6 beyond ASCII, 7 other
_KINDS[32] = 0
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
for _c in b".,;:'\"-?()":
    _KINDS[_c] = 4
_KINDS[10] = 5
_KINDS[128:] = 6
COUNTS, GRAMS = 21, 64
N_FEATURES = COUNTS + GRAMS


def trigrams(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of GRAMS buckets among a text's byte trigrams."""
    if len(data) < 3:
        return np.zeros(GRAMS)
    d = data.astype(np.uint32)
    h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.sqrt(np.bincount(h >> np.uint32(26), minlength=GRAMS) / len(h))


def features(text: str) -> list[float]:
    """Shares, means and trigram shares of a whole text; all zero but the first for one without words."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    words = text.split()
    if not words:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    kinds = np.bincount(_KINDS[data], minlength=8) / n
    counts = Counter(words)
    m = len(words)
    lines = text.split("\n")
    ends = Counter([w[-1] for w in words])
    plain = sum(v for c, v in ends.items() if c.isalnum()) / m
    marked = sum(v for c, v in ends.items() if c in ".,;:?") / m
    top = max(counts.values())
    once = sum(1 for v in counts.values() if v == 1) / m
    short = sum(v for w, v in counts.items() if len(w) <= 3) / m
    line_n = Counter(lines)
    distinct = len(counts) / m
    return [
        0.0, *kinds.tolist(), plain, marked, 1 - plain - marked, top / m, distinct, distinct * math.log1p(m), once, short,
        math.log1p(m) / 10, min(3.0, n / m / 10), 1 - len(line_n) / len(lines), sum(map(eq, words, words[1:])) / m, *trigrams(data),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every text as 32-bit floats."""

    def run(batches):
        for batch in common.slices(batches):
            x = [np.array(features(t), np.float32).tobytes() for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x binary")


def matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, N_FEATURES).astype(float)


class Network:
    """Standardised features, one hidden layer of tanh units, a logit."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def gradient(self, x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Sums over the rows of the loss log(1 + exp(-sign * logit)), and of its derivatives by all weights in a row."""
        z = self.standard(x)
        h = np.tanh(z @ self.w1 + self.b1)
        f = np.clip(h @ self.w2 + self.b2, -30, 30)
        g = -sign / (1 + np.exp(sign * f))
        back = np.outer(g, self.w2) * (1 - h * h)
        return float(np.logaddexp(0, -sign * f).sum()), np.concatenate([(z.T @ back).ravel(), back.sum(0), h.T @ g, [g.sum()]])

    def moved(self, step: np.ndarray) -> "Network":
        d, k = self.w1.shape
        a, b, c, e = np.split(step, [d * k, d * k + k, d * k + 2 * k])
        return Network(self.mean, self.scale, self.w1 + a.reshape(d, k), self.b1 + b, self.w2 + c, self.b2 + e[0])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 900, rate: float = 0.01, seed: int = 5) -> Network:
    """Minimise the non-negative risk with Adam on batches; the same rows give the same weights."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = both.shape[1]
    theta = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    sig = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ theta[0] + theta[1])
        f = h @ theta[2] + theta[3]
        fp, fu = f[: len(xp)], f[len(xp) :]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # derivatives of the losses log(1 + exp(-f)) and log(1 + exp(f)) by f
        gp, gu = np.zeros(len(xp)), np.zeros(len(xu))
        if negative >= 0:
            gp += prior * -sig(-fp) / len(xp) - prior * sig(fp) / len(xp)
            gu += sig(fu) / len(xu)
        else:
            gp += prior * sig(fp) / len(xp)
            gu -= sig(fu) / len(xu)
        g = np.concatenate([gp, gu])
        back = np.outer(g, theta[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), h.T @ g + 1e-4 * theta[2], g.sum()]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, *theta)


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def histogram(rows: DataFrame, network: Network) -> np.ndarray:
    """How many rows (x) have their score in each of BINS equal bins, over all of them."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            if batch.num_rows:
                s = network.scores(matrix(batch.column("x").to_pylist()))
                total += np.bincount(np.minimum((s * BINS).astype(int), BINS - 1), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], ["i", "n"])

    out = np.zeros(BINS, np.int64)
    for r in rows.select("x").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that unlabelled texts can have: as these hold that share of all positives' scores,
    no set of scores from a threshold on can be rarer among them than that share of its frequency among the positives.
    The bound is loosened by the deviation that chance allows; sets with under half of the positives are too uncertain.
    """
    n, m = positive.sum(), unlabelled.sum()
    p, u = np.cumsum(positive[::-1]) / n, np.cumsum(unlabelled[::-1]) / m
    slack = np.sqrt(np.log(BINS) / 2 / n) + np.sqrt(np.log(BINS) / 2 / m)
    some = p >= 0.5  # the last one is 1
    return float(np.clip(((u[some] + slack) / p[some]).min(), 0.05, 0.95))


def summed_gradient(rows: DataFrame, network: Network) -> tuple[float, np.ndarray]:
    """Mean loss of taking all rows (x) for negative, and its derivatives; summed up by index, a row each."""
    size = network.w1.size + 2 * len(network.b1) + 1

    def run(batches):
        total = np.zeros(size + 2)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x").to_pylist())
                loss, g = network.gradient(x, -1)
                total += np.concatenate([[len(x), loss], g])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], ["i", "g"])

    out = np.zeros(size + 2)
    for r in rows.select("x").mapInArrow(run, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[r["i"]] = r["g"]
    return out[1] / out[0], out[2:] / out[0]


def finished(network: Network, positive: np.ndarray, unlabelled: DataFrame, prior: float, passes: int = PASSES, rate: float = 0.003) -> Network:
    """Adam steps on the non-negative risk over all unlabelled rows."""
    m = v = 0.0
    for step in range(1, passes + 1):
        loss_u, g_u = summed_gradient(unlabelled, network)
        (_, up), (loss_p, down) = (network.gradient(positive, s) for s in (1, -1))
        n = len(positive)
        rest = g_u - prior * down / n
        g = prior * up / n + rest if loss_u >= prior * loss_p / n else -rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        network = network.moved(-rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return network


def train(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fit on features (doc_id, x) and labels outside the held-out fold; None where there is no positive or no text."""
    mine = labels.where((fold() != HELD_OUT) & (F.col("quality") == 1)).select("doc_id").distinct()
    web = table.where((fold() != HELD_OUT) & F.col("doc_id").isNotNull())
    n, total = mine.count(), web.count()
    if not n or not total:
        return None
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(UNIT))
    drawn = draw(1) < int(UNIT * min(1.0, sample / n))
    trusted = web.where(drawn).join(mine.where(drawn), "doc_id", "left_semi")
    some = web.where(draw(2) < int(UNIT * min(1.0, sample / total)))
    rows = lambda df: matrix(bytes(r["x"]) for r in sorted(df.select("doc_id", "x").collect()))
    positive, first = rows(trusted), rows(some)
    if not len(positive) or not len(first):
        return None
    network = fit(positive, first, 0.5, steps=300)
    scored = np.bincount(np.minimum((network.scores(positive) * BINS).astype(int), BINS - 1), minlength=BINS)
    prior = estimated_prior(scored, histogram(web, network))
    return finished(fit(positive, first, prior), positive, web, prior)


def scored(network: Network | None, x: np.ndarray) -> np.ndarray:
    return network.scores(x) if network else np.full(len(x), 0.5)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts count as empty; repeated rows are scored each; a row without doc_id is scored, not learnt from, and has a
    null held_out; an empty table gives no rows; without positives every score is 0.5. Labels whose document is missing
    don't count. Other columns are not read.
    """
    table = common.materialize(featured(docs), "features")
    network = train(table, labels, sample)

    def run(batches):
        for batch in batches:
            s = scored(network, matrix(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = table.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    tables = common.Scratch(docs.sparkSession)
    network = train(tables.keep(featured(docs), "features"), labels, sample)
    tables.drop()

    def run(batches):
        for batch in common.slices(batches):
            x = np.array([features(t) for t in common.texts_of(batch)], np.float32).reshape(-1, N_FEATURES).astype(float)
            yield batch.filter(pa.array(scored(network, x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
