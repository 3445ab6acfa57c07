"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of label 1; unlabelled web text is a sample of all rows that may be learned from. Rows
labelled 0 are not used: they are there to measure the result.
With an estimated class prior p, the risk of a scorer g under a loss l is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]):
the second part is the risk on negatives, which can't be below 0, and where its estimate on a batch is, the step goes the
other way and undoes overfitting. The scorer is linear over features of the whole text: how often each run of
three character classes occurs, repeats of words and lines, lengths.

The prior is a mixture proportion, estimated from positives and unlabelled text alone on a third of the sample that the scorer isn't
fitted to: above any cut, unlabelled rows are at least p times as frequent as positives, and at the best cut hardly more.
The scorer is fitted with a first prior of one half, then with the estimate. On the same third, scores are put on the scale of probabilities by the
logistic risk of positives and unlabelled rows, which is convex in slope and shift and makes the mean score of unlabelled text the prior.

Bounds: `positives` and `unlabelled` rows at about, chosen by a hash of the id, are gathered to fit; all rows are scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fold, table, text_udf

#: Character classes: space, line end, small letter, capital, other letter, digit, and signs by their code modulo 4.
CLASSES = 10
N = CLASSES**3 + 6
CUT = 0.3
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _classes:
        kinds = np.empty(0x110000, np.uint16)
        for k in range(0x110000):
            c = chr(k)
            kinds[k] = 1 if c == "\n" else 0 if c.isspace() else 2 if c.islower() else 3 if c.isupper() else 4 if c.isalpha() else 5 if c.isnumeric() else 6 + k % 4
        _classes.append(kinds)
    return _classes[0]


def features(texts: list[str | None]) -> np.ndarray:
    """A row a text: square roots of the shares of class trigrams, then shares of distinct words and of the commonest word, distinct and repeated lines, mean word length, log of the length. Empty texts give zeros."""
    out = np.zeros((len(texts), N), np.float32)
    table = class_table()
    for k, t in enumerate(texts):
        if not t:
            continue
        c = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate([[1], c, [1]]).astype(np.int64)
        tri = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        out[k, : CLASSES**3] = np.sqrt(tri / len(t))
        words, lines = Counter(t.split()), Counter(t.split("\n"))
        n, m = max(1, words.total()), lines.total()
        out[k, CLASSES**3 :] = len(words) / n, max(words.values(), default=0) / n, len(lines) / m, max(lines.values()) / m, min(1.0, len(t) / n / 20), np.log1p(len(t)) / 15
    return out


@dataclass(frozen=True)
class Model:
    """weights (the last is the constant), and slope and shift of the scale of labels."""

    weights: np.ndarray
    slope: float
    shift: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with the sigmoid loss l(g) = sigmoid(-g), and the direction of its gradient. pos, unl: features with a constant."""
    gp, gu = sigmoid(pos @ w), sigmoid(unl @ w)
    slope_p, slope_u = gp * (1 - gp), gu * (1 - gu)
    positive = prior * np.mean(1 - gp)
    negative = np.mean(gu) - prior * np.mean(gp)
    d_negative = unl.T @ slope_u / len(unl) - prior * (pos.T @ slope_p) / len(pos)
    if negative < 0:
        return positive, -d_negative
    return positive + negative, -prior * (pos.T @ slope_p) / len(pos) + d_negative


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights by Adam over whole passes; the same rows always give the same weights."""
    pos, unl = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (pos, unl))
    w = np.zeros(pos.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, g = risk_gradient(w, pos, unl, prior)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def mixture_share(pos: np.ndarray, unl: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives in unlabelled text from scores of both: the least ratio of the shares above a cut, where the cut is chosen with the ratio's uncertainty (at the level `doubt`) added, so that a few rows at the top don't decide."""
    cuts = np.unique(pos)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    p, u = above(pos), above(unl)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (pos, unl))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def calibrated(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and shift of the sigmoid that has the least logistic risk, mean softplus(z) over unlabelled rows less the prior times the mean of z over positives, z = slope * score + shift; by damped Newton steps. Scores are measured in their spread."""
    spread, mid = float(unl.std()) or 1.0, float(unl.mean())
    x = np.c_[(unl - mid) / spread, np.ones(len(unl))]
    at = prior * np.array([((pos - mid) / spread).mean(), 1.0])
    risk = lambda w: np.logaddexp(0, x @ w).mean() - at @ w + ridge * w[0] ** 2
    w = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(100):
        s = sigmoid(x @ w)
        g = x.T @ s / len(x) - at + 2 * ridge * np.array([w[0], 0])
        h = (x * (s * (1 - s))[:, None]).T @ x / len(x) + 2 * ridge * np.eye(2)
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-6 and risk(w - t * step) > risk(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    slope = max(float(w[0]), 1e-3) / spread
    return slope, float(w[1]) - slope * mid


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 3000, unlabelled: int = 4500) -> Model:
    """docs: the rows that may be learned from; labels: ids with label 1 (others are passed by; an id with several labels counts by the largest).

    Without positives every score is the same. Rows of one id are drawn together, and those beyond the bound go by the hashes of their texts, so that reruns agree."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col) == 1).groupBy(F.col(id_col).alias("id")).agg(F.lit(1).alias("label"))
    ids = rows.select("id").distinct().join(known, "id", "left")
    count = ids.agg(F.count("*").alias("n"), F.count("label").alias("ones")).first()
    at = lambda n, of: int(min(1.0, n / max(1, of)) * (1 << 20))
    web = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < at(unlabelled, count.n)
    picked = ids.where(((F.col("label") == 1) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < at(positives, count.ones))) | web)
    held = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0
    picked = picked.select("id", F.col("label").isNotNull().alias("positive"), web.alias("web"), held.alias("held"))
    made = text_udf(lambda: lambda texts: pa.array([x.tobytes() for x in features(texts).astype(np.float16)], pa.binary()), "binary")
    bound = 2 * (positives + unlabelled)
    # ids are drawn by a hash, so their number is near positives + unlabelled and the first limit is there to prove the broadcast's size
    drawn = rows.join(F.broadcast(picked.limit(bound)), "id").select("id", "positive", "web", "held", F.xxhash64("text").alias("mark"), made(F.col("text")).alias("x"))
    got = drawn.orderBy(F.xxhash64("id", F.lit(3)), "mark", "id").limit(bound).collect()
    got.sort(key=lambda r: (r.id is None, r.id, r.x))
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(-1, N)
    positive, web, held = (np.array([r[c] for r in got], bool) for c in ("positive", "web", "held"))
    sides = [x[m & h] for h in (~held, held) for m in (positive, web)]
    if not all(map(len, sides[:2])):
        return Model(np.zeros(N + 1), 1.0, 0.0, 0.5)
    if not all(map(len, sides[2:])):  # too few rows to hold some apart
        sides = sides[:2] * 2
    model = Model(np.zeros(N + 1), 1.0, 0.0, 0.5)
    for _ in range(2):
        model = Model(fit(*sides[:2], model.prior), 1.0, 0.0, model.prior)
        model = Model(model.weights, 1.0, 0.0, mixture_share(*(model.raw(s) for s in sides[2:])))
    return Model(model.weights, *calibrated(*(model.raw(s) for s in sides[2:]), model.prior), model.prior)


def scorer(spark: SparkSession, model: Model):
    """A UDF: text to its score from 0 to 1; null and empty texts have that of no features."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: pa.array(m.score(features(texts)) if texts else np.zeros(0), pa.float64())

    return text_udf(make, "double", rows=128)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learned from rows whose crc32 of the id modulo 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), scorer(spark, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
