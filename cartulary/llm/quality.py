"""Operator 7: a quality classifier as a sparse ensemble of rules.

Boosted trees over text statistics give rules: each path from a root to a node is a conjunction of comparisons. A
logistic regression with a lasso penalty keeps few of them, and the model is compiled into one Spark column: the
logistic function of a sum of weighted conditions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Labelled rows that a model is fitted on at most; which ones, a hash of their key decides.
MOST_ROWS = 12_000
TREES, DEPTH, CUTS, RATE, LEAST = 40, 3, 48, 0.3, 10
#: Weight of the lasso penalty, and rounds of its descent.
PENALTY, ROUNDS = 2e-3, 400

STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "line_words", "distinct_words", "distinct_lines", "repeated_pairs", "upper", "digits", "spaces", "stops",
    "commas", "bangs", "bars", "brackets", "signs", "beyond_ascii", "longest_word", "shortest_share", "ended_lines", "entropy",
)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text. Null and empty texts have zeros throughout."""
    data = (text or "").encode(errors="surrogatepass")
    words = data.split()
    if not words:
        return [float(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, w, lines = len(data), len(words), data.split(b"\n")
    upper, lower, digits = int(n[65:91].sum()), int(n[97:123].sum()), int(n[48:58].sum())
    spaces, beyond = int(n[32] + n[9:14].sum()), int(n[128:].sum())
    lengths = np.fromiter(map(len, words), np.int64, w)
    p = n[n > 0] / size
    return [
        float(size), float(w), float(len(lines)), float(lengths.mean()), w / len(lines), len(set(words)) / w, len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:]))) / max(w - 1, 1), upper / max(upper + lower, 1), digits / size, spaces / size, int(n[46]) / w,
        int(n[44]) / w, int(n[33] + n[63]) / w, int(n[124]) / w, int(n[[40, 41, 60, 62, 91, 93, 123, 125]].sum()) / w,
        (size - upper - lower - digits - spaces - beyond) / size, beyond / size, float(lengths.max()), float((lengths <= 2).mean()),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), float(-(p * np.log2(p)).sum()),
    ]


def with_statistics(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, one double a statistic)"""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([statistics(x) for x in block.column(1).to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([block.column(0), *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names=[key, *STATISTICS])

    return map_texts(docs.select(F.col(key).cast("long").alias(key), column), run, f"{key} long, " + ", ".join(f"{s} double" for s in STATISTICS), column)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it is greater, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, i] > t) == greater for i, greater, t in self.terms])

    def column(self) -> Column:
        out = None
        for i, greater, t in self.terms:
            term = F.col(STATISTICS[i]) > t if greater else F.col(STATISTICS[i]) <= t
            out = term if out is None else out & term
        return out


@dataclass
class Model:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score of a row of statistics. Weights are added up pairwise, so the expression stays shallow."""
        sums = [F.lit(self.intercept), *[F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)]]
        while len(sums) > 1:
            sums = [sums[i] + sums[i + 1] if i + 1 < len(sums) else sums[i] for i in range(0, len(sums), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sums[0]))


def _simplified(terms: list[tuple[int, bool, float]]) -> Rule:
    """The tightest comparison for each statistic and side, in order of the statistics."""
    best: dict[tuple[int, bool], float] = {}
    for i, greater, t in terms:
        old = best.get((i, greater), t)
        best[i, greater] = max(old, t) if greater else min(old, t)
    return Rule(tuple((i, g, t) for (i, g), t in sorted(best.items())))


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules of all nodes of TREES boosted trees, each grown on half of the rows and of the statistics."""
    random, rules = np.random.default_rng(seed), {}
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)  # value > cut k: bin > k
    logit = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        gradient, weight = y - p, p * (1 - p) + 1e-9
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        columns = random.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        nodes = [(rows, np.arange(len(y)), [])]
        for depth in range(DEPTH + 1):
            new = []
            for own, all_rows, terms in nodes:
                if terms:
                    rules.setdefault(_simplified(terms), None)
                split = _best_split(binned, gradient, weight, own, columns, cuts) if depth < DEPTH else None
                if split is None:
                    step = gradient[own].sum() / (weight[own].sum() + 1.0) if len(own) else 0.0
                    logit[all_rows] += RATE * np.clip(step, -4, 4)
                    continue
                i, k = split
                for greater in (False, True):
                    new.append((own[(binned[own, i] > k) == greater], all_rows[(binned[all_rows, i] > k) == greater], [*terms, (i, greater, float(cuts[i][k]))]))
            nodes = new
    return list(rules)


def _best_split(binned, gradient, weight, rows, columns, cuts) -> tuple[int, int] | None:
    best, found = 1e-3, None
    g, h = gradient[rows], weight[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for i in columns:
        n = len(cuts[i]) + 1
        if n < 2:
            continue
        b = binned[rows, i]
        gs, hs, ns = (np.cumsum(np.bincount(b, v, minlength=n))[:-1] for v in (g, h, np.ones(len(rows))))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best, found = gain[k], (int(i), k)
    return found


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an absolute penalty, by accelerated proximal descent."""
    z = z.astype(np.float32)
    centre, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    z = (z - centre) / scale
    n, start = len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    w, v, b, t = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), start, 1.0
    probe = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = z.T @ (z @ probe) / n
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    step = 4.0 / max(top * 1.1, 1e-6)
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - step * (z.T @ error.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= error.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = (new + (last - 1) / t * (new - w)).astype(np.float32), new
    weights = (w / scale).astype(np.float64)
    return float(b - (weights * centre).sum()), weights


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows the score is a half; with one label only, it is the smoothed share of that label."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return Model(float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1), y)
    kept = [i for i in np.argsort(-np.abs(weights), kind="stable") if abs(weights[i]) > 1e-3]
    return Model(intercept, [rules[i] for i in kept], [float(weights[i]) for i in kept])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Learns from at most most_rows labelled keys that are not held out. A key with several labels counts with the
    least of them, one with several texts with that of the least hash; null labels and labels without a document teach
    nothing. Keys are taken in the order of their hash, so ties can't change the sample."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.min(label).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64(key), key).limit(most_rows)
    texts = docs.select(F.col(key).cast("long").alias(key), "text").join(F.broadcast(known), key)  # most_rows bounds it
    # One text a key, so that most_rows bounds what comes to the driver too.
    texts = texts.groupBy(key).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = with_statistics(texts, key).join(F.broadcast(known), key).orderBy(key).toPandas()
    return fit(found[list(STATISTICS)].to_numpy(), found["y"].to_numpy())


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of docs. Null and empty texts are scored by their statistics, which are zeros."""
    return with_statistics(docs, key).select(key, model.column().alias("score"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Repeated rows stay, each with the same score; rows with a null key count as held out. Null and empty texts have zeros
    for statistics and a score like any other; texts of any length are used whole. A score of exactly a half predicts
    1. Other columns of docs are not read, so their names can't clash. An empty table gives an empty result, and
    without labels every score is a half."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
