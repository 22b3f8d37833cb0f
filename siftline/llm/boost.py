"""Gradient-boosted trees: fitted on the driver from a bounded sample (fit) or on a whole table by Spark
(fit_table), applied as Column expressions.

Trees are of depth two with logistic loss. A fitted model is a list of tests on named features, so that
scoring stays inside the query plan. Features of a sample are numbers, cut at quantiles. Those of a table are
whole numbers from 0 in bins that no data decide (own ones below EXACT, STEPS for each doubling above);
each level of a tree is one aggregation of the rows' gradients by feature and bin, of constant size.
The gradients are added in fixed point, so the sums and the trees don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, RATE, CUTS, RIDGE, LEAST = 24, 0.3, 24, 1.0, 5.0
#: Bins of a table's features: values below EXACT (a power of two), then STEPS for each doubling, BINS in all.
EXACT, STEPS, BINS = 64, 8, 256
#: Bits of a gradient after the point; levels that scores are counted by.
BITS, LEVELS = 20, 4096

#: feature, cut, then the same for the two sides with their two leaves each.
Tree = tuple[int, float, tuple[int, float, float, float], tuple[int, float, float, float]]


class Boosted:
    def __init__(self, bias: float = 0.0, trees: list[Tree] | None = None):
        self.bias, self.trees = bias, trees or []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, c, low, high in self.trees:
            side = [np.where(x[:, g] <= d, a, b) for g, d, a, b in (low, high)]
            out += np.where(x[:, f] <= c, *side)
        return out

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The probability of label 1."""
        leaf = lambda g, d, a, b: F.when(feature(g) <= d, F.lit(a)).otherwise(F.lit(b))
        z = F.lit(self.bias)
        for f, c, low, high in self.trees:
            z = z + F.when(feature(f) <= c, leaf(*low)).otherwise(leaf(*high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def folded(self, b: str) -> Column:
        """The same of bins in the array b, as a fold over the trees, so that plans don't grow with them."""
        z = F.lit(self.bias)
        if self.trees:
            of = lambda f, k, *leaves: ", ".join([str(f), str(int(min(k, BINS))), *(f"double('{v!r}')" for v in leaves)])
            trees = F.expr("array(" + ", ".join(f"struct({of(f, k)}, struct({of(*low)}), struct({of(*high)}))" for f, k, low, high in self.trees) + ")")
            below = lambda t: F.get(b, t["col1"]) <= t["col2"]
            leaf = lambda t: F.when(below(t), t["col3"]).otherwise(t["col4"])
            z = F.aggregate(trees, z, lambda z, t: z + F.when(below(t), leaf(t["col3"])).otherwise(leaf(t["col4"])))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _best(sums: Iterable[tuple[np.ndarray, np.ndarray]], whole_g: float, whole_h: float) -> tuple[float, int, int]:
    """(gain, feature, cut number) of the best split, from each feature's gradients up to each cut;
    feature -1 if none gains."""
    best = (1e-9, -1, 0)
    for f, (a, b) in enumerate(sums):
        if not len(a):
            continue
        gain = a**2 / (b + RIDGE) + (whole_g - a) ** 2 / (whole_h - b + RIDGE) - whole_g**2 / (whole_h + RIDGE)
        gain[(b < LEAST / 4) | (whole_h - b < LEAST / 4)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best


def _split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[float, int, int]:
    upto = lambda f, v: np.cumsum(np.bincount(bins[:, f], v, len(edges[f]) + 1))[:-1]
    return _best(((upto(f, g), upto(f, h)) for f in range(len(edges))), g.sum(), h.sum())


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    if not len(y) or y.min() == y.max():
        p = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return Boosted(math.log(p / (1 - p)))
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        edges.append((v[:-1] + v[1:]) / 2 if len(v) <= CUTS else np.unique(np.quantile(x[:, f], np.arange(1, CUTS) / CUTS)))
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p = y.mean()
    model = Boosted(math.log(p / (1 - p)))
    z = np.full(len(y), model.bias)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        _, f, k = _split(bins, g, h, edges)
        if f < 0:
            break
        left = bins[:, f] <= k
        sides = []
        for part in (left, ~left):
            _, f2, k2 = _split(bins[part], g[part], h[part], edges)
            inner = bins[part, f2] <= k2 if f2 >= 0 else np.ones(int(part.sum()), bool)
            leaf = [RATE * float(g[part][m].sum() / (h[part][m].sum() + RIDGE)) for m in (inner, ~inner)]
            sides.append((max(f2, 0), float(edges[f2][k2]) if f2 >= 0 else math.inf, *leaf))
        tree = (f, float(edges[f][k]), *sides)
        model.trees.append(tree)
        z += Boosted(0.0, [tree]).margin(x)
    return model


def binned(x: Column) -> Column:
    """The bin of a whole number from 0."""
    # the half keeps powers of two and what precedes them apart, whatever the logarithm's last bit
    e = F.floor(F.log2(x + 0.5))
    far = (e - EXACT.bit_length() + 1) * STEPS + F.floor(x * STEPS / F.pow(F.lit(2.0), e)) - STEPS + EXACT
    return F.when(x < EXACT, x).otherwise(F.least(far, F.lit(BINS - 1))).cast("short")


def _upper(k: float) -> float:
    """A number between the values of bin k and those of the next."""
    if not 0 <= k < BINS - 1:
        return math.inf
    e, m = divmod(int(k) + 1 - EXACT, STEPS)
    return (k + 1 if k + 1 < EXACT else EXACT * 2.0**e * (1 + m / STEPS)) - 0.5


def _gradients(rows: DataFrame, model: Boosted, side: Column, features: int) -> np.ndarray:
    """[side, feature, bin, gradient or hessian], summed over all rows."""
    fixed = lambda v: F.round(v * (1 << BITS)).cast("long")
    each = rows.withColumn("q", model.folded("b")).select(side.cast("int").alias("side"), fixed(F.col("pos") - F.col("n") * F.col("q")).alias("g"), fixed(F.col("n") * F.col("q") * (1 - F.col("q"))).alias("h"), F.posexplode("b").alias("f", "bin"))
    out = np.zeros((2, features, BINS, 2))
    for r in each.groupBy("side", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[r.side, r.f, r.bin] = r.g, r.h
    return out / (1 << BITS)


def fit_table(rows: DataFrame, features: int, trees: int = TREES) -> tuple[Boosted, Boosted]:
    """rows (b, n, pos) to the model of bins, and the same of values: b are the bins of a vector, which n
    rows have, pos of them with label 1. Every row takes part in every tree."""
    n, pos = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pos"), F.lit(0))).first()
    if not 0 < pos < n:
        p = (pos + 0.5) / (n + 1.0)
        return Boosted(math.log(p / (1 - p))), Boosted(math.log(p / (1 - p)))
    model = Boosted(math.log(pos / (n - pos)))

    def best(sums: np.ndarray) -> tuple[float, int, int]:
        whole = sums[0].sum(0)
        return _best(((a[:-1, 0], a[:-1, 1]) for a in sums.cumsum(1)), *whole)

    for _ in range(trees):
        _, f, k = best(_gradients(rows, model, F.lit(0), features)[0])
        if f < 0:
            break
        sides = []
        for sums in _gradients(rows, model, F.get("b", F.lit(f)) > k, features):
            _, f2, k2 = best(sums)
            at = (max(f2, 0), k2 if f2 >= 0 else BINS)
            parts = [sums[at[0], : at[1] + 1].sum(0), sums[at[0], at[1] + 1 :].sum(0)]
            sides.append((at[0], math.inf if f2 < 0 else float(k2), *(RATE * float(g / (h + RIDGE)) for g, h in parts)))
        model.trees.append((f, float(k), *sides))
    of = lambda side: (side[0], _upper(side[1]), *side[2:])
    return model, Boosted(model.bias, [(f, _upper(k), of(low), of(high)) for f, k, low, high in model.trees])


def threshold(score: np.ndarray, y: np.ndarray, precision: float, least: int = 5, n: np.ndarray | None = None) -> float:
    """The lowest score from which on the share of label 1 reaches the precision; above 1 if none. With n,
    a score stands for n rows, y of them with label 1."""
    order = np.argsort(-score, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1) if n is None else np.cumsum(n[order])
    last = np.r_[score[order][1:] != score[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero(last & (hits / n >= precision) & (hits >= least))
    return float(score[order][good[-1]]) if len(good) else 2.0
