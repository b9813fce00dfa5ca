"""Small models, fitted by the thousand inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Predictor = Callable[[np.ndarray], np.ndarray]


def dummy(y: np.ndarray) -> Predictor:
    """The most frequent class, the lesser one on ties: probability 0 or 1 of class 1."""
    p = float((y == 1).sum() > (y != 1).sum())
    return lambda x: np.full(len(x), p)


def _weights(y: np.ndarray, class_weight: str | None) -> np.ndarray:
    """A weight for each row: 1, or, "balanced", the number of rows over twice that of the row's class."""
    if class_weight is None:
        return np.ones(len(y))
    if class_weight != "balanced":
        raise ValueError(f"unknown class_weight {class_weight!r}")
    n = max(int((y == 1).sum()), 1), max(int((y != 1).sum()), 1)
    return np.where(y == 1, len(y) / (2 * n[0]), len(y) / (2 * n[1]))


def logistic_regression(x: np.ndarray, y: np.ndarray, C: float = 1.0, class_weight: str | None = None, max_iter: int = 1000, tol: float = 1e-10, start: np.ndarray | None = None, **_) -> Predictor:
    """Least half squared norm of (weights, intercept), the intercept too, plus C times the weighted logistic loss. Newton's method
    with halved steps, from zero or from the weights of a fit nearby; the loss has one least point, so the start changes the way
    to it alone. The predictor's `weights` are the fit's."""
    design = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y == 1, 1.0, -1.0)
    weight = C * _weights(y, class_weight)
    w = np.zeros(design.shape[1]) if start is None or len(start) != design.shape[1] else start.copy()

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + float(weight @ np.logaddexp(0, -sign * (design @ w)))

    now, last = loss(w), False
    for _ in range(max_iter):
        p = 1 / (1 + np.exp(-np.clip(sign * (design @ w), -500, 500)))
        gradient = w - design.T @ (weight * sign * (1 - p))
        if np.abs(gradient).max() <= tol:
            break
        hessian = np.eye(len(w)) + (design * (weight * p * (1 - p))[:, None]).T @ design
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        if last:  # the loss is as low as it can be told: one whole step more squares what is left of the error
            w = w - step
            break
        while (then := loss(w - scale * step)) > now and scale > 1e-10:
            scale /= 2
        w, before, now = w - scale * step, now, then
        last = before - now <= 1e-15 * max(1, abs(before))

    def predict(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -500, 500)))

    predict.weights = w
    return predict


class Bins:
    """Each column's distinct values in order, one column after the other, and for each row the places of its values among them: found
    once for all models on parts of the same rows. A bin is a single value, so splits between bins are exact."""

    def __init__(self, values: np.ndarray, first: np.ndarray, codes: np.ndarray):
        self.values, self.first, self.codes = values, first, codes

    @classmethod
    def of(cls, x: np.ndarray) -> Bins:
        found = [np.unique(c, return_inverse=True) for c in x.T]
        first = np.cumsum([0, *(len(v) for v, _ in found)])
        codes = np.column_stack([k.ravel() + f for (_, k), f in zip(found, first, strict=False)])
        return cls(np.concatenate([v for v, _ in found]), first, codes)

    def take(self, rows: np.ndarray | slice) -> Bins:
        return Bins(self.values, self.first, self.codes[rows])


class Tree:
    """A binary tree of greedy splits on the weighted squared error of y, which for y of 0 and 1 is half the Gini impurity. A split
    stands halfway between two neighbouring values; of equal gains the first column's, then the least value's, wins. Splits go
    on to `depth` levels (None: until leaves are pure), leave `leaf` rows on either side, and need `split` rows to begin with.
    Each split looks at n_features columns drawn by rng, or at all. A leaf's value is value(its rows), by default the weighted
    mean of y. A node's columns are looked at together: histograms over bins, then sums up to each bin that the node has."""

    def __init__(self, bins: Bins, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int | None, leaf: int, split: int = 2, rng: np.random.Generator | None = None, n_features: int = 0, value: Callable | None = None):
        own, w = y[rows], weight[rows]
        self.value = float(own @ w / w.sum()) if value is None else float(value(rows))
        self.at: tuple | None = None
        if depth == 0 or len(rows) < max(2 * leaf, split) or own.min() == own.max():
            return
        codes = bins.codes[rows]
        if rng is not None:  # a constant column isn't one of those looked at
            varied = rng.permutation(np.flatnonzero(codes.min(0) != codes.max(0)))
            codes = codes[:, np.sort(varied[:n_features])]
        if not codes.shape[1]:
            return
        flat, d = codes.ravel(), codes.shape[1]
        count = np.bincount(flat, minlength=len(bins.values))
        here = np.flatnonzero(count)
        n = np.cumsum(count[here])
        mass = np.cumsum(np.bincount(flat, np.repeat(w, d), len(bins.values))[here])
        total = np.cumsum(np.bincount(flat, np.repeat(own * w, d), len(bins.values))[here])
        # Sums run on over the columns; each column's begin anew, and its last bin has nothing to the right.
        column = np.searchsorted(bins.first, here, side="right") - 1
        start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        ends = np.r_[start[1:], len(here)] - 1
        of = np.repeat(np.arange(len(start)), ends - start + 1)
        n, mass, total = (v - np.r_[0, v[ends[:-1]]][of] for v in (n, mass, total))
        all_mass, all_total = mass[ends][of], total[ends][of]
        gain = total**2 / mass + (all_total - total) ** 2 / np.maximum(all_mass - mass, 1e-300) - all_total**2 / all_mass
        gain[(n < leaf) | (len(rows) - n < leaf)] = 0
        gain[ends] = 0
        if not gain.max() > 1e-12:
            return
        k = int(np.argmax(gain > gain.max() - 1e-12))
        c = int(column[k])
        left = bins.codes[rows, c] <= here[k]
        deeper = None if depth is None else depth - 1
        bound = float((bins.values[here[k]] + bins.values[here[k + 1]]) / 2)
        self.at = (c, bound, *(Tree(bins, y, weight, rows[m], deeper, leaf, split, rng, n_features, value) for m in (left, ~left)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), self.value)
        column, bound, low, high = self.at
        left = x[:, column] <= bound
        out = np.empty(len(x))
        out[left], out[~left] = low(x[left]), high(x[~left])
        return out


def random_forest(
    x: np.ndarray, y: np.ndarray, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2, max_features: str | int | float | None = "sqrt",
    bootstrap: bool = True, class_weight: str | None = None, random_state: int = 0, bins: Bins | None = None, **_,
) -> Predictor:
    """Mean over trees of the share of class 1 in a row's leaf. A tree's rows are drawn with repeats, as weights, and each split looks
    at max_features columns: "sqrt", "log2", a number, a share, or None for all."""
    rng = np.random.default_rng(random_state)
    d = x.shape[1]
    named = {None: d, "sqrt": int(d**0.5), "log2": int(math.log2(d))}
    n_features = max(1, named[max_features] if max_features in named else max_features if isinstance(max_features, int) else int(max_features * d))
    target, weight, bins = (y == 1).astype(float), _weights(y, class_weight), bins or Bins.of(x)
    trees = []
    for _ in range(n_estimators):
        drawn = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)) if bootstrap else np.ones(len(x))
        trees.append(Tree(bins, target, weight * drawn, np.flatnonzero(drawn), max_depth, min_samples_leaf, min_samples_split, rng if n_features < d else None, n_features))
    return lambda x: np.mean([t(x) for t in trees], 0)


def gradient_boosting(x: np.ndarray, y: np.ndarray, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int | None = 3, min_samples_leaf: int = 1, min_samples_split: int = 2, bins: Bins | None = None, **_) -> Predictor:
    """Boosted trees of the logistic loss: each is split on the residuals y - p, and a leaf's value is one Newton step of the loss over
    its rows, the residuals' sum over that of p (1 - p); 0 where that is nothing."""
    target = (y == 1).astype(float)
    rate = np.clip(target.mean(), 1e-12, 1 - 1e-12)
    start = float(np.log(rate / (1 - rate)))
    score, trees, ones, bins = np.full(len(x), start), [], np.ones(len(x)), bins or Bins.of(x)
    for _ in range(n_estimators):
        p = 1 / (1 + np.exp(-score))
        rest, curve = target - p, p * (1 - p)

        def newton(rows: np.ndarray, rest=rest, curve=curve) -> float:
            bend = curve[rows].sum()
            return rest[rows].sum() / bend if bend > 1e-150 else 0.0

        trees.append(Tree(bins, rest, ones, np.arange(len(x)), max_depth, min_samples_leaf, min_samples_split, value=newton))
        score = score + learning_rate * trees[-1](x)
    return lambda x: 1 / (1 + np.exp(-(start + learning_rate * np.sum([t(x) for t in trees], 0))))


#: Fitting functions by model name: (x, y, **parameters) -> probabilities of class 1.
REGISTRY: dict[str, Callable[..., Predictor]] = {
    "LogisticRegression": logistic_regression,
    "RandomForestClassifier": random_forest,
    "GradientBoostingClassifier": gradient_boosting,
}


#: Models that look at bins.
BINNED = ("RandomForestClassifier", "GradientBoostingClassifier")


def fit(model: str, x: np.ndarray, y: np.ndarray, parameters: dict, near: np.ndarray | None = None, bins: Bins | None = None) -> Predictor:
    """A fitted model; with one class in y, the dummy. near: weights of a fit nearby, for models that begin with some; bins: those of x,
    for models that look at bins. An unknown name is a KeyError."""
    train = REGISTRY[model]
    more = {"bins": bins} if model in BINNED else {"start": near}
    return dummy(y) if len(np.unique(y)) < 2 else train(x, y, **parameters, **more)


def roc_auc(y: np.ndarray, p: np.ndarray) -> float | None:
    """Ties count half; None with fewer than two classes."""
    pos, neg = p[y == 1], p[y != 1]
    if not len(pos) or not len(neg):
        return None
    neg = np.sort(neg)
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg)))


def average_precision(y: np.ndarray, p: np.ndarray) -> float | None:
    """One step for each distinct score; None with fewer than two classes."""
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(-p, kind="stable")
    hit, score = (y[order] == 1).astype(float), p[order]
    ends = np.flatnonzero(np.r_[score[1:] != score[:-1], True])
    found = np.cumsum(hit)[ends]
    return float((np.diff(found, prepend=0) / hit.sum() * found / (ends + 1)).sum())


SCORES = {"roc_auc": roc_auc, "pr_auc": average_precision}
