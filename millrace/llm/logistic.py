"""Hashed logistic regression, fitted on the driver on a bounded sample and applied everywhere."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import xxhash

_fitted: dict[bytes, Any] = {}


def fitted_once(sample: object, fit: Callable[[], Any], keep: int = 4) -> Any:
    """fit(), or what it gave before for an equal sample; the models of the last ``keep`` samples are kept in the process."""
    key = xxhash.xxh3_128_digest(repr(sample).encode("utf-8", "surrogatepass"))
    if key not in _fitted:
        while len(_fitted) >= keep:
            _fitted.pop(next(iter(_fitted)))
        _fitted[key] = fit()
    return _fitted[key]


def slot(feature: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % size


SLOTS = 1 << 16


def feature_slots(features: list[str]) -> set[int]:
    return {slot(f, SLOTS) for f in features}


class HashedLogistic:
    """Binary features by name, hashed into SLOTS slots; fitted by AdaGrad with a small L2 penalty."""

    def __init__(self) -> None:
        self.w = np.zeros(SLOTS, np.float32)
        self.bias = 0.0

    def fit(self, rows: list[list[int]], labels: list[int], epochs: int = 8, rate: float = 0.3, l2: float = 1e-6, seed: int = 1) -> HashedLogistic:
        """rows: the distinct slots of each example's features."""
        x = [np.array(r, np.int64) for r in rows]
        y = np.asarray(labels, np.float64)
        w, g2, b, bg = np.zeros(SLOTS), np.full(SLOTS, 1e-8), 0.0, 1e-8
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(x)):
                at = x[i]
                g = 1 / (1 + np.exp(-np.clip(w[at].sum() + b, -30, 30))) - y[i]
                step = g + l2 * w[at]
                g2[at] += step * step
                w[at] -= rate * step / np.sqrt(g2[at])
                bg += g * g
                b -= rate * g / np.sqrt(bg)
        self.w, self.bias = w.astype(np.float32), float(b)
        return self

    def score(self, features: list[str]) -> float:
        """The probability of the label 1."""
        z = self.w[list(feature_slots(features))].sum() + self.bias
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(z)))))
