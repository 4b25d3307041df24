"""Searches over the settings of a fit: a tree-structured Parzen estimator, and early stop.

The first trial is the default. A few random trials later each next trial is, of some points drawn near good ones, the one
that is likeliest among good and least likely among bad trials (ratio of two kernel densities). All is seeded. Searches are
asked and told, so those of many partitions go on side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Range:
    """Settings from ``low`` to ``high``; whole numbers and even steps of the logarithm if asked for."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def to(self, value: float) -> float:
        """The place of a value between 0 and 1."""
        f = math.log if self.log else float
        return 0.5 if self.high == self.low else (f(value) - f(self.low)) / (f(self.high) - f(self.low))

    def at(self, place: float) -> float:
        place = min(1.0, max(0.0, place))
        value = self.low * (self.high / self.low) ** place if self.log else self.low + place * (self.high - self.low)
        value = min(self.high, max(self.low, value))
        return round(value) if self.whole else value


@dataclass
class Search:
    """Trials over ``space`` (ranges by name), the first of them ``first``.

    Ends after ``trials`` trials, or when max(5, trials // 5) in a row have not passed a mark by more than ``gain``. The mark
    moves only to trials that pass it so, and slow steady gains therefore add up.
    """

    space: dict[str, Range]
    first: dict
    trials: int
    seed: int = 42
    gain: float = 0.01
    startup: int = 4
    good: float = 0.25
    drawn: int = 24
    seen: list[tuple[float, dict]] = field(default_factory=list)
    mark: float = -math.inf
    waited: int = 0

    @property
    def over(self) -> bool:
        return len(self.seen) >= self.trials or self.waited >= max(5, self.trials // 5)

    @property
    def best(self) -> dict:
        """The settings of the best trial, the earliest among equal ones."""
        return max(self.seen, key=lambda x: x[0])[1] if self.seen else self.first

    def ask(self) -> dict:
        """The next trial."""
        if not self.seen:
            return self.first
        rng = np.random.default_rng([self.seed, len(self.seen)])
        if len(self.seen) < self.startup or not self.space:
            return self.first | {k: r.at(rng.random()) for k, r in self.space.items()}
        order = sorted(self.seen, key=lambda x: -x[0])
        n = max(1, math.ceil(self.good * len(order)))
        places = np.array([[r.to(x[k]) if x[k] is not None else 0.5 for k, r in self.space.items()] for _, x in order])
        good, bad = places[:n], places[n:]
        near = good[rng.integers(0, n, self.drawn)] + rng.normal(size=(self.drawn, good.shape[1])) * self._width(good)
        near = np.clip(np.where((near < 0) | (near > 1), rng.random(near.shape), near), 0, 1)
        ratio = self._log_density(near, good) - self._log_density(near, bad)
        pick = near[int(ratio.argmax())]
        return self.first | {k: r.at(float(p)) for (k, r), p in zip(self.space.items(), pick, strict=True)}

    def tell(self, settings: dict, value: float) -> None:
        value = -math.inf if math.isnan(value) else value
        self.mark, self.waited = (value, 0) if value > self.mark + self.gain else (self.mark, self.waited + 1)
        self.seen.append((value, settings))

    @staticmethod
    def _width(points: np.ndarray) -> np.ndarray:
        return np.maximum(points.std(0) * len(points) ** -0.2, 0.1)

    def _log_density(self, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of kernels around the points and a flat share, feature by feature."""
        w = self._width(points)
        kernels = np.exp(-(((at[:, None, :] - points[None]) / w) ** 2) / 2) / (w * math.sqrt(2 * math.pi))
        return np.log((kernels.sum(1) + 1) / (len(points) + 1)).sum(1)
