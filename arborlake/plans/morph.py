"""Morph training: a split gain and leaf rates that change over the rounds.

After a warm-up the gain is a blend of the normalised gradient gain and an
information term, less a penalty on lopsided splits. Leaves shrink with the
round and the depth. Gradient moments are running means over the rounds; each
round's come from the root histogram, so they cost no job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Added to deviations and hessians. (Fixed values.)
TINY, EPSILON = 1e-10, 1e-6
#: A split is lopsided when its smaller side has a share below this. (Fixed values.)
LOPSIDED, STEEP = 0.1, 10.0


@dataclass(frozen=True)
class Morph:
    rate: float = 0.1
    pressure: float = 0.2
    warmup: int = 5
    info_weight: float = 0.1
    depth_base: float = 0.9
    balance: bool = True
    #: share of the rounds over which the learning rate rises, a cosine after it; None: constant
    rise: float | None = None


def learning_rates(n: int, base: float, rise: float | None) -> np.ndarray:
    """The learning rate of each round; a cosine ends towards 1 % of ``base``."""
    if rise is None or not n:
        return np.full(n, base)
    up = min(n, max(1, int(np.floor(rise * n + 0.5))))
    down = np.arange(n - up) / max(1, n - up)
    low = base / 100
    return np.r_[base * np.arange(1, up + 1) / up, low + (base - low) * (1 + np.cos(np.pi * down)) / 2]


@dataclass
class Schedule:
    """What a fit remembers between its rounds."""

    config: Morph
    rounds: int
    rates: np.ndarray
    #: weight of a new round's moments
    alpha: float = 0.05
    moments: dict[int, tuple[float, float]] = field(default_factory=dict)

    def observe(self, output: int, g: float, n: float, sq: float) -> None:
        """Takes a round's gradient sum, rows and sum of squares into the running mean and deviation."""
        if n <= 0:
            return
        mean = g / n
        now = mean, float(np.sqrt(max(sq / n - mean * mean, 0.0)))
        old = self.moments.get(output, (0.0, 1.0))
        self.moments[output] = tuple((1 - self.alpha) * a + self.alpha * b for a, b in zip(old, now))

    def leaf_rate(self, r: int, depth: int) -> float:
        c = self.config
        return float(self.rates[min(r, len(self.rates) - 1)] * (1 - c.rate * min(r / max(1, self.rounds), 1.0)) * c.depth_base ** (depth / 3))

    def gain(self, r: int, output: int, plain: np.ndarray, total: np.ndarray, left: np.ndarray, right: np.ndarray, l2: float) -> np.ndarray:
        """Gains of splits from their plain ones; sums are rows of [g, h, n, g2]."""
        c = self.config
        if r < c.warmup:
            return plain
        mean, std = self.moments.get(output, (0.0, 1.0))
        share = c.info_weight * np.tanh(3 * r / max(1, self.rounds))
        out = plain
        if abs(share) >= EPSILON:
            scale = max(max(total[1] + l2, EPSILON) * max(std, TINY) ** 2, TINY)
            smooth = 1 + c.pressure * r / max(1, self.rounds)

            def info(x: np.ndarray) -> np.ndarray:
                n = x[..., 2]
                z = np.abs((x[..., 0] / np.maximum(n, 1) - mean) / (std + TINY))
                return np.where(n > 0, z * np.log1p(z) / smooth, 0.0)

            out = (1 - share) * plain / scale + share * (info(left) + info(right) - info(total))
        if c.balance:
            small = np.minimum(left[:, 2], right[:, 2]) / max(total[2], 1)
            out = out - np.where(small < LOPSIDED, (1 - np.exp(-STEEP * small)) / 2, 0.0)
        return out
