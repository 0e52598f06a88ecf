"""Special functions and planning formulas, free of scipy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np


def betaln(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def betainc(a, b, x: float) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, for arrays a and b."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    shape = a.shape
    a, b = a.ravel(), b.ravel()
    if not 0 < x < 1:
        return np.full(shape, float(x >= 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.array([math.exp(s * math.log(z) + t * math.log1p(-z) - betaln(s, t)) / s for s, t, z in zip(p, q, y)])
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.where(swap, 1 - front * h, front * h).reshape(shape)


def log_upper_mass(a, b, x: float) -> np.ndarray:
    """ln of the Beta(a, b) mass above x, from the side that keeps digits."""
    with np.errstate(divide="ignore"):
        return np.log(betainc(np.asarray(b, float), np.asarray(a, float), 1 - x))


def log_mixture_ratio(s, f, p0: float, a: float = 1.0, b: float = 1.0) -> np.ndarray:
    """ln of the mixture ratio after s wins and f losses, the prior Beta(a, b) cut to rates above p0."""
    s, f = np.asarray(s, float), np.asarray(f, float)
    norm = np.array([betaln(a + x, b + y) for x, y in zip(s.ravel(), f.ravel())]).reshape(s.shape)
    own = norm + log_upper_mass(a + s, b + f, p0)
    return own - betaln(a, b) - log_upper_mass(a, b, p0) - s * math.log(p0) - f * math.log1p(-p0)


def bisect(f: Callable[[float], float], lo: float, hi: float, steps: int = 200) -> float:
    below = f(lo) < 0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if (f(mid) < 0) == below:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def wilson_interval(k: int, n: int, z: float = 1.96) -> tuple[float, float]:
    if n <= 0:
        raise ValueError("an interval needs at least one trial")
    p, w = k / n, z * z / n
    half = z * math.sqrt(p * (1 - p) / n + w / (4 * n))
    return (p + w / 2 - half) / (1 + w), (p + w / 2 + half) / (1 + w)


@dataclass(frozen=True)
class SprtDesign:
    p0: float
    p1: float
    alpha: float = 0.05
    beta: float = 0.10

    def __post_init__(self) -> None:
        if self.p0 == self.p1 or not (0 < self.p0 < 1 and 0 < self.p1 < 1 and 0 < self.alpha < 1 and 0 < self.beta < 1):
            raise ValueError("probabilities must lie inside (0, 1), and p0 must differ from p1")

    @property
    def upper(self) -> float:
        return math.log((1 - self.beta) / self.alpha)

    @property
    def lower(self) -> float:
        return math.log(self.beta / (1 - self.alpha))

    @property
    def win(self) -> float:
        return math.log(self.p1 / self.p0)

    @property
    def loss(self) -> float:
        return math.log((1 - self.p1) / (1 - self.p0))

    def accept_h1(self, p: float) -> float:
        """Wald's probability of accepting H1 at true rate p: by the root h of E[exp(h step)] = 1."""
        drift = p * self.win + (1 - p) * self.loss
        if abs(drift) < 1e-12:
            return -self.lower / (self.upper - self.lower)

        def gap(h: float) -> float:
            return p * math.exp(h * self.win) + (1 - p) * math.exp(h * self.loss) - 1

        # the gap is convex and 0 at 0: against the drift it dips below 0 and rises through the root
        far = -math.copysign(1.0, drift)
        while gap(far) <= 0:
            far *= 2
        near = far / 2
        while gap(near) >= 0:
            near /= 2
        h = bisect(gap, near, far)
        return (1 - math.exp(h * self.lower)) / (math.exp(h * self.upper) - math.exp(h * self.lower))

    def expected_n(self, p: float) -> float:
        """Wald's identity; at zero drift by the second moment of a step."""
        a, drift = self.accept_h1(p), p * self.win + (1 - p) * self.loss
        if abs(drift) < 1e-12:
            second = p * self.win**2 + (1 - p) * self.loss**2
            return (a * self.upper**2 + (1 - a) * self.lower**2) / second
        return (a * self.upper + (1 - a) * self.lower) / drift


@dataclass(frozen=True)
class JudgeChannel:
    """What judging does to a true win rate: accuracy, sampling and ties."""

    accuracy: float
    sampling: float = 1.0
    tie_rate: float = 0.0

    def __post_init__(self) -> None:
        if not (0.5 < self.accuracy <= 1 and 0 < self.sampling <= 1 and 0 <= self.tie_rate < 1):
            raise ValueError("accuracy in (0.5, 1], sampling in (0, 1], tie_rate in [0, 1)")

    # observed and true take numbers and columns alike
    def observed(self, w):
        return w * self.accuracy + (1 - w) * (1 - self.accuracy)

    def true(self, observed):
        return (observed - (1 - self.accuracy)) / self.attenuation

    @property
    def attenuation(self) -> float:
        return 2 * self.accuracy - 1

    @property
    def requests_per_verdict(self) -> float:
        return 1 / (self.sampling * (1 - self.tie_rate))


def plan(p0: float, p1: float, channel: JudgeChannel, alpha: float = 0.05, beta: float = 0.10) -> dict[str, float]:
    """What a test of true rates p0 against p1 costs through a judge."""
    design = SprtDesign(channel.observed(p0), channel.observed(p1), alpha, beta)
    rate = channel.requests_per_verdict

    def cost(h: str, p: float) -> dict[str, float]:
        n = design.expected_n(p)
        return {f"expected_verdicts_under_{h}": n, f"expected_requests_under_{h}": n * rate}

    out = {"attenuation": channel.attenuation, "requests_per_verdict": rate, "observed_p0": design.p0, "observed_p1": design.p1}
    return out | cost("h0", design.p0) | cost("h1", design.p1)


def majority_accuracy(accuracy: float, k: int) -> float:
    if k < 1 or k % 2 == 0:
        raise ValueError("a majority needs an odd number of judges")
    return sum(math.comb(k, i) * accuracy**i * (1 - accuracy) ** (k - i) for i in range(k // 2 + 1, k + 1))


def psi(reference: np.ndarray, counts: np.ndarray, size: float = 1.0, floor: float = 1e-4) -> np.ndarray:
    """Population stability of counts against the reference's, along the last axis. Both are of ``size``
    rows; their shares are floored and made to add up to one again."""
    shares = np.clip(np.stack(np.broadcast_arrays(reference, counts)) / size, floor, None)
    before, now = shares / shares.sum(axis=-1, keepdims=True)
    # what moved, in both directions of the divergence at once
    return np.einsum("...i,...i->...", now - before, np.log(now) - np.log(before))
