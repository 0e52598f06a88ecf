import math

import numpy as np
import pytest

from verdikt.functions import mathx
from verdikt.functions.mathx import JudgeChannel, SprtDesign
from verdikt.operators import montecarlo as mc


def test_published_theory_values():
    d = SprtDesign(0.5, 0.55)
    assert d.accept_h1(0.52) == pytest.approx(0.31576731, abs=1e-8)
    assert d.expected_n(0.52) == pytest.approx(620.42998, abs=1e-5)
    assert d.accept_h1(0.40) == pytest.approx(4.4287e-7, rel=1e-4)
    assert d.expected_n(0.40) == pytest.approx(89.72056, abs=1e-5)
    assert d.accept_h1(0.5) == pytest.approx(0.05, abs=0.005) and d.accept_h1(0.55) == pytest.approx(0.90, abs=0.005)


def test_wilson_and_majority():
    assert mathx.wilson_interval(492, 709) == pytest.approx((0.6590419885, 0.7267379660), abs=1e-10)
    assert [mathx.majority_accuracy(0.85, k) for k in (1, 3, 5)] == pytest.approx([0.85, 0.93925, 0.97338812], abs=1e-7)
    with pytest.raises(ValueError):
        mathx.wilson_interval(0, 0)
    with pytest.raises(ValueError):
        mathx.majority_accuracy(0.8, 2)


def test_betainc_against_binomial_tails():
    for n, k, p in ((10, 3, 0.4), (200, 90, 0.5), (3000, 1400, 0.47)):
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
        assert mathx.betainc(k, n - k + 1, p) == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-9)


def test_channel_and_plan():
    c = JudgeChannel(0.85, 0.25)
    assert c.observed(0.55) == pytest.approx(0.535) and c.attenuation == pytest.approx(0.7) and c.true(c.observed(0.3)) == pytest.approx(0.3)
    p = mathx.plan(0.5, 0.55, c)
    assert p["expected_requests_under_h1"] == pytest.approx(4 * p["expected_verdicts_under_h1"])
    with pytest.raises(ValueError):
        JudgeChannel(0.4)
    with pytest.raises(ValueError):
        SprtDesign(0.5, 0.5)


def test_psi():
    u = np.full(4, 0.25)
    assert mathx.psi(u, u) == 0 and mathx.psi(u, np.array([0.7, 0.1, 0.1, 0.1])) > 0.3


def test_published_cusum_threshold():
    rng = np.random.default_rng(2026)
    mx = np.concatenate([mc.cusum_stats(mc.gen_wins(rng, 200, 20000, 0.5), 0.5, 0.45).max(axis=1) for _ in range(20)])
    assert np.quantile(mx, 0.95) == pytest.approx(7.389748135095208, abs=1e-9)


def test_sprt_of_wins_only():
    d = SprtDesign(0.5, 0.55)
    decision, stop = mc.sprt_decisions(np.ones((1, 60), bool), d)
    assert (decision[0], stop[0]) == (1, 31)
    decision, stop = mc.sprt_decisions(np.tile([True, False], 5)[None], d)
    assert (decision[0], stop[0]) == (0, 10)
