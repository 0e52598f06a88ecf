"""Studies: recorded runs give the published values, simulated ones what theory says."""

import numpy as np
import pytest

from verdikt.functions import mathx
from verdikt.functions.mathx import JudgeChannel
from verdikt.operators import montecarlo as mc
from verdikt.operators import studies


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_full_loop(spark):
    got = by(studies.full_loop(spark), "run")
    assert got["regressed"]["latency"] == 5566 and got["null"]["alarm_at"] is None


def test_stratified(spark):
    got = by(studies.stratified(spark), "run", "stratum")
    alarms = {k: r["latency"] for k, r in got.items() if r["latency"] is not None}
    assert alarms == {("regressed", "coding"): 5819, ("regressed", "all"): 10977}


def test_drift_gate(spark):
    got = by(studies.drift_gate(spark), "run")
    assert got["weak"]["psi_threshold"] == pytest.approx(0.03409233, abs=1e-8)
    assert (got["weak"]["drift_at"], got["weak"]["ungated"], got["weak"]["gated"]) == (15199, 20110, None)
    assert got["control"]["ungated"] is None
    coding = by(studies.topic_rates(spark), "topic")["coding"]
    assert (round(coding["before"], 4), round(coding["after"], 4)) == (0.4566, 0.4491)


def test_judge_rounds(spark):
    got = by(studies.judge_rounds(spark), "round")
    assert (got[0]["n"], got[10]["n"]) == (263, 282)
    assert got[0]["accuracy"] == pytest.approx(0.8479087452, abs=1e-9) and got[10]["accuracy"] == pytest.approx(0.7446808511, abs=1e-9)
    assert [r for r in range(20) if got[r]["alarmed"]] == [10, 11, 12, 13, 14, 15, 16, 17, 19]


@pytest.mark.parametrize("k, accuracy, decisive", [(1, 0.7965319846607014, 0.89965), (3, 0.8928591337309773, 0.89695), (5, 0.9356137931034483, 0.90625)])
def test_ensemble_channels(spark, k, accuracy, decisive):
    got = studies.ensemble_channel(spark, k, 139 + 10 * k).first()
    assert got["accuracy"] == pytest.approx(accuracy, abs=1e-12) and got["decisive_rate"] == pytest.approx(decisive, abs=1e-12)


def test_ensemble_notices_a_failing_member(spark):
    got = studies.judge_ensemble(spark, 2000, 1000, 150, 200).first()
    assert got["before"] < got["threshold"] < got["after"] + 0.1 and got["alarm_n"] > 1000


def test_published_plans():
    assumed = mathx.plan(0.5, 0.55, JudgeChannel(0.85, 0.25, 0.1))
    measured = mathx.plan(0.5, 0.55, JudgeChannel(492 / 709, 0.25))
    assert assumed["expected_requests_under_h1"] == pytest.approx(4307.052355018132, rel=1e-9)
    assert measured["expected_requests_under_h1"] == pytest.approx(12632.581307323966, rel=1e-9)


def test_grids_in_small(spark):
    """Each simulated study on a few trials: rates lie where theory puts them."""
    latency = by(studies.detection_latency(spark, (0.05, 0.3), 64, 3000, 500, 128), "shift")
    assert latency[0.3]["detect_rate"] > 0.9 > latency[0.3]["premature_rate"] and latency[0.3]["latency_p50"] < latency[0.05]["latency_p50"]
    sprt = by(studies.sprt_validation(spark, (0.45, 0.6), 128, 4000), "p")
    assert sprt[0.45]["promoted"] < 0.05 and sprt[0.6]["promoted"] > 0.95 and abs(sprt[0.6]["mean_n"] / sprt[0.6]["theory_n"] - 1) < 0.35
    methods = by(studies.method_comparison(spark, (0.5, 0.6), 64, 64, 3000), "w", "method")
    assert all(methods[0.6, m]["detect_rate"] > 0.9 > 0.15 > methods[0.5, m]["detect_rate"] for m in studies.METHODS)
    diluted = by(studies.dilution(spark, (0, 1000), 64, 3000, 128), "prefix", "method")
    assert diluted[1000, "cusum"]["median"] < diluted[1000, "mixture"]["median"]
    arms = by(studies.multi_arm(spark, 4, 128, 64, 2000), "method")
    assert arms["corrected"]["family_error"] <= arms["plain"]["family_error"] and arms["corrected"]["promotion_median"] >= arms["plain"]["promotion_median"]
    panel = by(studies.ensemble_detection(spark, (1, 3), (0.2,), 2000, 64, 500, 4000, 128), "k")
    assert panel[3]["accuracy"] > panel[1]["accuracy"] and panel[3]["median_requests"] < panel[1]["median_requests"]
    alarms = studies.false_alarms(spark, 128, 2000, 256).first()
    assert alarms["cusum"] < 0.15 < alarms["peeking"]


def test_calibrations_follow_the_recorded_generator(spark):
    h = mc.recorded_thresholds(spark, 9, [(300, 0.1), (200, 0.05)], trials=100)
    rng = np.random.default_rng(9)
    want = [np.quantile(mc.cusum_stats(mc.gen_wins(rng, 100, n, 0.5), 0.5, 0.45).max(axis=1), 1 - r) for n, r in ((300, 0.1), (200, 0.05))]
    assert h == pytest.approx(want, abs=1e-12)
    assert mc.disagreement_max(np.random.default_rng(1), 3, 50, 0.3, 10) == pytest.approx([np.convolve(r, np.ones(10) / 10, "valid").max() for r in (np.random.default_rng(1).random((3, 50)) < 0.3).astype(float)])
