"""Published end-to-end values, by sequential draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.operators import folds, metrics, replay, seqtest
from verdikt.operators import montecarlo as mc
from verdikt.operators.judging import NoisyOracle

JUDGE = NoisyOracle(accuracy=0.85, tie_rate=0.1, position_bias=0.15)


def threshold(seed, horizon, drawn=200):
    rng = np.random.default_rng(seed)
    return np.quantile(np.concatenate([mc.cusum_stats(mc.gen_wins(rng, drawn, horizon, 0.5), 0.5, 0.45).max(axis=1) for _ in range(4000 // drawn)]), 0.95)


def stream(verdicts):
    return metrics.wins(verdicts).withColumn("k", F.lit("run"))


def test_canary_promotes_and_rolls_back(spark):
    h = threshold(131, 9660)
    assert h == pytest.approx(6.678611961772855, abs=1e-9)
    canary = folds.Canary(h=h)
    up = folds.canary_transitions(stream(replay.recorded_verdicts(spark, 30000, 131, JUDGE, shadow_rate=0.35)), "k", canary).collect()
    assert [r["request_index"] for r in up] == [3259, 5229, 8569, 10525] and up[-1]["kind"] == "canary_promoted"
    assert [r["share"] for r in up] == [0.01, 0.05, 0.25, 1.0]
    down = folds.canary_transitions(stream(replay.recorded_verdicts(spark, 30000, 131, JUDGE, shadow_rate=0.35, epsilon=0.25, changepoint=6000)), "k", canary).collect()
    assert [r["request_index"] for r in down] == [3259, 5229, 7065] and down[-1]["kind"] == "canary_rolled_back"


def test_fleet_alarm(spark):
    v = replay.recorded_verdicts(spark, 20000, 101, JUDGE, shadow_rate=0.25, epsilon=0.15, changepoint=8000).cache()
    assert v.count() == 5040
    alarm = seqtest.cusum(stream(v), ["k"], "request_index", 0.5, 0.45, threshold(102, 4600)).first()
    assert alarm["alarm_at"] == 13258


def test_position_bias(spark):
    judge = NoisyOracle(accuracy=0.85, tie_rate=0.1, position_bias=0.2)
    randomised = replay.recorded_verdicts(spark, 4000, 87, judge, "randomized").cache()
    fixed = replay.recorded_verdicts(spark, 4000, 87, judge, "fixed-order", randomise=False)
    assert metrics.win_rate(randomised).first()["win_rate"] == pytest.approx(0.49819293855991104, abs=1e-12)
    assert metrics.win_rate(fixed).first()["win_rate"] == pytest.approx(0.3887496519075466, abs=1e-12)
    assert metrics.position_bias(randomised).first()["position_bias"] == pytest.approx(0.091326105087573, abs=1e-12)
