"""End-to-end studies: simulated grids with one row a setting, and recorded runs replayed.

Trials and requests are the parallel dimension; what a study gathers is a few numbers a
setting. Parameters default to the published settings; tests run smaller ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import JudgeChannel, SprtDesign
from . import folds, metrics, replay, seqtest
from . import montecarlo as mc
from .judging import NoisyOracle

JUDGE = NoisyOracle(accuracy=0.85, tie_rate=0.1, position_bias=0.15)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def detection_latency(
    spark: SparkSession, shifts: tuple[float, ...] = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1), trials: int = 1500, horizon: int = 20_000,
    changepoint: int = 5000, calibration: int = 4000, sampling: float = 0.2, seed: int = 2026,
) -> DataFrame:
    """shift, h, detect_rate, premature_rate, latencies in verdicts, the median in requests."""
    channel = JudgeChannel(0.85, sampling, 0.1)
    h = mc.calibrate_cusum(spark, calibration, horizon, 0.5, 0.45, 0.05, seed)

    def one(k: int, shift: float) -> DataFrame:
        after = 0.5 - shift * channel.attenuation
        made = mc.simulate(spark, trials, seed + 1 + k, lambda rng, n: {"alarm": mc.cusum_alarms(mc.gen_wins_changepoint(rng, n, horizon, 0.5, after, changepoint), 0.5, 0.45, h)}, "alarm long")
        return made.withColumn("shift", F.lit(shift))

    out = metrics.detection_summary(_all([one(k, s) for k, s in enumerate(shifts)]), changepoint, ["shift"])
    return out.withColumn("h", F.lit(h)).withColumn("latency_requests", F.col("latency_p50") * channel.requests_per_verdict)


def false_alarms(spark: SparkSession, trials: int = 2000, horizon: int = 20_000, calibration: int = 4000, seed: int = 2026) -> DataFrame:
    """cusum, peeking: how often a null stream trips a calibrated alarm and repeated z-tests."""
    h = mc.calibrate_cusum(spark, calibration, horizon, 0.5, 0.45, 0.05, seed)

    def run(rng: np.random.Generator, n: int) -> dict:
        w = mc.gen_wins(rng, n, horizon, 0.5)
        return {"cusum": mc.cusum_alarms(w, 0.5, 0.45, h) > 0, "peeking": mc.peeking_trips(w)}

    df = mc.simulate(spark, trials, seed + 100, run, "cusum boolean, peeking boolean")
    return df.agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in ("cusum", "peeking")])


def sprt_validation(spark: SparkSession, rates: tuple[float, ...] = tuple(round(0.4 + 0.02 * k, 2) for k in range(13)), trials: int = 2000, most: int = 20_000, seed: int = 2027) -> DataFrame:
    """p, promoted, mean_n, censored, theory, theory_n over true rates."""
    d = SprtDesign(0.5, 0.55)

    def one(k: int, p: float) -> DataFrame:
        def run(rng: np.random.Generator, n: int) -> dict:
            decision, stop = mc.sprt_decisions(mc.gen_wins(rng, n, most, p), d)
            return {"decision": decision, "stop": stop}

        df = mc.simulate(spark, trials, seed + k, run, "decision int, stop long")
        of = lambda v: F.avg((F.col("decision") == v).cast("int"))
        return df.agg(of(1).alias("promoted"), F.avg("stop").alias("mean_n"), of(0).alias("censored")).select(F.lit(p).alias("p"), "*", F.lit(d.accept_h1(p)).alias("theory"), F.lit(d.expected_n(p)).alias("theory_n"))

    return _all([one(k, p) for k, p in enumerate(rates)])


METHODS = ("sprt", "mixture", "stitched")


def _methods(wins: np.ndarray, alpha: float) -> dict[str, np.ndarray]:
    decision, stop = mc.sprt_decisions(wins, SprtDesign(0.5, 0.55, alpha))
    return {"sprt": np.where(decision == 1, stop, -1), "mixture": mc.mixture_rejections(wins, 0.5, alpha), "stitched": mc.stitched_rejections(wins, 0.5, alpha)}


def _times(df: DataFrame, names: tuple[str, ...], after: int = 0) -> DataFrame:
    """method, detect_rate, latency_p50 of columns of alarm times."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("alarm")) for n in names])).alias("r")).select("r.*")
    return metrics.detection_summary(long, after, ["method"]).select("method", "detect_rate", F.col("latency_p50").alias("median"))


def method_comparison(spark: SparkSession, effects: tuple[float, ...] = (0.5, 0.52, 0.54, 0.55, 0.56, 0.58, 0.6), trials: int = 1500, null_trials: int = 4000, horizon: int = 20_000, seed: int = 2028) -> DataFrame:
    """w, method, detect_rate, median; w = 0.5 gives the false promotions."""

    def one(k: int, w: float) -> DataFrame:
        n = null_trials if w == 0.5 else trials
        df = mc.simulate(spark, n, seed + k, lambda rng, m: _methods(mc.gen_wins(rng, m, horizon, w), 0.05), "sprt long, mixture long, stitched long")
        return _times(df, METHODS).withColumn("w", F.lit(w))

    return _all([one(k, w) for k, w in enumerate(effects)])


def dilution(spark: SparkSession, prefixes: tuple[int, ...] = (0, 2500, 5000, 10_000), trials: int = 800, window: int = 15_000, calibration: int = 4000, seed: int = 2029) -> DataFrame:
    """prefix, method, detect_rate, median latency of a drop after ever longer healthy streams. The
    tests that look for a rise see the stream of losses."""

    def one(k: int, prefix: int) -> DataFrame:
        horizon = prefix + window
        h = mc.calibrate_cusum(spark, calibration, horizon, 0.5, 0.45, 0.05, seed + 10 * k)

        def run(rng: np.random.Generator, n: int) -> dict:
            wins = mc.gen_wins_changepoint(rng, n, horizon, 0.5, 0.45, prefix)
            return {"cusum": mc.cusum_alarms(wins, 0.5, 0.45, h), "mixture": mc.mixture_rejections(~wins, 0.5, 0.05), "stitched": mc.stitched_rejections(~wins, 0.5, 0.05)}

        df = mc.simulate(spark, trials, seed + 10 * k + 1, run, "cusum long, mixture long, stitched long")
        return _times(df, ("cusum", "mixture", "stitched"), prefix).withColumn("prefix", F.lit(prefix))

    return _all([one(k, p) for k, p in enumerate(prefixes)])


def multi_arm(spark: SparkSession, arms: int = 4, null_trials: int = 2000, trials: int = 1500, horizon: int = 20_000, good: float = 0.55, alpha: float = 0.05, seed: int = 2030) -> DataFrame:
    """correction (arms divided by), family_error, promotion_median of a truly better arm."""

    def run(rng: np.random.Generator, n: int) -> dict:
        hit = {1: np.zeros(n, bool), arms: np.zeros(n, bool)}
        for _ in range(arms):
            wins = mc.gen_wins(rng, n, horizon, 0.5)
            for a in hit:
                hit[a] |= mc.mixture_rejections(wins, 0.5, alpha / a) > 0
        return {"plain": hit[1], "corrected": hit[arms]}

    def better(rng: np.random.Generator, n: int) -> dict:
        wins = mc.gen_wins(rng, n, horizon, good)
        return {"plain": mc.mixture_rejections(wins, 0.5, alpha), "corrected": mc.mixture_rejections(wins, 0.5, alpha / arms)}

    names = ("plain", "corrected")
    errors = mc.simulate(spark, null_trials, seed, run, "plain boolean, corrected boolean")
    errors = errors.select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).cast("int").alias("hit")) for n in names])).alias("r")).groupBy("r.method").agg(F.avg("r.hit").alias("family_error"))
    found = _times(mc.simulate(spark, trials, seed + 1, better, "plain long, corrected long"), names).withColumnRenamed("median", "promotion_median")
    return errors.join(found, "method")


def ensemble_detection(
    spark: SparkSession, sizes: tuple[int, ...] = (1, 3, 5), shifts: tuple[float, ...] = (0.03, 0.05), comparisons: int = 20_000, trials: int = 1500,
    prefix: int = 5000, horizon: int = 20_000, calibration: int = 4000, sampling: float = 0.25, seed: int = 139,
) -> DataFrame:
    """k, shift, accuracy, decisive_rate, detect_rate, median (requests): what more judges buy."""
    h = mc.calibrate_cusum(spark, calibration, horizon, 0.5, 0.45, 0.05, seed)

    def one(k: int, shift: float, accuracy: float, decisive: float) -> DataFrame:
        after = 0.5 - shift * (2 * accuracy - 1)
        df = mc.simulate(spark, trials, seed + k, lambda rng, n: {"cusum": mc.cusum_alarms(mc.gen_wins_changepoint(rng, n, horizon, 0.5, after, prefix), 0.5, 0.45, h)}, "cusum long")
        made = _times(df, ("cusum",), prefix)
        return made.select(F.lit(k).alias("k"), F.lit(shift).alias("shift"), F.lit(accuracy).alias("accuracy"), F.lit(decisive).alias("decisive_rate"), "detect_rate", (F.col("median") / (sampling * decisive)).alias("median_requests"))

    channels = {k: ensemble_channel(spark, k, seed + 10 * k, comparisons).first() for k in sizes}
    return _all([one(k, s, c["accuracy"], c["decisive_rate"]) for k, c in channels.items() for s in shifts])


def ensemble_channel(spark: SparkSession, k: int, seed: int, comparisons: int = 20_000) -> DataFrame:
    """accuracy, decisive_rate of k judges alike on a good and a bad response."""
    judged = replay.recorded_comparisons(spark, comparisons, seed, lambda _: [JUDGE] * k)
    own = metrics.decisive(judged).agg(F.avg((F.col("winner") == "a").cast("int")).alias("accuracy"), (F.count(F.lit(1)) / comparisons).alias("decisive_rate"))
    return own


def judge_rounds(spark: SparkSession, rounds: int = 20, items: int = 300, degrade_at: int = 10, healthy: float = 0.85, degraded: float = 0.72, least: float = 0.8, seed: int = 55) -> DataFrame:
    """round, right, n, accuracy, low, high, alarmed: anchors judged anew each round; a round alarms
    when even the upper end of its interval is below the floor."""
    judged = replay.recorded_calibrations(spark, rounds, items, seed, lambda r: NoisyOracle(healthy if r < degrade_at else degraded, 0.1))
    return calibration_alarms(judged, ["round"], least)


def calibration_alarms(judged: DataFrame, by: list[str], least: float) -> DataFrame:
    return metrics.accuracy(judged, by).withColumn("alarmed", (F.col("high") < least).cast("int"))


def judge_ensemble(spark: SparkSession, n: int = 6000, degrade_at: int = 3000, window: int = 300, calibration: int = 2000, seed: int = 127) -> DataFrame:
    """before, after (disagreement), threshold, alarm_n: a panel notices that one of its members fails."""
    panel = lambda third: [NoisyOracle(0.85, 0.1), NoisyOracle(0.85, 0.1), NoisyOracle(third, 0.1)]
    judged = replay.recorded_comparisons(spark, n, seed, lambda i: panel(0.85 if i < degrade_at else 0.55)).withColumn("k", F.lit("run"))
    early = F.col("request_index") < degrade_at
    rates = judged.agg(F.avg(F.when(early, F.col("disagreed"))).alias("before"), F.avg(F.when(~early, F.col("disagreed"))).alias("after"))
    before = rates.first()["before"]
    threshold = mc.calibrate_disagreement(spark, calibration, n, before, window, 0.05, seed)
    alarm = seqtest.rolling_alarm(judged, ["k"], "request_index", "disagreed", window, threshold)
    return rates.crossJoin(alarm.select("alarm_n")).withColumn("threshold", F.lit(threshold))  # one row each


def _wins(verdicts: DataFrame) -> DataFrame:
    return metrics.wins(verdicts).withColumn("k", F.lit("run"))


def full_loop(spark: SparkSession, n: int = 30_000, changepoint: int = 10_000, epsilon: float = 0.15, shadow_rate: float = 0.25, seed: int = 71) -> DataFrame:
    """run, alarm_at, latency, win rates before and after, position bias of a regressed and a healthy run."""
    runs = {name: replay.recorded_verdicts(spark, n, seed, JUDGE, shadow_rate=shadow_rate, epsilon=e, changepoint=changepoint) for name, e in (("regressed", epsilon), ("null", 0.0))}
    decisive = metrics.decisive(runs["null"]).count()
    h = mc.recorded_thresholds(spark, seed + 1, [(decisive, 0.05)])[0]

    def one(name: str, verdicts: DataFrame) -> DataFrame:
        alarm = seqtest.cusum(_wins(verdicts), ["k"], "request_index", 0.5, 0.45, h).select("alarm_at")
        early = F.col("request_index") < changepoint
        rates = metrics.wins(verdicts).agg(F.avg(F.when(early, F.col("win"))).alias("before"), F.avg(F.when(~early, F.col("win"))).alias("after"))
        return alarm.crossJoin(rates).crossJoin(metrics.position_bias(verdicts).select("position_bias")).select(F.lit(name).alias("run"), "*", (F.col("alarm_at") - changepoint).alias("latency"))  # one row each

    return _all([one(k, v) for k, v in runs.items()])


def stratified(spark: SparkSession, n: int = 40_000, changepoint: int = 10_000, epsilon: float = 0.5, topic: str = "coding", shadow_rate: float = 0.25, alpha: float = 0.05, seed: int = 61) -> DataFrame:
    """run, stratum, alarm_at, latency, level: one alarm a topic at its share of alpha, beside one for all."""
    make = lambda e: metrics.wins(replay.recorded_verdicts(spark, n, seed, JUDGE, shadow_rate=shadow_rate, epsilon=e, changepoint=changepoint, regressed_topic=topic if e else None))
    runs = {"regressed": make(epsilon), "null": make(0.0)}
    sizes = {r["topic"]: r["count"] for r in runs["null"].groupBy("topic").count().collect()}
    k = len(replay.TOPICS)
    hs = mc.recorded_thresholds(spark, seed + 1, [(sum(sizes.values()), alpha), *[(sizes[t], alpha / k) for t in replay.TOPICS]])
    thresholds = dict(zip(["all", *replay.TOPICS], hs))

    def one(name: str, wins: DataFrame) -> DataFrame:
        both = wins.select(F.col("topic").alias("stratum"), "request_index", "win").unionByName(wins.select(F.lit("all").alias("stratum"), "request_index", "win"))
        found = seqtest.stratified_cusum(both, "stratum", "request_index", 0.5, 0.45, thresholds)
        return found.select(F.lit(name).alias("run"), "stratum", "alarm_at", (F.col("alarm_at") - changepoint).alias("latency"), "level")

    return _all([one(name, w) for name, w in runs.items()])


#: The topics' weights after the shift of the recorded drift study.
SHIFTED = {"coding": 0.7, "science": 0.1, "history": 0.1, "health": 0.1}


def drift_gate(spark: SparkSession, n: int = 30_000, shift_at: int = 15_000, epsilon: float = 0.15, shadow_rate: float = 0.25, window: int = 1000, stride: int = 100, learn: int = 600, seed: int = 113) -> DataFrame:
    """run, drift_at, psi_threshold, h, ungated, gated: alarm indices of a challenger weak on the topic that
    traffic shifts to, with and without a gate at the drift alarm, and of an equal one as a control."""
    names = sorted(replay.TOPICS)
    limit = float(np.quantile(mc.psi_max(np.random.default_rng(seed), 400, n - window, np.full(len(names), 1 / len(names)), window, stride), 0.95))
    h = mc.recorded_thresholds(spark, seed + 2, [(int(n * shadow_rate * 0.92), 0.05)])[0]

    def one(name: str, own: int, weak: bool) -> DataFrame:
        requests = replay.recorded_requests(spark, n, own, SHIFTED, shift_at).withColumn("k", F.lit("run"))
        psi = seqtest.psi_path(requests, ["k"], "request_index", "topic", names, window, stride)
        drift_at = psi.filter(F.col("psi") >= limit).agg(F.min("request_index")).first()[0]
        wins = _wins(replay.recorded_verdicts(spark, n, own, JUDGE, shadow_rate=shadow_rate, epsilon=epsilon if weak else 0.0, changepoint=0, regressed_topic="coding" if weak else None, after=SHIFTED, shift_at=shift_at))
        first = lambda gate, c: folds.rebaselined_alarms(wins, "k", folds.Rebaseline(h=h, learn=learn, gate=gate)).agg(F.min("request_index").alias(c))
        settings = (F.lit(name).alias("run"), F.lit(drift_at).cast("long").alias("drift_at"), F.lit(limit).alias("psi_threshold"), F.lit(h).alias("h"))
        return first(None, "ungated").crossJoin(first(drift_at, "gated")).select(*settings, "*")  # one row each

    return one("weak", seed, True).unionByName(one("control", seed + 1, False))


def topic_rates(spark: SparkSession, n: int = 30_000, shift_at: int = 15_000, epsilon: float = 0.15, shadow_rate: float = 0.25, seed: int = 113) -> DataFrame:
    """topic, before, after: win rates a topic of the drift study's weak run."""
    v = replay.recorded_verdicts(spark, n, seed, JUDGE, shadow_rate=shadow_rate, epsilon=epsilon, changepoint=0, regressed_topic="coding", after=SHIFTED, shift_at=shift_at)
    return metrics.by_phase(metrics.wins(v), shift_at)
