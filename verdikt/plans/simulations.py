"""The studies as queries, at their published settings. Their draws have no SQL: tests compare
recorded runs with published values, and keyed twins of the simulations have SQL in ``lifecycle``."""

from __future__ import annotations

from ..operators import montecarlo as mc
from ..operators import studies
from .queries import QUERIES, query


@query()
def cusum_calibration(spark, sf):
    return spark.createDataFrame([(mc.calibrate_cusum(spark, 4000, 20_000, 0.5, 0.45, 0.05, 2026),)], "threshold double")


@query()
def psi_calibration(spark, sf):
    return spark.createDataFrame([(mc.calibrate_psi(spark, 400, 29_000, [0.25] * 4, 1000, 100, 0.05, 113),)], "threshold double")


@query()
def disagreement_calibration(spark, sf):
    return spark.createDataFrame([(mc.calibrate_disagreement(spark, 2000, 6000, 0.25, 300, 0.05, 7),)], "threshold double")


STUDIES = {
    "detection_latency": studies.detection_latency, "false_alarm_rates": studies.false_alarms, "sprt_validation": studies.sprt_validation,
    "method_comparison": studies.method_comparison, "dilution_study": studies.dilution, "multi_arm_study": studies.multi_arm,
    "ensemble_detection": studies.ensemble_detection, "judge_rounds": studies.judge_rounds, "judge_ensemble_study": studies.judge_ensemble,
    "full_loop": studies.full_loop, "stratified_study": studies.stratified, "drift_gate": studies.drift_gate, "drift_topic_rates": studies.topic_rates,
}
QUERIES.update({name: lambda spark, sf, f=f: f(spark) for name, f in STUDIES.items()})
