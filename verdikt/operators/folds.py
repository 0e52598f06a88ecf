"""State machines that restart at data-dependent rows, in batch and as steps for streams.

In batch the restarts are few: a canary has four, a drift alarm makes one. Each stretch between
them runs through the window forms of the tests, and the next one begins at the first crossing;
no stream is one task. A stream takes the same rules step by step, with a state of numbers and
strings that can be stored anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cluster import beside, written
from . import seqtest

#: Stages of a canary and their traffic shares, first to last, and what follows.
STAGES = (("shadow", 0.0), ("canary-1", 0.01), ("canary-5", 0.05), ("canary-25", 0.25))
FULL, ROLLED_BACK = ("full", 1.0), ("rolled-back", 0.0)


@dataclass(frozen=True)
class Canary:
    """A fresh mixture gate each stage, one drop alarm across all. The alarm is looked at first."""

    p0: float = 0.5
    p1: float = 0.45
    h: float = 6.0
    margin: float = 0.06
    alpha: float = 0.05

    def __post_init__(self) -> None:
        if not (0 < self.p1 < self.p0 < 1 and 0 < self.margin < self.p0 and 0 < self.alpha < 1 and self.h > 0):
            raise ValueError("0 < p1 < p0 < 1, 0 < margin < p0, 0 < alpha < 1 and h > 0 are needed")

    @staticmethod
    def start() -> dict:
        return {"stage": 0, "over": 0, "stat": 0.0, "n": 0, "s": 0, "lf_n": 0.0, "lf_s": 0.0, "lf_f": 0.0, "tail": -1.0, "total": 0}

    def step(self, st: dict, win: int) -> tuple | None:
        """Takes a decisive verdict; gives (kind, stage, share, verdicts in stage) on a transition."""
        if st["over"]:
            return None
        st["stat"] = max(0.0, st["stat"] + (math.log(self.p1 / self.p0) if win else math.log((1 - self.p1) / (1 - self.p0))))
        st["total"] += 1
        if st["stat"] >= self.h:
            st["over"] = 1
            return "canary_rolled_back", *ROLLED_BACK, st["n"] + 1
        p = self.p0 - self.margin
        st["n"] += 1
        st["s"] += win
        f = st["n"] - st["s"]
        st["lf_n"] += math.log(st["n"])
        if win:
            st["lf_s"] += math.log(st["s"])
        else:
            st["lf_f"] += math.log(f)
        if st["tail"] < 0:
            st["tail"] = 1 - p
        term = math.exp(st["lf_n"] - st["lf_s"] - st["lf_f"] + st["s"] * math.log(p) + f * math.log(1 - p))
        st["tail"] = max(0.0, st["tail"] + ((1 - p) * term if win else -p * term))
        if st["tail"] <= 0 or st["s"] <= p * st["n"]:  # below p the ratio is under 1, and the tail has no digits left
            return None
        mix = st["lf_s"] + st["lf_f"] - st["lf_n"] - math.log(st["n"] + 1) + math.log(st["tail"]) - math.log(1 - p) - st["s"] * math.log(p) - f * math.log(1 - p)
        if mix < math.log(len(STAGES) / self.alpha):
            return None
        st["stage"] += 1
        st.update(n=0, s=0, lf_n=0.0, lf_s=0.0, lf_f=0.0, tail=-1.0)
        if st["stage"] == len(STAGES):
            st["over"] = 1
            return "canary_promoted", *FULL, 0
        return "canary_advanced", *STAGES[st["stage"]], 0


@dataclass(frozen=True)
class Rebaseline:
    """A drop alarm that a gate resets: then ``learn`` verdicts set a new p0 before testing goes on."""

    p0: float = 0.5
    drop: float = 0.05
    h: float = 6.0
    learn: int = 600
    gate: int | None = None

    @staticmethod
    def start() -> dict:
        return {"p0": -1.0, "stat": 0.0, "gated": 0, "n": 0, "s": 0, "over": 0}

    def step(self, st: dict, win: int, index: int) -> tuple | None:
        if st["over"]:
            return None
        if self.gate is not None and not st["gated"] and index >= self.gate:
            st.update(gated=1, stat=0.0, n=0, s=0)
        if st["gated"] == 1:
            st["n"] += 1
            st["s"] += win
            if st["n"] == self.learn:
                st.update(p0=min(0.9, max(0.1, st["s"] / st["n"])), gated=2, stat=0.0)
            return None
        p0 = st["p0"] if st["p0"] > 0 else self.p0
        p1 = p0 - self.drop
        st["stat"] = max(0.0, st["stat"] + (math.log(p1 / p0) if win else math.log((1 - p1) / (1 - p0))))
        if st["stat"] >= self.h:
            st["over"] = 1
            return "quality_alarm", p0
        return None


def _wins(stream: DataFrame, key: str) -> DataFrame:
    """Written, as several passes read it."""
    return written(stream.select(key, F.col("request_index").cast("long").alias("request_index"), F.col("win").cast("int").alias("win")).dropna(subset=[key, "request_index"]))


def canary_transitions(stream: DataFrame, key: str, canary: Canary) -> DataFrame:
    """Transitions of each stream of (key, request_index, win), in order of request_index.

    The drop alarm is one window pass over all stages. A stage's gate is one over what follows
    the stage before, up to the alarm; there are as many as stages, and no stream is one task.
    """
    rows = _wins(stream, key)
    alarms = written(seqtest.cusum(rows, [key], "request_index", canary.p0, canary.p1, canary.h).filter("alarm_at IS NOT NULL").select(key, "alarm_at"))
    live = beside(rows, alarms, key, "left").filter("alarm_at IS NULL OR request_index < alarm_at").drop("alarm_at")
    moves, after = [], [*STAGES[1:], FULL]
    for k, (stage, share) in enumerate(after):
        gate = seqtest.mixture_sprt(live, [key], "request_index", canary.p0 - canary.margin, canary.alpha / len(STAGES))
        at = written(gate.filter("reject_at IS NOT NULL").select(key, F.col("reject_at").alias("at")))
        if at.isEmpty():
            break  # no stream is in a later stage
        kind = "canary_promoted" if k == len(after) - 1 else "canary_advanced"
        moves.append(at.select(key, F.col("at").alias("request_index"), F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), F.lit(share).alias("share"), F.lit(0).cast("long").alias("verdicts_in_stage")))
        live = beside(live, at, key).filter("request_index > at").drop("at")
    if moves:
        moves = [reduce(DataFrame.unionByName, moves)]
        last = written(moves[0].groupBy(key).agg(F.max("request_index").alias("last"), F.max(F.col("kind") == "canary_promoted").alias("through")))
        alarms = beside(alarms, last, key, "left").filter("NOT coalesce(through, false)")
    else:
        alarms = alarms.withColumn("last", F.lit(None).cast("long"))
    fallen = beside(rows, written(alarms.select(key, "alarm_at", "last")), key).filter("request_index <= alarm_at AND (last IS NULL OR request_index > last)")
    back = fallen.groupBy(key).agg(F.max("alarm_at").alias("request_index"), F.count(F.lit(1)).alias("verdicts_in_stage"))
    back = back.withColumns({"kind": F.lit("canary_rolled_back"), "stage": F.lit(ROLLED_BACK[0]), "share": F.lit(ROLLED_BACK[1])})
    moves.append(back.select(key, "request_index", "kind", "stage", "share", "verdicts_in_stage"))
    return reduce(DataFrame.unionByName, moves).orderBy(key, "request_index")  # five a stream at most


def rebaselined_alarms(stream: DataFrame, key: str, rule: Rebaseline, gates: DataFrame | None = None) -> DataFrame:
    """The first alarm of each stream, and the p0 that it was raised against.

    gates: (key, gate) of drift alarms, one a stream, where they are not all at ``rule.gate``.
    Three window passes: what is before the gate, the numbering of what is after it, and what
    follows the verdicts that the new p0 is learned from.
    """
    rows = _wins(stream, key)
    if gates is None:
        rows = rows.withColumn("gate", F.lit(rule.gate).cast("long"))
    else:
        rows = beside(rows, written(gates.select(key, F.col("gate").cast("long"))), key, "left")
    early = rows.filter("gate IS NULL OR request_index < gate")
    first = seqtest.cusum(early, [key], "request_index", rule.p0, rule.p0 - rule.drop, rule.h).filter("alarm_at IS NOT NULL")
    first = written(first.select(key, F.col("alarm_at").alias("request_index"), F.lit("quality_alarm").alias("kind"), F.lit(rule.p0).alias("p0")))
    late = beside(rows.filter("request_index >= gate"), first.select(key), key, "left_anti")
    late = written(seqtest.numbered(late.select(key, "request_index", "win"), [key], "request_index"))
    learned = late.filter(F.col("n") <= rule.learn).groupBy(key).agg(F.avg("win").alias("p0"), F.count(F.lit(1)).alias("_seen")).filter(F.col("_seen") == rule.learn)
    learned = written(learned.select(key, F.greatest(F.lit(0.1), F.least(F.lit(0.9), "p0")).alias("p0")))
    after = beside(late.filter(F.col("n") > rule.learn).drop("n"), learned, key).withColumn("p1", F.col("p0") - rule.drop)
    again = seqtest.cusum(after, [key], "request_index", "p0", "p1", rule.h).filter("alarm_at IS NOT NULL").select(key, F.col("alarm_at").alias("request_index"), F.lit("quality_alarm").alias("kind"))
    return first.unionByName(beside(again, learned, key))


def promoted_arms(stream: DataFrame, p0: float, alpha: float, corrected: bool = True) -> DataFrame:
    """One mixture test an arm, at alpha over the number of arms; each arm's first crossing."""
    arms = stream.select("arm").distinct().count() if corrected else 1
    return seqtest.mixture_sprt(stream, ["arm"], "request_index", p0, alpha / max(1, arms))


def fold_rows(canary: Canary, rows: Iterator[tuple[int, int]]) -> list[tuple]:
    """All transitions of one stream of (request_index, win), for use without Spark."""
    st = canary.start()
    return [(i, *t) for i, w in rows if (t := canary.step(st, w))]


@dataclass(frozen=True)
class Decision:
    """A drop alarm and a promotion gate on one stream; a reset starts both anew. Each is told once."""

    p0: float = 0.5
    p1: float = 0.45
    h: float = 6.0
    alpha: float = 0.05

    @staticmethod
    def start() -> dict:
        return {"alarmed": 0, "promoted": 0, "alarm": Rebaseline.start(), "gate": Canary.start()}

    def reset(self, st: dict) -> None:
        st.update(alarm=Rebaseline.start(), gate=Canary.start())

    @cached_property
    def _tests(self) -> tuple[Rebaseline, Canary]:
        """The alarm, and the gate of a canary's first stage, with the whole alpha and no margin."""
        return Rebaseline(self.p0, self.p0 - self.p1, self.h), Canary(self.p0, self.p1, math.inf, 1e-12, min(0.999999, self.alpha * len(STAGES)))

    def step(self, st: dict, win: int, index: int) -> list[str]:
        out = []
        alarm, gate = self._tests
        if not st["alarmed"] and alarm.step(st["alarm"], win, index):
            st["alarmed"] = 1
            out.append("quality_alarm")
        if not st["promoted"] and gate.step(st["gate"], win):
            st["promoted"] = 1
            out.append("promotion")
        return out


@dataclass(frozen=True)
class Drift:
    """Population stability of the last ``window`` categories against the first; one alarm."""

    categories: tuple[str, ...]
    window: int = 1000
    stride: int = 100
    threshold: float = 0.1


def decisions(stream: DataFrame, key: str, rule: Decision, resets: DataFrame | None = None) -> DataFrame:
    """(key, request_index, kind) of each stream's first alarm and promotion.

    resets: (key, request_index) of drift alarms; verdicts from there on start anew. Each stretch
    between resets is a stream of its own to the window forms of both tests.
    """
    rows = _wins(stream, key).withColumn("_epoch", F.lit(0).cast("long"))
    if resets is not None:
        w = W.partitionBy(key).orderBy("at")  # a row a reset, of which a stream has a handful
        spans = resets.select(key, F.col("request_index").cast("long").alias("at")).distinct()
        spans = spans.select(key, "at", F.lead("at").over(w).alias("until"), F.row_number().over(w).cast("long").alias("epoch"))
        inside = (F.col("request_index") >= F.col("at")) & (F.col("until").isNull() | (F.col("request_index") < F.col("until")))
        named = written(spans.withColumnRenamed(key, "_k"))
        small = named.limit(100_001).count() <= 100_000
        rows = rows.join(F.broadcast(named) if small else named, (F.col(key) == F.col("_k")) & inside, "left")
        rows = rows.select(key, "request_index", "win", F.coalesce("epoch", F.lit(0)).cast("long").alias("_epoch"))
    both = [key, "_epoch"]
    alarms = seqtest.cusum(rows, both, "request_index", rule.p0, rule.p1, rule.h).select(key, F.col("alarm_at").alias("request_index"), F.lit("quality_alarm").alias("kind"))
    # as the gate of a canary's first stage has it, with the whole alpha and no margin
    alpha = min(0.999999, rule.alpha * len(STAGES)) / len(STAGES)
    gates = seqtest.mixture_sprt(rows, both, "request_index", rule.p0, alpha).select(key, F.col("reject_at").alias("request_index"), F.lit("promotion").alias("kind"))
    found = alarms.unionByName(gates).filter("request_index IS NOT NULL")
    return found.groupBy(key, "kind").agg(F.min("request_index").alias("request_index")).select(key, "request_index", "kind")
