"""Verdicts by sequential PCG64 draws, for parity with runs recorded that way.

A request's draws come from generators keyed by (seed, index, stream); a comparison
takes its draws in order: swap, tie, bias, then coin or accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship
from ..functions.draws import pcg
from .judging import NoisyOracle

#: The topics of recorded runs, in the order in which thresholds are drawn for them.
TOPICS = ("science", "history", "coding", "health")
SCHEMA = "request_index long, topic string, b_pool string, winner string, first_shown string"


def place(judge: NoisyOracle, rng: np.random.Generator, first: bool, second: bool) -> str:
    """'first', 'second' or 'tie': tie, then blind first place, then a coin for equals, then accuracy."""
    if rng.random() < judge.tie_rate:
        return "tie"
    if judge.position_bias and rng.random() < judge.position_bias:
        return "first"
    if first == second:
        return "first" if rng.random() < 0.5 else "second"
    return "first" if (rng.random() < judge.accuracy) == first else "second"


def majority(judges: list[NoisyOracle], rng: np.random.Generator, first: bool, second: bool) -> tuple[str, bool]:
    """The place that most of an odd number of judges give, each by draws of its own, and whether they differ."""
    votes = [place(j, r, first, second) for j, r in zip(judges, rng.spawn(len(judges)))]
    bar = len(judges) // 2 + 1
    return next((v for v in ("first", "second") if votes.count(v) >= bar), "tie"), len(set(votes)) > 1


def shown(rng: np.random.Generator, a_good: bool, b_good: bool, judge: Callable[[np.random.Generator, bool, bool], str], randomise: bool = True) -> tuple[str, str]:
    """(winner, first_shown)."""
    swap = randomise and rng.random() < 0.5
    got = judge(rng, b_good, a_good) if swap else judge(rng, a_good, b_good)
    winner = "tie" if got == "tie" else "b" if (got == "first") == swap else "a"
    return winner, "b" if swap else "a"


def compare(judge: NoisyOracle, rng: np.random.Generator, a_good: bool, b_good: bool, randomise: bool = True) -> tuple[str, str]:
    return shown(rng, a_good, b_good, lambda r, x, y: place(judge, r, x, y), randomise)


def topic_of(seed: int, index: int, weights: dict[str, float] | None) -> str:
    """The topic of a request: one weighted draw over the topics in order of name."""
    names = sorted(TOPICS)
    p = np.array([1.0 if weights is None else weights.get(t, 0.0) for t in names])
    return names[int(pcg(seed, index, "__traffic__").choice(len(names), p=p / p.sum()))]


def _rows(spark: SparkSession, n: int, make: Callable[[int], tuple | None], schema: str) -> DataFrame:
    """What ``make`` gives for each of n indices, made where the index is."""
    ship(spark)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([r for i in p["id"].tolist() if (r := make(i)) is not None], columns=names)

    return spark.range(n).mapInPandas(run, schema)


def recorded_requests(spark: SparkSession, n: int, seed: int, after: dict[str, float] | None = None, shift_at: int | None = None) -> DataFrame:
    """request_index, topic; the topics' weights change at an index."""
    return _rows(spark, n, lambda i: (i, topic_of(seed, i, after if shift_at is not None and i >= shift_at else None)), "request_index long, topic string")


def recorded_verdicts(
    spark: SparkSession, n: int, seed: int, judge: NoisyOracle, judge_id: str = "noisy-oracle", shadow_rate: float = 1.0,
    epsilon: float = 0.0, changepoint: int | None = None, randomise: bool = True,
    regressed_topic: str | None = None, after: dict[str, float] | None = None, shift_at: int | None = None,
) -> DataFrame:
    """Verdicts of n requests; the challenger is bad with probability epsilon from the changepoint on, on one topic only if given."""

    def make(i: int) -> tuple | None:
        if pcg(seed, i, "__router__").random() >= shadow_rate:
            return None
        topic = topic_of(seed, i, after if shift_at is not None and i >= shift_at else None)
        on = changepoint is not None and i >= changepoint and regressed_topic in (None, topic)
        bad = pcg(seed, i, "challenger#mixture").random() < (epsilon if on else 0.0)
        return i, topic, "bad" if bad else "good", *compare(judge, pcg(seed, i, f"__judge__{judge_id}"), True, not bad, randomise)

    return _rows(spark, n, make, SCHEMA)


def recorded_comparisons(spark: SparkSession, n: int, seed: int, members_at: Callable[[int], list[NoisyOracle]], b_good: bool = False) -> DataFrame:
    """request_index, winner, disagreed of n comparisons of a good response with another, by an ensemble or one judge."""

    def make(i: int) -> tuple:
        members, split = members_at(i), [False]

        def judge(rng: np.random.Generator, x: bool, y: bool) -> str:
            if len(members) == 1:
                return place(members[0], rng, x, y)
            got, split[0] = majority(members, rng, x, y)
            return got

        winner, _ = shown(np.random.default_rng([seed, i]), True, b_good, judge)
        return i, winner, int(split[0])

    return _rows(spark, n, make, "request_index long, winner string, disagreed int")


def recorded_calibrations(spark: SparkSession, rounds: int, items: int, seed: int, judge_at: Callable[[int], NoisyOracle], queries: int = 200, variants: int = 4) -> DataFrame:
    """round, item, label, winner: anchors judged anew each round."""

    def make(k: int) -> tuple:
        turn, i = divmod(k, items)
        rng = np.random.default_rng([seed, i])
        for size in (queries, variants, variants):  # the query and its two responses
            rng.integers(size)
        label = "a" if rng.random() < 0.5 else "b"
        winner, _ = compare(judge_at(turn), np.random.default_rng([seed, turn, i]), label == "a", label == "b")
        return turn, i, label, winner

    return _rows(spark, rounds * items, make, "round long, item long, label string, winner string")
