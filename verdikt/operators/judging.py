"""Pairing, position-randomised judges, ensembles, anchors and consensus."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..cluster import ship, written
from ..functions.draws import below
from ..sources import log


def latest(df: DataFrame, key: str = "request_index") -> DataFrame:
    """One row a key: of repeated ones that of greatest seq, or of greatest values where there is no seq."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(*(["seq"] if "seq" in df.columns else []), *[c for c in rest if c != "seq"])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def pairs(champion: DataFrame, shadow: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Champion and shadow responses of one request; a later duplicate replaces an earlier one.

    Texts go along where the responses have them, and the query's text where requests are
    given. All three sides are dealt by request, so the grouping costs no further exchange.
    """
    texts = "text" in champion.columns and "text" in shadow.columns
    seq = lambda d: ["seq"] if "seq" in d.columns else []
    b = latest(shadow.select("request_index", *seq(shadow), F.col("source_pool").alias("b_pool"), *([F.col("text").alias("b_text")] if texts else []))).drop("seq")
    a = champion.select("request_index", *seq(champion), "topic", F.col("source_pool").alias("a_pool"), *([F.col("text").alias("a_text")] if texts else []))
    out = latest(a).drop("seq").join(b, "request_index")
    if requests is not None:
        out = out.join(latest(requests.select("request_index", *seq(requests), "query_text")).drop("seq"), "request_index")
    return out


class Judge(Protocol):
    """Anything that says which of two responses is better: 'first', 'second' or 'tie'.

    It sees request_index, the query's and the two responses' columns in the order shown,
    and adds ``place``. Noisy oracles, reward models and text models are adapted by
    ``oracle_judge``, ``reward_judge`` and ``text_judge``.
    """

    def __call__(self, shown: DataFrame) -> DataFrame: ...


def compare_with(df: DataFrame, seed: int, judge_id: str, judge: Judge, randomise: bool = True) -> DataFrame:
    """Adds first_shown and winner by any judge. df has request_index, query_text, a_text, b_text and a_pool, b_pool."""
    swap = swapped(seed, judge_id) if randomise else F.lit(False)
    df = df.withColumn("first_shown", F.when(swap, "b").otherwise("a"))
    b_first = F.col("first_shown") == "b"
    for out, a, b in (("first", "a_text", "b_text"), ("second", "b_text", "a_text"), ("first_pool", "a_pool", "b_pool"), ("second_pool", "b_pool", "a_pool")):
        df = df.withColumn(out, F.when(b_first, F.col(b)).otherwise(F.col(a)))
    df = judge(df.withColumn("query", F.col("query_text")))
    # a judge that failed on a row leaves its place and so the winner null
    winner = F.when(F.col("place") == "tie", "tie").when((F.col("place") == "first") == b_first, "b").when(F.col("place").isNotNull(), "a")
    return df.withColumn("winner", winner).drop("first", "second", "first_pool", "second_pool", "place", "query")


def oracle_judge(oracle: "NoisyOracle", seed: int, judge_id: str) -> Judge:
    return lambda d: d.withColumn("place", oracle.position(seed, f"__judge__{judge_id}", F.col("first_pool") == "good", F.col("second_pool") == "good"))


def reward_judge(load: Callable[[], Callable[[list[str], list[str]], list[float]]], margin: float = 0.0) -> Judge:
    def judge(d: DataFrame) -> DataFrame:
        d = reward_scores(reward_scores(d, load, "query", "first", "_first"), load, "query", "second", "_second")
        verdict = reward_verdict(F.col("_first"), F.col("_second"), margin)
        return d.withColumn("place", F.when(verdict == "a", "first").when(verdict == "b", "second").otherwise("tie")).drop("_first", "_second")

    return judge


def text_judge(load: "Callable[[], Client]", **calls: int) -> Judge:
    return lambda d: llm_verdicts(d, load, **calls)


@dataclass(frozen=True)
class NoisyOracle:
    """A judge that knows which response is good and errs in known ways."""

    accuracy: float = 0.85
    tie_rate: float = 0.0
    position_bias: float = 0.0

    @property
    def effective_accuracy(self) -> float:
        return 0.5 * self.position_bias + (1 - self.position_bias) * self.accuracy

    def position(self, seed: int, stream: str, first_good: Column, second_good: Column) -> Column:
        """'first', 'second' or 'tie': tie, then blind first place, then a coin for equals, then accuracy."""
        u = lambda name, p: below(seed, "request_index", f"{stream}:{name}", p)
        better = F.when(first_good & ~second_good, "first").otherwise("second")
        worse = F.when(first_good & ~second_good, "second").otherwise("first")
        out = F.when(u("acc", self.accuracy), better).otherwise(worse)
        out = F.when(first_good == second_good, F.when(u("coin", 0.5), "first").otherwise("second")).otherwise(out)
        if self.position_bias:
            out = F.when(u("bias", self.position_bias), "first").otherwise(out)
        return F.when(u("tie", self.tie_rate), "tie").otherwise(out)


def swapped(seed: int, judge_id: str) -> Column:
    return below(seed, "request_index", f"__judge__{judge_id}:swap", 0.5)


def compare_randomised(df: DataFrame, seed: int, judge_id: str, judge: NoisyOracle, randomise: bool = True) -> DataFrame:
    """Adds first_shown and winner (a, b, tie); a_pool and b_pool say which response is good."""
    swap = swapped(seed, judge_id) if randomise else F.lit(False)
    df = df.withColumn("first_shown", F.when(swap, "b").otherwise("a"))
    a, b = F.col("a_pool") == "good", F.col("b_pool") == "good"
    b_first = F.col("first_shown") == "b"
    place = judge.position(seed, f"__judge__{judge_id}", F.when(b_first, b).otherwise(a), F.when(b_first, a).otherwise(b))
    df = df.withColumn("_place", place)
    winner = F.when(F.col("_place") == "tie", "tie").when((F.col("_place") == "first") == b_first, "b").otherwise("a")
    return df.withColumn("winner", winner).drop("_place")


def judge_pairs(df: DataFrame, seed: int, judge_id: str, judge: NoisyOracle, sampling: float = 1.0, randomise: bool = True) -> DataFrame:
    """request_index, topic, winner, first_shown, judge_id of the sampled pairs."""
    kept = df.filter(below(seed, "request_index", f"__judge_sample__{judge_id}", sampling))
    out = compare_randomised(kept, seed, judge_id, judge, randomise)
    return out.select("request_index", "topic", "winner", "first_shown", F.lit(judge_id).alias("judge_id"))


def judge_run(events: DataFrame, run_id: str, seed: int, judge_id: str, judge: Judge, sampling: float = 1.0, config_a: str = "champion", config_b: str = "challenger", randomise: bool = True, after: int | None = None) -> DataFrame:
    """Verdict events of a run's champion and shadow responses, to be appended to its log.

    A verdict's seq derives from its request, so that appending again adds nothing; with
    ``after``, the greatest seq so far, verdicts stand behind it, which lets several
    judges write to one run (and a judge that runs twice write twice).
    """
    own = events.filter(F.col("run_id") == run_id)
    a = log.typed(own, "champion_response").filter(F.col("config_id") == config_a)
    b = log.typed(own, "shadow_response").filter(F.col("config_id") == config_b)
    asked = log.typed(own, "request_received")
    a = a.join(latest(asked.select("request_index", "seq", "topic")).drop("seq"), "request_index")
    both = pairs(a, b, asked).filter(below(seed, "request_index", f"__judge_sample__{judge_id}", sampling))
    out = compare_with(both, seed, judge_id, judge, randomise)
    out = out.select("request_index", "topic", "winner", "first_shown", F.lit(judge_id).alias("judge_id"), F.lit(config_a).alias("config_a"), F.lit(config_b).alias("config_b"))
    made = log.to_events(out, run_id, "verdict_recorded", ["request_index", "topic", "winner", "first_shown", "judge_id", "config_a", "config_b"])
    if after is None:
        return made
    index = F.get_json_object("payload", "$.request_index").cast("long")
    return made.withColumn("seq", F.lit(after + 1) + index)


def ensemble(df: DataFrame, seed: int, judge_id: str, judges: list[NoisyOracle]) -> DataFrame:
    """The majority of members that see one common order; without one, a tie. disagreed: over one distinct vote."""
    if len(judges) % 2 == 0:
        raise ValueError("an ensemble needs an odd number of members")
    df = df.withColumn("first_shown", F.when(swapped(seed, judge_id), "b").otherwise("a"))
    b_first = F.col("first_shown") == "b"
    a, b = F.col("a_pool") == "good", F.col("b_pool") == "good"
    first, second = F.when(b_first, b).otherwise(a), F.when(b_first, a).otherwise(b)
    votes = F.array(*[j.position(seed, f"__judge__{judge_id}:{k}", first, second) for k, j in enumerate(judges)])
    df = df.withColumn("votes", votes)
    count = lambda v: F.size(F.filter("votes", lambda x: x == v))
    bar = len(judges) // 2 + 1
    place = F.when(count("first") >= bar, "first").when(count("second") >= bar, "second").otherwise("tie")
    winner = F.when(place == "tie", "tie").when((place == "first") == b_first, "b").otherwise("a")
    return df.withColumn("winner", winner).withColumn("disagreed", (F.size(F.array_distinct("votes")) > 1).cast("int"))


def anchors(items: DataFrame, seed: int) -> DataFrame:
    """request_index, label, a_pool, b_pool of items with a known better response, which a keyed coin puts first or second."""
    label = F.when(below(seed, "request_index", "__anchor__", 0.5), "a").otherwise("b")
    df = items.withColumn("label", label)
    return df.withColumn("a_pool", F.when(F.col("label") == "a", "good").otherwise("bad")).withColumn("b_pool", F.when(F.col("label") == "b", "good").otherwise("bad"))


def reward_verdict(score_a: Column, score_b: Column, margin: float = 0.0) -> Column:
    """The higher of two scores wins; within the margin it is a tie."""
    return F.when(F.abs(score_a - score_b) <= margin, "tie").when(score_a > score_b, "a").otherwise("b")


def reward_scores(df: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], query: str, answer: str, out: str) -> DataFrame:
    """Adds a reward model's score. ``load`` runs once a task; its result scores batches."""

    ship(df.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, a in parts:
            yield pd.Series(model(list(q), list(a)), dtype="float64")

    return df.withColumn(out, score(F.col(query), F.col(answer)))


class JudgeError(ValueError):
    """A model judge stopped early or answered something else than a verdict."""


PROMPT = "Which response answers the query better? Reply as JSON: {\"winner\": \"1\"}, {\"winner\": \"2\"} or {\"winner\": \"tie\"}."


def parse_verdict(reply: str) -> str:
    try:
        winner = json.loads(reply)["winner"]
        return {"1": "first", "2": "second", "tie": "tie"}[winner]
    except (ValueError, KeyError, TypeError) as e:
        raise JudgeError(f"no verdict in {reply!r}") from e


def parse_verdict_column(reply: Column) -> Column:
    """The same in Catalyst; null where there is no verdict."""
    w = F.get_json_object(reply, "$.winner")
    return F.when(w == "1", "first").when(w == "2", "second").when(w == "tie", "tie")


Client = Callable[[str], tuple[str, str]]


def llm_verdicts(df: DataFrame, load: Callable[[], Client], at_once: int = 8, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """Adds place, or the error that kept it from being told, by a text model.

    ``load`` makes a client once a task, text -> (reply, stop reason); the client is called from
    ``at_once`` threads, at most ``tries`` times a row with growing pauses between. A row that fails
    costs no other its verdict: its place is null and ``error`` says why.

    df has query, first and second; the model sees texts only.
    """
    if at_once < 1 or tries < 1:
        raise ValueError("at least one call and one try are needed")
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("place", StringType()), StructField("error", StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = load()

        def ask(texts: tuple[str, str, str]) -> tuple[str | None, str | None]:
            q, a, b = texts
            for k in range(tries):
                try:
                    reply, stop = client(f"{PROMPT}\n\nQuery: {q}\n\nResponse 1: {a}\n\nResponse 2: {b}")
                    if stop != "end_turn":
                        raise JudgeError(f"stopped by {stop}")
                    return parse_verdict(reply), None
                except Exception as e:  # whatever a client raises is that row's fault alone
                    error = f"{type(e).__name__}: {e}"[:1000]
                    if k + 1 < tries:
                        time.sleep(pause * 2**k)
            return None, error

        with ThreadPoolExecutor(at_once) as pool:
            for p in parts:
                told = list(pool.map(ask, zip(p["query"], p["first"], p["second"])))
                yield p.assign(place=[t[0] for t in told], error=[t[1] for t in told])

    return df.mapInPandas(run, schema)


def judged_once(pairs: DataFrame, verdicts: DataFrame, judge_id: str) -> DataFrame:
    """The pairs that no logged verdict of the judge is about: a run that was killed pays for no call twice.

    verdicts: request_index, judge_id of those logged so far, without the rows that failed.
    """
    known = verdicts.filter(F.col("judge_id") == judge_id).select("request_index").distinct()
    return pairs.join(known, "request_index", "left_anti")


def judge_into_log(pairs: DataFrame, store: log.EventLog, run_id: str, judge_id: str, seed: int, load: Callable[[], Client], batches: int = 16, **calls: int) -> DataFrame:
    """Judges pairs (request_index, topic, query_text, a_text, b_text) by a text model into a run's log.

    What the log has is left out before any call. Pairs are dealt by request into ``batches`` that
    are judged and appended one after the other, so a job that dies has lost one of them at most;
    the next run goes on with what is not logged. Returns request_index and error of the rows that failed.
    """
    known = log.typed(store.read_all().filter(F.col("run_id") == run_id), "verdict_recorded")
    rest = written(judged_once(pairs, known, judge_id))
    failed = []
    for k in range(batches):
        part = rest.filter(F.pmod(F.xxhash64("request_index"), F.lit(batches)) == k)
        shown = part.withColumn("first_shown", F.when(swapped(seed, judge_id), "b").otherwise("a"))
        b_first = F.col("first_shown") == "b"
        shown = shown.select("request_index", "topic", "first_shown", F.col("query_text").alias("query"), F.when(b_first, F.col("b_text")).otherwise(F.col("a_text")).alias("first"), F.when(b_first, F.col("a_text")).otherwise(F.col("b_text")).alias("second"))
        told = written(llm_verdicts(shown, load, **calls).drop("query", "first", "second"))  # asked once, read twice
        b_won = (F.col("place") == "first") == (F.col("first_shown") == "b")
        winner = F.when(F.col("place") == "tie", "tie").when(b_won, "b").otherwise("a")
        good = told.filter("place IS NOT NULL").withColumns({"winner": winner, "judge_id": F.lit(judge_id)})
        store.append(log.to_events(good, run_id, "verdict_recorded", ["request_index", "topic", "winner", "first_shown", "judge_id"]))
        failed.append(told.filter("place IS NULL").select("request_index", "error"))
    return reduce(DataFrame.unionByName, failed)


def consensus(votes: DataFrame) -> DataFrame:
    """question_id, model_0, model_1, votes_a, votes_b, ties, label of pairs with a strict majority.

    votes: question_id, model_a, model_b, winner (model_a, model_b, tie...). Either
    order of the models is the same pair. Where votes have
    text_a and text_b, those of the first vote (by ``ord`` if there is one) go along as text_0
    and text_1.
    """
    flip = F.col("model_a") > F.col("model_b")
    won_first = F.col("winner") == F.when(flip, "model_b").otherwise("model_a")
    tie = F.col("winner").startswith("tie")
    texts = {"text_a", "text_b"} <= set(votes.columns)
    own = [F.when(flip, F.col("text_b")).otherwise(F.col("text_a")).alias("t0"), F.when(flip, F.col("text_a")).otherwise(F.col("text_b")).alias("t1")] if texts else []
    order = [F.col("ord")] if "ord" in votes.columns else [F.lit(0).alias("ord")]
    df = votes.select("question_id", F.least("model_a", "model_b").alias("model_0"), F.greatest("model_a", "model_b").alias("model_1"), tie.alias("tie"), (won_first & ~tie).alias("first"), *own, *order)
    first = [F.min(F.struct("ord", "t0", "t1")).alias("_t")] if texts else []
    out = df.groupBy("question_id", "model_0", "model_1").agg(
        F.count_if("first").alias("votes_a"), F.count_if(~F.col("first") & ~F.col("tie")).alias("votes_b"), F.count_if("tie").alias("ties"), *first
    )
    if texts:
        out = out.withColumns({"text_0": F.col("_t.t0"), "text_1": F.col("_t.t1")}).drop("_t")
    return out.filter("votes_a <> votes_b").withColumn("label", F.when(F.col("votes_a") > F.col("votes_b"), "a").otherwise("b"))


def vote_rows(table: DataFrame, turn: int = 1) -> DataFrame:
    """question_id, model_a, model_b, winner, question, text_a, text_b of pairwise votes whose
    conversations are arrays of (role, content): the first question and both answers."""
    said = lambda c, i: F.get(F.col(c), i)["content"]
    return table.filter(F.col("turn") == turn).select(
        "question_id", "model_a", "model_b", "winner", said("conversation_a", 0).alias("question"), said("conversation_a", 1).alias("text_a"), said("conversation_b", 1).alias("text_b")
    )


def human_agreement(anchors: DataFrame) -> DataFrame:
    """pairs, agreement of pairs with at least two decisive votes, and how many are unanimous."""
    n = F.col("votes_a") + F.col("votes_b")
    most = F.greatest("votes_a", "votes_b")
    return anchors.filter(n >= 2).agg(F.count(F.lit(1)).alias("pairs"), F.avg(most / n).alias("agreement"), F.count_if(most == n).alias("unanimous"))


def first_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, question, answer: the first two turns."""
    q = conversations.filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    a = conversations.filter("turn = 1").select("conv_id", F.col("text").alias("answer"))
    return q.join(a, "conv_id")
