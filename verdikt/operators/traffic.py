"""Requests, shadow sampling, response mixtures and schedules from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import below, normal, uniform
from . import seqtest


def requests(events: DataFrame) -> DataFrame:
    """request_index, topic, arm, value of an event table."""
    return events.select(F.col("event_id").alias("request_index"), F.col("event_type").alias("topic"), F.pmod("user_id", F.lit(4)).alias("arm"), "value")


def sampled(df: DataFrame, seed: int, stream: str, rate: float | Column) -> DataFrame:
    """Rows whose keyed uniform lies below the rate."""
    return df.filter(uniform(seed, "request_index", stream) < rate if isinstance(rate, Column) else below(seed, "request_index", stream, rate))


def step_schedule(changepoint: int | None, epsilon: float, topic: str | None = None) -> Column:
    """0 before the changepoint, epsilon from it on; on one topic only if given. None: never."""
    if changepoint is None:
        return F.lit(0.0)
    on = F.col("request_index") >= changepoint
    if topic is not None:
        on = on & (F.col("topic") == topic)
    return F.when(on, F.lit(float(epsilon))).otherwise(0.0)


def mixture(df: DataFrame, seed: int, config: str, epsilon: Column) -> DataFrame:
    """Adds epsilon_active and source_pool: 'bad' with probability epsilon."""
    df = df.withColumn("epsilon_active", epsilon)
    return df.withColumn("source_pool", F.when(uniform(seed, "request_index", f"{config}#mixture") < F.col("epsilon_active"), "bad").otherwise("good"))


def pick_topic(seed: int, before: dict[str, float], after: dict[str, float] | None = None, shift_at: int | None = None) -> Column:
    """A weighted draw by cumulated weights, topics in order; the weights may change at an index."""

    def draw(weights: dict[str, float]) -> Column:
        u, total, below = uniform(seed, "request_index", "__traffic__:topic"), sum(weights.values()), 0.0
        names = sorted(weights)
        out = F.lit(None).cast("string")
        steps = []
        for t in names[:-1]:
            below += weights[t] / total
            steps.append((below, t))
        out = F.lit(names[-1])
        for b, t in reversed(steps):
            out = F.when(u < b, t).otherwise(out)
        return out

    if after is None or shift_at is None:
        return draw(before)
    return F.when(F.col("request_index") >= shift_at, draw(after)).otherwise(draw(before))


def pick_query(df: DataFrame, seed: int, picked: Column, queries: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Adds topic and query_id: of the topic picked, one query uniformly. queries: id, topic."""
    rank = F.row_number().over(W.partitionBy("topic").orderBy("id")) - 1
    ranked = queries.select("topic", F.col("id").alias("query_id"), rank.alias("_at"))
    sizes = queries.groupBy("topic").agg(F.count(F.lit(1)).alias("_of"))
    if sizes.limit(max_broadcast + 1).count() <= max_broadcast:
        sizes = F.broadcast(sizes)
    df = df.drop("topic").withColumn("topic", picked).join(sizes, "topic")
    df = df.withColumn("_at", F.floor(uniform(seed, "request_index", "__traffic__:query") * F.col("_of")).cast("int"))
    return df.join(ranked, ["topic", "_at"]).drop("_at", "_of")


def pick_response(responses: Column, seed: int, stream: str) -> Column:
    """One of an array, uniformly."""
    return F.element_at(responses, (F.floor(uniform(seed, "request_index", stream) * F.size(responses)) + 1).cast("int"))


def lognormal_latency(seed: int, stream: str, median: float, sigma: float) -> Column:
    return F.round(F.lit(median) * F.exp(sigma * normal(seed, "request_index", stream)), 3)


def poisson_gap(seed: int, stream: str, rate: float) -> Column:
    return -F.log(1.0 - uniform(seed, "request_index", stream)) / rate


def synthetic_queries(spark: SparkSession, n: int, topics: list[str]) -> DataFrame:
    """id, text, topic: topics go round."""
    i = F.col("id")
    topic = F.element_at(F.array(*map(F.lit, topics)), (F.pmod(i, F.lit(len(topics))) + 1).cast("int"))
    return spark.range(n).select(F.format_string("q%05d", i).alias("id"), F.concat(F.lit("Question "), i.cast("string"), F.lit(" about "), topic).alias("text"), topic.alias("topic"))


def synthetic_pool(queries: DataFrame, variants: int = 4) -> DataFrame:
    """query_id, quality, responses: ``variants`` good and as many bad ones a query."""
    quality = F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("quality")
    df = queries.select(F.col("id").alias("query_id"), "topic", quality)
    made = F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda k: F.concat_ws(" ", F.col("quality"), F.lit("answer"), k.cast("string"), F.lit("to"), F.col("query_id")))
    return df.select("query_id", "quality", made.alias("responses"))


def pool_join(df: DataFrame, pool: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Joins (query_id, source_pool) with a pool; a missing pair is an error, not a lost row."""
    pool = pool.withColumnRenamed("quality", "source_pool")
    if pool.limit(max_broadcast + 1).count() <= max_broadcast:
        pool = F.broadcast(pool)
    df = df.join(pool, ["query_id", "source_pool"], "left")
    missing = F.raise_error(F.concat(F.lit("no responses for "), F.col("query_id")))
    return df.withColumn("responses", F.when(F.col("responses").isNull(), missing.cast("array<string>")).otherwise(F.col("responses")))


def as_of(left: DataFrame, right: DataFrame, key: list[str], order: str, value: str, default: object = None) -> DataFrame:
    """left plus the last ``value`` of right at or before its order value (an integer), per key.

    A union and a running last within blocks of order values; a row a block carries the last value
    over to the blocks behind. No range join, and a key is no single task.
    """
    cols = left.columns
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    other = right.select(*key, order, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = both.unionByName(other, allowMissingColumns=True).withColumn("_block", F.floor(F.col(order) / seqtest.SPAN))
    ends = both.groupBy(*key, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    before = W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    within = W.partitionBy(*key, "_block").orderBy(order, "_side").rowsBetween(W.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).filter("_side = 1")
    seen = F.coalesce("_own", "_carried", *([F.lit(default)] if default is not None else []))
    return own.join(ends, [*key, "_block"], "left").withColumn(value, seen).select(*cols, value)


def expected_pairs(spark: SparkSession, n: int, seed: int, rate: float) -> int:
    return spark.range(n).withColumnRenamed("id", "request_index").filter(below(seed, "request_index", "__router__", rate)).count()
