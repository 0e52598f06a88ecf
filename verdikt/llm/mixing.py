"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

Weights 5, 2, 1 go round the sources in code point order, null last. Targets share
all words by weight; none exceeds ``max_repeats`` times its source, and what is cut
is shared again (water filling, in closed form over the sources sorted by cap per
weight). Targets are then given out as blocks of ``block_words`` words: blocks go to
sources by highest quotient target / (2 k - 1), and the blocks of a source to its
shards likewise by shard size, so every shard has an integer quota. A shard lays its
documents out in a seeded order, cuts it into blocks, takes the whole shard as often
as the quota covers it and for the rest the quota's blocks from a seeded first block
on, going round. A document takes the words of its own in the blocks taken.

A source is dealt over shards of about ``shard_rows`` documents by a seeded hash, so
a hot source is many small tasks. What is one task has a row per source or shard.

Defined cases: null text has size 0 and takes 0; null source is a source; rows of
equal doc_id and text are alike and tie in the order, each a row of its own; an
empty table gives an empty result; if all texts are empty all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, free_name, text_of, written

WEIGHTS = (5, 2, 1)


def apportion(parties: DataFrame, group: list[str], order: str, weight: str, total: str, out: str) -> DataFrame:
    """Sainte-Laguë: parties plus ``out``, their seats of the ``total`` of their group.

    The seats differ from the proportional share by no more than the number of
    parties moves the divisor; only the seats within that reach are ranked, about
    three a party, not one row a seat.
    """
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    w = F.col(weight).cast("double")
    df = parties.withColumn("_s", F.count(F.lit(1)).over(by)).withColumn("_w", F.sum(w).over(by))
    share = F.when(F.col("_w") > 0, w * F.col(total) / F.col("_w")).otherwise(0.0)
    slack = F.ceil(F.when(F.col(total) > 0, share * F.col("_s") / (2.0 * F.col(total))).otherwise(0.0)) + 2
    df = df.withColumn("_lo", F.greatest(F.lit(0).cast("long"), F.floor(share) - slack)).withColumn("_hi", F.floor(share) + 1 + slack)
    df = df.withColumn("_need", F.col(total) - F.sum("_lo").over(by))
    seats = df.filter(w > 0).withColumn("_k", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
    rank = F.row_number().over(by.orderBy((w / (2 * F.col("_k") - 1)).desc(), F.col(order), F.col("_k")))
    won = seats.withColumn("_r", rank).filter(F.col("_r") <= F.col("_need")).groupBy(*group, order).agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(won, [*group, order], "left")
    seats_won = F.when(w > 0, F.col("_lo") + F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return df.withColumn(out, seats_won).drop("_s", "_w", "_lo", "_hi", "_need", "_n")


def source_targets(sources: DataFrame, max_repeats: int) -> DataFrame:
    """sources (source, source_size, source_rows) with sid, weight and target."""
    all_rows = W.partitionBy(F.lit(0))
    df = sources.withColumn("sid", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1)
    df = df.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    before = all_rows.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("level", left / w_left)
    open_ = F.col("cap") / F.col("weight") > F.col("level")
    df = df.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("cap") / F.col("weight"))).over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return df.select("source", "source_size", "source_rows", "sid", target.alias("target"))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


def mix(docs: DataFrame, block_words: int = 64, shard_rows: int = 8192, max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, th (hash of the text), source, size, source_size, target, taken of every row."""
    sizes = written(
        docs.select(
            docs["doc_id"], docs["source"], F.xxhash64(text_of(docs)).alias("th"), F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size")
        )
    )
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), max_repeats)
    total = F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block_words).cast("long")
    sources = written(apportion(sources.withColumn("blocks", total), [], "sid", "target", "blocks", "quota"))
    placed = sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    shards = F.ceil(F.col("source_rows") / shard_rows)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), shards))
    by_shard = placed.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    quotas = apportion(by_shard, ["sid"], "shard", "shard_size", "quota", "shard_quota").select("sid", "shard", "shard_size", "shard_quota")
    placed = placed.join(quotas, ["sid", "shard"])
    layout = W.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "th"), "doc_id", "th").rowsBetween(W.unboundedPreceding, 0)
    n = F.col("shard_size")
    take = F.least(F.col("shard_quota") * block_words, n * max_repeats)
    placed = placed.withColumn("b", F.sum("size").over(layout)).withColumn("a", F.col("b") - F.col("size"))
    placed = placed.withColumn("epochs", F.when(n > 0, F.floor(take / n)).otherwise(0)).withColumn("rest", take - F.col("epochs") * n)
    blocks = F.greatest(F.lit(1), F.ceil(n / block_words))
    placed = placed.withColumn("at", F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), blocks) * block_words)
    end = F.col("at") + F.col("rest")
    part = _overlap(F.col("a"), F.col("b"), F.col("at"), F.least(end, n)) + _overlap(F.col("a"), F.col("b"), F.lit(0).cast("long"), end - n)
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return placed.select("doc_id", "th", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **parameters: int) -> DataFrame:
    """The mix itself: each row of docs as often as the words it takes are its size; a
    fraction becomes one more copy with that probability, by a seeded hash."""
    plan = mix(docs, seed=seed, **parameters)
    ratio = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    u = F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id", "th"), F.lit(1 << 30)) / float(1 << 30)
    d, t, c, i = (free_name(docs, n) for n in ("_d", "_t", "_c", "_i"))
    copies = plan.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.floor(ratio + u).cast("int").alias(c)).filter(F.col(c) > 0)
    # equal rows may fall on either side of a cut; each takes the most that one of them has
    copies = copies.groupBy(d, t).agg(F.max(c).alias(c))
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(copies[d]) & (F.xxhash64(text_of(docs)) == copies[t]))
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[docs[x] for x in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
