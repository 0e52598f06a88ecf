"""Multisets compared in parts whose number grows with the rows."""

from verdikt import cluster
from verdikt.operators import metrics
from verdikt.sources import log


def test_parts_grow_with_the_rows(spark):
    sizes = [r["count"] for r in cluster.spread(spark.range(4000), "id", rows=100).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 40 and max(sizes) < 200


def test_multisets_by_position_with_nulls_and_repeats(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (2, None)]
    a = spark.createDataFrame(rows, "i long, w string")
    b = spark.createDataFrame(rows[::-1], "k long, x string")
    assert metrics.same_multiset(a, b) and metrics.same_multiset(a.limit(0), b.limit(0))
    assert not metrics.same_multiset(a, b.distinct()) and not metrics.same_multiset(a.distinct(), b) and not metrics.same_multiset(a, a.union(a))
    assert not metrics.same_multiset(a, spark.createDataFrame([*rows[:3], (2, "")], "i long, w string"))


def test_no_task_holds_a_growing_share_of_delivered_events(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(log, "spread", lambda df, *keys: asked.append(keys) or cluster.spread(df, *keys, rows=50))
    events = spark.range(300).selectExpr("'r' AS run_id", "id AS seq", "'t' AS type", "'{}' AS payload", "0D AS ts")
    left = log.fresh(events.union(events), events.filter("seq < 100"))
    assert left.count() == 200 and asked == [("run_id", "seq")]
