"""The live pipeline gives what the batch gives, through repeated deliveries and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from verdikt.operators import folds, seqtest
from verdikt.sources import log
from verdikt.plans import lifecycle
from verdikt.plans.queries import TOPICS, requests
from verdikt.streaming import pipeline

SF = "/root/testdata/sf0.001"

CANARY = folds.Canary(h=4.0, margin=0.1, alpha=0.2)
SCHEMA = "run_id string, seq long, ts timestamp, request_index long, win int"


def feed(spark, folder, parts):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [("r", i * 10 + 5, start + timedelta(minutes=i), i, int(rng.random() < 0.4)) for i in range(300)]
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts] + rows[max(0, k * len(rows) // parts - 4) : k * len(rows) // parts]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    end = [("end", -1, start + timedelta(days=300), -1, 0)]  # moves the watermark past all rows
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed(spark, tmp_path / "in", 3)
    want = folds.canary_transitions(rows.withColumn("k", F.lit("r")), "k", CANARY).select("request_index", "kind")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    moved = pipeline.canary_stream(pipeline.deduplicated(source, "1 minute"), CANARY)
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        q = moved.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("run_id = 'r'").select("request_index", "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_log_sink_is_idempotent(spark, tmp_path):
    events = [("r", i // 2, "request_received", "{}", datetime(2024, 1, 1)) for i in range(20)]
    schema = "run_id string, seq long, type string, payload string, ts timestamp"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        pipeline.to_log(stream, str(tmp_path / "log"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert log.EventLog(spark, str(tmp_path / "log")).read("r").count() == 10


def test_killed_in_the_middle_and_started_again(spark, tmp_path):
    """A query stopped after some batches goes on from its checkpoint and gives what one run gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed(spark, tmp_path / "in", 4)
    rule = folds.Decision(h=2.5)
    want = folds.decisions(rows.withColumn("k", F.lit("r")), "k", rule).select("request_index", "kind")
    seen = []

    def start(fail_at):
        def sink(batch, k):
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out-{k}"))  # a batch that comes again replaces itself
            seen.append(k)
            if k == fail_at:
                raise RuntimeError("killed after its effects, before its commit")

        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = pipeline.decision_stream(pipeline.deduplicated(source, "1 minute"), rule)
        return out.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        start(2).awaitTermination()
    assert seen and max(seen) == 2
    start(None).awaitTermination()
    assert seen.count(2) == 2  # the batch whose commit was lost ran again
    got = spark.read.parquet(*[str(p) for p in tmp_path.glob("out-*")]).filter("run_id = 'r'").select("request_index", "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_drift_stream_equals_window_form(spark):
    got = {(r["run_id"], r["request_index"]) for r in lifecycle.drift_stream(spark, SF).collect()}
    path = seqtest.psi_path(requests(spark, SF), ["arm"], "request_index", "topic", TOPICS, 50, 10).filter("psi >= 0.2")
    want = {(str(r["arm"]), r["at"]) for r in path.groupBy("arm").agg(F.min("request_index").alias("at")).collect()}
    assert got == want and got
