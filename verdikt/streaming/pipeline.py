"""The live pipeline: deliveries are at least once, effects exactly once.

Source -> deduplication by (run_id, seq) within a watermark -> services with state, in order
of request_index -> the log.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.draws import below, uniform
from ..operators.folds import Canary, Decision, Drift
from ..operators.judging import NoisyOracle, compare_randomised
from ..sources.log import EventLog, is_missing
from .services import Folded, canary_moves, drift_alarms, ordered_rows, told_by

def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(run_id, seq, ts, ...) once each, within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


def canary_stream(verdicts: DataFrame, canary: Canary) -> DataFrame:
    """Transitions of a stream of run_id, ts, request_index, win that has a watermark on ts."""
    return canary_moves(verdicts, canary)


def decision_stream(verdicts: DataFrame, rule: Decision) -> DataFrame:
    """First alarm and first promotion of each run; a row whose win is -1 is a drift alarm's reset.
    Where the alarms come from a stream themselves, ``services.decided`` takes them from it."""

    def step(st: dict, index: int, win: str) -> list[tuple[str, str]]:
        if int(win) < 0:
            rule.reset(st)
            return [("test_reset", "")]
        return [(kind, "") for kind in rule.step(st, int(win), index)]

    # of one index a reset, which is -1, comes before the verdict
    return told_by(ordered_rows(verdicts, F.col("win").cast("int").cast("string")), Folded(rule.start, step))


def drift_stream(requests: DataFrame, monitor: Drift) -> DataFrame:
    """The drift alarm of each run of run_id, ts, request_index, topic."""
    return drift_alarms(requests, monitor)


def routed(requests: DataFrame, shares: DataFrame, seed: int, shadow_rate: float, epsilon: Column) -> DataFrame:
    """Requests with who serves them and what the challenger answers from; batch or stream.

    shares (lo, hi, share) are what the control stream said, as ranges of request_index,
    known when the query starts: a rollout has a handful, so they are broadcast. A stateless
    map, so routers scale with the source. The champion always answers; nobody waits for the
    challenger, who answers sampled requests and those it serves.
    """
    told = F.broadcast(shares)
    inside = (F.col("request_index") >= F.col("lo")) & (F.col("request_index") < F.col("hi"))
    df = requests.join(told, inside, "left").drop("lo", "hi").withColumn("share", F.coalesce("share", F.lit(0.0)))
    serves = uniform(seed, "request_index", "__canary__") < F.col("share")
    sampled = below(seed, "request_index", "__router__", shadow_rate)
    df = df.withColumns({"served_by": F.when(serves, "challenger").otherwise("champion"), "shadowed": sampled | serves, "epsilon_active": epsilon})
    bad = uniform(seed, "request_index", "challenger#mixture") < F.col("epsilon_active")
    return df.withColumns({"a_pool": F.lit("good"), "b_pool": F.when(bad, "bad").otherwise("good")})


def share_ranges(transitions: DataFrame) -> DataFrame:
    """(lo, hi, share) from transitions (request_index, share): each holds until the next."""
    w = W.partitionBy(F.lit(0)).orderBy("request_index")  # a row a transition
    return transitions.select(F.col("request_index").alias("lo"), F.coalesce(F.lead("request_index").over(w), F.lit(1 << 62)).alias("hi"), "share")


def judged(pairs: DataFrame, seed: int, judge_id: str, judge: NoisyOracle, sampling: float = 1.0) -> DataFrame:
    """Verdicts of a stream of pairs, with its other columns: a stateless map, whose tasks are the judge workers."""
    kept = pairs.filter(below(seed, "request_index", f"__judge_sample__{judge_id}", sampling))
    return compare_randomised(kept, seed, judge_id, judge).withColumn("judge_id", F.lit(judge_id))


class Bus:
    """Named streams that groups of consumers read independently, each row once a group.

    A stream is a folder of Parquet files. A group is a checkpoint: its query's tasks share
    the rows, what was handled is committed, and what a consumer that died had taken is given
    out again when the group's query starts anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, stream: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{stream}")

    def _checkpoint(self, stream: str, group: str) -> str:
        return f"{self.root}/_groups/{stream}/{group}"

    def consume(self, stream: str, group: str, handle: Callable[[DataFrame, int], None], files: int = 1000) -> StreamingQuery:
        """Starts the group's query over all there is; a batch may be handled again after a failure."""
        path = f"{self.root}/{stream}"
        rows = self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
        return rows.writeStream.foreachBatch(handle).option("checkpointLocation", self._checkpoint(stream, group)).trigger(availableNow=True).start()

    def pending(self, stream: str, group: str) -> int:
        """Rows that the group has not committed."""
        rows = self.spark.read.parquet(f"{self.root}/{stream}")
        tidy = lambda c: F.regexp_replace(c, "^file:/+", "/")
        at = self._checkpoint(stream, group)
        try:
            done = self.spark.read.text(f"{at}/commits").select(F.regexp_extract("_metadata.file_name", "^([0-9]+)", 1).cast("long").alias("b"))
            last = done.agg(F.max("b")).first()[0]
            taken = self.spark.read.text(f"{at}/sources/0").select(F.from_json("value", "path string, batchId long").alias("f"))
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return rows.count()
        taken = taken.filter(F.col("f.batchId") <= F.lit(last)).select(tidy(F.col("f.path")).alias("path")).distinct()
        return rows.select(tidy(F.col("_metadata.file_path")).alias("path")).join(taken, "path", "left_anti").count()

    def cleanup(self, prefix: str) -> None:
        """Deletes the streams whose name begins with the prefix, and their groups."""
        context = self.spark.sparkContext
        for root in (self.root, f"{self.root}/_groups"):
            top = context._jvm.org.apache.hadoop.fs.Path(root)
            fs = top.getFileSystem(context._jsc.hadoopConfiguration())
            for status in fs.listStatus(top) if fs.exists(top) else []:
                if status.getPath().getName().startswith(prefix):
                    fs.delete(status.getPath(), True)


def to_log(stream: DataFrame, log_path: str, checkpoint: str, available_now: bool = True, every: str = "250 milliseconds") -> StreamingQuery:
    """Writes events to the log: exactly once, however many queries write to it. A batch that is
    delivered again finds itself published, or replaces what it had written; nothing is read.
    A live query flushes at intervals; what one holds is bounded at the source (maxFilesPerTrigger
    and the like)."""
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:32]  # the query's name from start to start

    def write(batch: DataFrame, k: int) -> None:
        EventLog(batch.sparkSession, log_path).append(batch.select("run_id", "seq", "type", "payload", F.col("ts").cast("double").alias("ts")), writer, k)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()
