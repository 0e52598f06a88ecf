"""The event log and JSON-lines sources and sinks.

An event is (run_id, seq, type, payload JSON, ts); (run_id, seq) is its key. Sequence
numbers derive from the request index, ten a request, so that a repeated delivery has the
same key and appending is idempotent.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..cluster import spread, written
from .folder import Folder

EVENT = "run_id string, seq long, type string, payload string, ts double"
EVENT_COLUMNS = [tuple(c.split(" ")) for c in EVENT.split(", ")]
KEY = ["run_id", "seq"]
STORED = f"{EVENT}, arrival long, place long"
STORED_COLUMNS = [c.split(" ")[0] for c in STORED.split(", ")]
ARRIVAL = "writer string, batch long, rows long"
#: Places of event types within a request's ten; each type has its own.
BANDS = {
    "request_received": 0, "champion_response": 1, "shadow_response": 2, "promotion": 4, "verdict_recorded": 5,
    "quality_alarm": 6, "drift_alarm": 7, "test_reset": 8, "canary_transition": 9,
}
DATA_EVENTS = ["request_received", "champion_response", "shadow_response"]
PAYLOAD = {
    "request_received": "request_index long, query_id string, query_text string, topic string, served_by string",
    "champion_response": "request_index long, query_id string, config_id string, source_pool string, latency_ms double, text string",
    "shadow_response": "request_index long, query_id string, config_id string, source_pool string, latency_ms double, text string, epsilon_active double",
    "verdict_recorded": "request_index long, config_a string, config_b string, winner string, first_shown string, judge_id string, topic string, worker string",
    "drift_alarm": "request_index long, kind string, psi double, threshold double",
    "quality_alarm": "request_index long, kind string",
    "promotion": "request_index long, kind string",
    "test_reset": "request_index long, cause string",
    "canary_transition": "request_index long, kind string, stage string, share double, verdicts_in_stage long",
    "share_update": "kind string, share double",
    "run_started": "scenario string, topics array<string>",
    "run_finished": "n_requests long, counts map<string, long>, wall_seconds double",
}


def seq(type_: str, request_index: Column | str = "request_index") -> Column:
    return (F.col(request_index) if isinstance(request_index, str) else request_index) * 10 + BANDS[type_]


def to_events(df: DataFrame, run_id: str, type_: str, columns: list[str]) -> DataFrame:
    """Events of one type from typed rows with a request_index."""
    return df.select(F.lit(run_id).alias("run_id"), seq(type_).alias("seq"), F.lit(type_).alias("type"), F.to_json(F.struct(*sorted(columns))).alias("payload"), F.lit(0.0).alias("ts"))


def typed(events: DataFrame, type_: str) -> DataFrame:
    """run_id, seq and the payload's columns of one event type."""
    rows = events.filter(F.col("type") == type_)
    return rows.select("run_id", "seq", F.from_json("payload", PAYLOAD[type_]).alias("p")).select("run_id", "seq", "p.*")


def is_missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "").startswith("PATH_NOT_FOUND")


class EventLog:
    """Events as Parquet that any number of writers append to, each key once, in order of arrival.

    A batch owns a folder, named by its writer and its number, that a retry replaces whole. Once
    it is written it is published: it takes the next arrival number, by a small file that only one
    writer can make. Appending so reads nothing of what was stored before. Of equal keys the copy
    with the least (arrival, place in the batch) is the event; readers leave the others out.
    ``fold`` merges what has been published into a base, in which keys are unique and runs are
    partitions, so that readers compare the batches since then only.

        data/writer=W/batch=B/       events and their places, published or not yet
        arrivals/N                   writer, batch and rows of the N-th arrival
        data/base=N/run_id=R/        the first copies of all keys up to the N-th arrival
        bases/N                      published bases
    """

    def __init__(self, spark: SparkSession, path: str, fold_after: int = 64):
        self.spark, self.path, self.fold_after = spark, path.rstrip("/"), fold_after
        self.files = Folder(spark, self.path)

    def append(self, events: DataFrame, writer: str | None = None, batch: int = 0) -> None:
        """Adds the events whose (run_id, seq) the log has not yet; of equal keys one is kept.

        A writer that names itself and numbers its batches may deliver a batch again: if it was
        published nothing happens, else its folder is replaced.
        """
        writer = uuid.uuid4().hex if writer is None else writer
        at = f"data/writer={writer}/batch={batch}"
        if self.files.exists(f"{at}/_published"):
            return
        seen = Observation()
        rows = events.select(*[F.col(c).cast(t).alias(c) for c, t in EVENT_COLUMNS]).withColumn("place", F.monotonically_increasing_id())
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/{at}")
        if n := seen.get["rows"]:
            arrival = self._last("arrivals") + 1
            entry = json.dumps({"writer": writer, "batch": batch, "rows": n})
            while not self.files.put_new(f"arrivals/{arrival:019d}", entry):
                arrival += 1
            if self.fold_after and (arrival + 1) % self.fold_after == 0:
                self.fold()
        self.files.mark(f"{at}/_published")

    def _last(self, name: str) -> int:
        return int((self.files.names(name) or [-1])[-1])

    def batches(self) -> DataFrame:
        """(arrival, writer, batch, rows) of what was published, a row a batch.

        A batch whose writer died between publishing it and noting that stands there twice; its
        first arrival holds.
        """
        if not self.files.exists("arrivals"):
            return self.spark.createDataFrame([], f"arrival long, {ARRIVAL}")
        rows = self.spark.read.schema(ARRIVAL).json(f"{self.path}/arrivals")
        found = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).cast("long").alias("arrival"), "*")
        return found.groupBy("writer", "batch").agg(F.min("arrival").alias("arrival"), F.max("rows").alias("rows")).select("arrival", "writer", "batch", "rows")

    def _since(self, batches: list[Row]) -> DataFrame:
        """Events of published batches, all copies."""
        if not batches:
            return self.spark.createDataFrame([], STORED)
        known = self.spark.createDataFrame([tuple(b)[:3] for b in batches], "arrival long, writer string, batch long")
        paths = [f"{self.path}/data/writer={b['writer']}/batch={b['batch']}" for b in batches]
        rows = self.spark.read.schema(f"{EVENT}, place long, writer string, batch long").option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.join(F.broadcast(known), ["writer", "batch"]).select(*STORED_COLUMNS)  # a row a batch since the base

    def _firsts(self, batches: list[Row]) -> DataFrame:
        rest = F.struct(*[c for c in STORED_COLUMNS if c not in KEY])
        found = self._since(batches).groupBy(*KEY).agg(F.min_by(rest, F.struct("arrival", "place")).alias("e"))
        return found.select(*KEY, "e.*").select(*STORED_COLUMNS)

    def _stored(self, base: int) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/data/base={base}") if base >= 0 else self.spark.createDataFrame([], STORED)

    def arrived(self, upto: int | None = None) -> DataFrame:
        """All events, each once, with its arrival and place; of the first ``upto`` + 1 arrivals if given."""
        base = self._last("bases")
        batches = self.batches().filter(F.col("arrival") > base).collect()  # bounded by fold_after
        old = self._stored(base)
        if upto is not None:
            batches, old = [b for b in batches if b["arrival"] <= upto], old.filter(F.col("arrival") <= upto)
        if not batches:
            return old
        if base < 0:
            return self._firsts(batches)
        return old.unionByName(self._firsts(batches).join(old.select(*KEY), KEY, "left_anti").select(*STORED_COLUMNS))

    def fold(self) -> None:
        """Merges all that has been published into a new base. Of several at once one counts."""
        last = self._last("arrivals")
        if last <= self._last("bases"):
            return
        at, mine = f"data/base={last}", f"folding/{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a run goes to as many files as it has stretches of a million seqs, each sorted
        rows = self.arrived(last).repartition(n, "run_id", F.floor(F.col("seq") / 1_000_000)).sortWithinPartitions("run_id", "seq")
        rows.write.partitionBy("run_id").parquet(f"{self.path}/{mine}")
        if self.files.move_new(mine, at):
            self.files.put_new(f"bases/{last:019d}", "")

    def vacuum(self) -> None:
        """Deletes what the newest base has replaced; nobody may still be reading it."""
        base = self._last("bases")
        for b in self.batches().filter(F.col("arrival") <= base).collect():
            at = f"data/writer={b['writer']}/batch={b['batch']}"
            for name in self.files.names(at):  # the note that it was published stays
                self.files.delete(f"{at}/{name}")
        for name in self.files.names("bases")[:-1]:
            self.files.delete(f"data/base={int(name)}")
            self.files.delete(f"bases/{name}")

    def read_all(self) -> DataFrame:
        """All events; none where nothing was written yet."""
        return self.arrived().select(*[c for c, _ in EVENT_COLUMNS])

    def read(self, run_id: str) -> DataFrame:
        return self.read_all().filter(F.col("run_id") == run_id).orderBy("seq")

    def run_ids(self) -> DataFrame:
        return self.read_all().select("run_id").distinct().orderBy("run_id")

    def max_seqs(self) -> DataFrame:
        return self.read_all().groupBy("run_id").agg(F.max("seq").alias("max_seq"))

    def max_seq(self, run_id: str) -> int:
        return self.read_all().filter(F.col("run_id") == run_id).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]

    def tail(self, after: tuple[int, int] = (-1, -1), limit: int = 500) -> DataFrame:
        """The next events behind the last one seen, (arrival, place), in order of arrival, with those two columns.

        The table of batches tells which of them can hold the page, and only these are read; of
        the earlier ones only keys, of the page's stretch of seqs.
        """
        base, batches = self._last("bases"), sorted(self.batches().collect())
        ahead = [b for b in batches if b["arrival"] >= after[0]]
        page, found, take = self.spark.createDataFrame([], STORED), 0, limit
        while ahead and found < limit:
            # as many batches as hold the page, if they repeat nothing that was there before
            some, n = [], 0
            while ahead and n < take:
                some.append(ahead.pop(0))
                n += some[-1]["rows"] * (some[-1]["arrival"] > after[0])
            rows = self._first_in(some, base, batches).filter((F.col("arrival") > after[0]) | (F.col("arrival") == after[0]) & (F.col("place") > after[1]))
            page = _first_arrived(page.unionByName(rows), limit)
            found, take = page.count(), 2 * take
        return page.orderBy("arrival", "place")

    def _first_in(self, some: list[Row], base: int, batches: list[Row]) -> DataFrame:
        """Events whose first copy is in ``some`` batches."""
        old = self._stored(base).filter(F.col("arrival").between(some[0]["arrival"], some[-1]["arrival"]))
        new = [b for b in some if b["arrival"] > base]
        if not new:
            return old
        firsts = self._firsts(new)
        ends = firsts.agg(F.min("seq"), F.max("seq")).first()
        between = [b for b in batches if base < b["arrival"] < new[0]["arrival"]]
        earlier = self._stored(base).select(*KEY).unionByName(self._since(between).select(*KEY)).filter(F.col("seq").between(ends[0], ends[1]))
        return old.unionByName(firsts.join(earlier, KEY, "left_anti").select(*STORED_COLUMNS))

    def arrivals(self) -> DataFrame:
        """The log as a stream: every event at least once, in the order of writing, late ones too."""
        return self.spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/data/writer=*")


def _first_arrived(rows: DataFrame, limit: int, most: int = 100_000) -> DataFrame:
    """The first ``limit`` rows in order of arrival, written. A page of over ``most`` rows meets in no
    task: rows are sorted in slices, these are counted, and the slice that the page ends in is cut."""
    rows = rows.orderBy("arrival", "place")
    if limit <= most:
        return written(rows.limit(limit))
    found = written(rows.withColumn("_at", F.monotonically_increasing_id()))  # a slice's number, then 33 bits of a row's in it
    left = limit
    for s, n in found.groupBy(F.shiftright("_at", 33).alias("s")).count().orderBy("s").collect():
        if n >= left:
            found = found.filter(F.col("_at") < (s << 33) + left)
            break
        left -= n
    return found.drop("_at")


def fresh(events: DataFrame, log: DataFrame) -> DataFrame:
    return spread(events, "run_id", "seq").dropDuplicates(["run_id", "seq"]).join(log.select("run_id", "seq"), ["run_id", "seq"], "left_anti").select(*events.columns)


class JdbcLog:
    """The event log in a database table with the key (run_id, seq)."""

    def __init__(self, spark: SparkSession, url: str, table: str = "events", properties: dict[str, str] | None = None):
        self.spark, self.url, self.table, self.properties = spark, url, table, properties or {}

    def read_all(self) -> DataFrame:
        return self.spark.read.jdbc(self.url, self.table, properties=self.properties).toDF("run_id", "seq", "type", "payload", "ts")

    def create(self, types: str = "run_id VARCHAR(200), seq BIGINT, type VARCHAR(100), payload VARCHAR(32000), ts DOUBLE") -> None:
        """Makes the empty table."""
        empty = self.spark.createDataFrame([], EVENT)
        empty.write.option("createTableColumnTypes", types).jdbc(self.url, self.table, mode="ignore", properties=self.properties)

    def append(self, events: DataFrame) -> None:
        """Adds what the table has not: the keys at hand are compared with the stored ones."""
        new = fresh(events, self.read_all().select("run_id", "seq"))
        new.write.jdbc(self.url, self.table, mode="append", properties=self.properties)

    def read(self, run_id: str) -> DataFrame:
        return self.read_all().filter(F.col("run_id") == run_id).orderBy("seq")


def verdicts_of(events: DataFrame, judge_id: str | None = None) -> DataFrame:
    """The verdicts of a run, of one judge if asked for, in order of request_index."""
    rows = typed(events, "verdict_recorded")
    return (rows if judge_id is None else rows.filter(F.col("judge_id") == judge_id)).orderBy("request_index")


def data_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type").isin(*DATA_EVENTS))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines. Blank lines are skipped; a line that is no such JSON is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, text, topic from JSON lines; a missing topic is 'none'."""
    rows = _json_lines(spark, path, "id string, text string, topic string").select("r.*")
    return rows.withColumn("topic", F.coalesce("topic", F.lit("none")))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


POOL = "query_id string, quality string, responses array<string>"


def save_pool(pool: DataFrame, path: str) -> None:
    """JSON lines in order of (query_id, quality)."""
    save_json(pool.select("query_id", "quality", "responses").orderBy("query_id", "quality"), path)


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    """query_id, quality, responses; of a key that comes twice the last line holds."""
    rows = _json_lines(spark, path, POOL)
    last = F.max_by("r.responses", F.struct("file", "at", "row")).alias("responses")
    return rows.groupBy(F.col("r.query_id").alias("query_id"), F.col("r.quality").alias("quality")).agg(last)
