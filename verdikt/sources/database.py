"""The event log in a database, written by executors over any Python driver (DB-API 2).

Tasks send rows in batches of ``rows``, or of what has waited ``seconds``, as one insert that
leaves keys alone which the table has. So a task that runs again, a micro-batch that is delivered
again and several writers of the same events all leave one row a key; nothing is read before.
A database that lets one writer in at a time may be several: keys are dealt over them by a hash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import ExitStack
from operator import itemgetter
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..cluster import ship
from .log import EVENT, EVENT_COLUMNS

COLUMNS = [c for c, _ in EVENT_COLUMNS]
ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in EVENT_COLUMNS])
TYPES = "run_id TEXT NOT NULL, seq BIGINT NOT NULL, type TEXT NOT NULL, payload TEXT NOT NULL, ts DOUBLE PRECISION NOT NULL, PRIMARY KEY (run_id, seq)"


class Inserter:
    """One connection, and rows that wait to be sent over it."""

    def __init__(self, connection: Any, statement: str, rows: int, seconds: float):
        self.connection, self.statement, self.rows, self.seconds = connection, statement, rows, seconds
        self.waiting: list[tuple] = []
        self.since = 0.0

    def add(self, row: tuple) -> None:
        if not self.waiting:
            self.since = time.monotonic()
        self.waiting.append(row)
        if len(self.waiting) >= self.rows or time.monotonic() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.connection.cursor().executemany(self.statement, self.waiting)
            self.connection.commit()
            self.waiting = []


class _Share(InputPartition):
    def __init__(self, database: int, k: int):
        self.database, self.k = database, k


def _values(column: pa.Array) -> list:
    """The column's Python values; numpy makes them several times as fast, but has no nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _dealt(wanted: Iterable, several: bool) -> Iterator[tuple[int, Iterable[tuple]]]:
    """Record batches, or rows, as tuples in the order of COLUMNS, each lot with the number of its database.
    Rows need not name it if there is one only."""
    at = where = None
    for some in wanted:
        if isinstance(some, pa.RecordBatch):
            for k in pc.unique(some["database"]).to_pylist():
                part = some.filter(pc.equal(some["database"], k))
                yield k, zip(*(_values(part[c]) for c in COLUMNS))
        else:
            if at is None:  # names are looked up once, not in every row
                at = itemgetter(*map(some.__fields__.index, COLUMNS))
                where = some.__fields__.index("database") if several else None
            row = tuple(some)
            yield 0 if where is None else row[where], [at(row)]


class DatabaseLog:
    """Events in a table with the key (run_id, seq). ``connect`` opens a connection wherever it is called;
    ``mark`` is how the driver writes a parameter (? or %s).

    ``connect`` may be a list, of a database each, all of the same table: a key is in the one that its
    hash names, so the list keeps its length and order for good. A job then writes each database in one task.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any] | Sequence[Callable[[], Any]], table: str = "events", mark: str = "?", rows: int = 256, seconds: float = 0.25, readers: int = 8):
        connects = [connect] if callable(connect) else list(connect)
        self.spark, self.connects, self.table = spark, connects, table
        insert = f"INSERT INTO {table} ({', '.join(COLUMNS)}) VALUES ({', '.join([mark] * len(COLUMNS))}) ON CONFLICT (run_id, seq) DO NOTHING"
        shares = -(-readers // len(connects))  # of a database
        select = f"SELECT {', '.join(COLUMNS)} FROM {table}" + (f" WHERE abs(seq % {shares}) = " if shares > 1 else "")

        def send(wanted: Iterator) -> WriterCommitMessage:
            with ExitStack() as opened:
                outs: dict[int, Inserter] = {}
                for k, some in _dealt(wanted, len(connects) > 1):
                    if k not in outs:
                        connection = connects[k]()
                        opened.callback(connection.close)
                        outs[k] = Inserter(connection, insert, rows, seconds)
                    add = outs[k].add
                    for row in some:
                        add(row)
                for out in outs.values():
                    out.flush()
            return WriterCommitMessage()

        self.send = send

        # rows of a task that failed may stay: they are the same when it runs again
        class Writer(DataSourceArrowWriter):
            def write(self, iterator: Iterator) -> WriterCommitMessage:
                return send(iterator)

        class StreamWriter(DataSourceStreamArrowWriter):
            def write(self, iterator: Iterator) -> WriterCommitMessage:
                return send(iterator)

            def commit(self, messages: list, batchId: int) -> None:
                pass

            def abort(self, messages: list, batchId: int) -> None:
                pass

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Share(d, k) for d in range(len(connects)) for k in range(shares)]

            def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
                connection = connects[partition.database]()
                try:
                    found = connection.cursor()
                    found.execute(select + (str(partition.k) if shares > 1 else ""))
                    while some := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), ARROW.types)], schema=ARROW)
                finally:
                    connection.close()

        self.format = f"verdikt_{table}_{id(self)}"
        own = self.format

        class Events(DataSource):
            @classmethod
            def name(cls) -> str:
                return own

            def schema(self) -> str:
                return EVENT

            def reader(self, schema: StructType) -> DataSourceReader:
                return Reader()

            def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
                return Writer()

            def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
                return StreamWriter()

        ship(spark)
        spark.dataSource.register(Events)

    def create(self, types: str = TYPES) -> None:
        """Makes the table with its key, if it is not there."""
        for connect in self.connects:
            connection = connect()
            connection.cursor().execute(f"CREATE TABLE IF NOT EXISTS {self.table} ({types})")
            connection.commit()
            connection.close()

    def _dealt(self, events: DataFrame) -> DataFrame:
        """Events with the number of their database, a task each where there are several."""
        rows, n = events.select(*[F.col(c).cast(t).alias(c) for c, t in EVENT_COLUMNS]), len(self.connects)
        if n == 1:
            return rows.withColumn("database", F.lit(0))
        return rows.withColumn("database", F.pmod(F.xxhash64("run_id", "seq"), F.lit(n)).cast("int")).repartitionById(n, "database")

    def append(self, events: DataFrame) -> None:
        self.spark.createDataFrame([], EVENT)  # a driver's thread has no session, and so no data sources, before it makes a table
        # in order of keys neighbours share pages: a batch writes few of them
        self._dealt(events).sortWithinPartitions("run_id", "seq").write.format(self.format).mode("append").save()

    def append_stream(self, stream: DataFrame, checkpoint: str, available_now: bool = True, every: str = "250 milliseconds") -> StreamingQuery:
        out = self._dealt(stream).writeStream.format(self.format).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()

    def read_all(self) -> DataFrame:
        return self.spark.read.format(self.format).load()

    def read(self, run_id: str) -> DataFrame:
        return self.read_all().filter(F.col("run_id") == run_id).orderBy("seq")
