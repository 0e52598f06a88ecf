"""The database sink: one row a key through two writers, killed tasks and repeated batches."""

import random
import sqlite3
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from verdikt.sources import log
from verdikt.sources.database import COLUMNS, DatabaseLog, Inserter, _values


def store_at(spark, path, **more):
    name = str(path / "events.db")
    store = DatabaseLog(spark, lambda: sqlite3.connect(name, timeout=60), **more)
    store.create()
    return store


def events(spark, keys):
    return spark.createDataFrame([(r, i, "request_received", f'{{"i": {i}}}', float(i)) for r, i in keys], log.EVENT)


class Recorded:
    def __init__(self):
        self.sent, self.commits = [], 0

    def cursor(self):
        return self

    def executemany(self, _, rows):
        self.sent.append(len(rows))

    def commit(self):
        self.commits += 1


def test_batches_by_size_and_by_time(monkeypatch):
    to = Recorded()
    out = Inserter(to, "", 256, 1000.0)
    for i in range(600):
        out.add((i,))
    assert to.sent == [256, 256] and to.commits == 2
    out.flush()
    out.flush()
    assert to.sent == [256, 256, 88] and to.commits == 3
    now = [0.0]
    monkeypatch.setattr("verdikt.sources.database.time.monotonic", lambda: now[0])
    out = Inserter(to := Recorded(), "", 256, 0.25)
    for step in (0.0, 0.1, 0.1, 0.1, 0.0):
        now[0] += step
        out.add((step,))
    assert to.sent == [4]


def test_two_writers(spark, tmp_path):
    store, keys = store_at(spark, tmp_path), [(r, i) for r in "ab" for i in range(700)]
    rows = events(spark, keys).repartition(3)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: store.append(rows), range(3)))
    assert sorted((r["run_id"], r["seq"]) for r in store.read_all().collect()) == keys
    assert [r["seq"] for r in store.read("b").collect()] == list(range(700))


def test_a_task_that_dies_half_way_and_runs_again(spark, tmp_path):
    store, keys = store_at(spark, tmp_path, rows=10), [("a", i) for i in range(100)]
    doomed = F.udf(lambda i: 1 // (0 if i == 77 else 1), "int")
    with pytest.raises(Exception):
        store.append(events(spark, keys).coalesce(1).withColumn("ts", doomed("seq").cast("double")))
    assert store.read_all().count() < 100
    store.append(events(spark, keys).coalesce(1))
    assert sorted((r["run_id"], r["seq"]) for r in store.read_all().collect()) == keys


def test_stream_delivers_twice(spark, tmp_path):
    store = store_at(spark, tmp_path)
    rows = events(spark, [("a", i) for i in range(50)]).withColumn("ts", F.timestamp_seconds("seq"))
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        store.append_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / f"cp{k}")).awaitTermination()
    assert store.read("a").count() == 50


def test_names_are_looked_up_once_a_task(spark, tmp_path, monkeypatch):
    """Rows in another order of columns, through a writer that may not ask a row by name."""
    store, seen = store_at(spark, tmp_path), []
    rows = [Row("ts", "payload", "type", "seq", "run_id")(float(i), "{}", "t", i, "a") for i in range(20)]
    monkeypatch.setattr(Row, "__getitem__", lambda self, k: seen.append(k))
    store.send(iter(rows))
    monkeypatch.undo()
    assert not seen
    assert sorted((r["run_id"], r["seq"], r["ts"]) for r in store.read_all().collect()) == [("a", i, float(i)) for i in range(20)]


def test_several_databases(spark, tmp_path):
    """Two jobs at once and a stream that repeats itself leave each key in one of three databases."""
    connects = [partial(sqlite3.connect, str(tmp_path / f"{k}.db"), timeout=60) for k in range(3)]
    store, keys = DatabaseLog(spark, connects), [(r, i) for r in "ab" for i in range(-5, 400)]
    store.create()
    rows = events(spark, random.Random(1).sample(keys, len(keys))).repartition(3)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: store.append(rows.filter(F.pmod("seq", F.lit(3)) != k)), range(2)))
    timed = rows.withColumn("ts", F.timestamp_seconds("seq")).withColumn("seq", F.col("seq").cast("int"))
    timed.unionByName(timed).write.parquet(str(tmp_path / "in"))
    store.append_stream(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    held = [[tuple(r) for r in c().execute("SELECT run_id, seq FROM events")] for c in connects]
    assert all(100 < len(h) < 500 for h in held)
    assert sorted(sum(held, [])) == keys
    assert sorted(map(tuple, store.read_all().collect())) == [(r, i, "request_received", f'{{"i": {i}}}', float(i)) for r, i in keys]


def test_a_task_sends_in_order_of_keys_and_each_database_from_one_task(spark, tmp_path):
    names = [str(tmp_path / f"{k}.db") for k in range(3)]

    def opened(k):
        with open(f"{names[k]}.log", "a") as f:
            f.write("x")
        return sqlite3.connect(names[k], timeout=60)

    store = DatabaseLog(spark, [partial(opened, k) for k in range(3)])
    store.create()
    keys = [(r, i) for r in "ab" for i in range(300)]
    store.append(events(spark, random.Random(2).sample(keys, 600)).repartition(7))
    assert [len(open(f"{n}.log").read()) for n in names] == [2, 2, 2]  # when made, and by one task
    for n in names:
        at = sqlite3.connect(n).execute("SELECT run_id, seq FROM events ORDER BY rowid").fetchall()
        assert at and at == sorted(at)


def test_rows_must_name_one_of_several_databases(spark, tmp_path):
    store = DatabaseLog(spark, [partial(sqlite3.connect, str(tmp_path / f"{k}.db")) for k in range(2)])
    store.create()
    row = Row(*COLUMNS, "database")("a", 1, "t", "{}", 0.0, 1)
    store.send(iter([row]))
    assert [sqlite3.connect(str(tmp_path / f"{k}.db")).execute("SELECT count(*) FROM events").fetchone()[0] for k in range(2)] == [0, 1]
    with pytest.raises(ValueError):
        store.send(iter([Row(*COLUMNS)("a", 2, "t", "{}", 0.0)]))


def test_values_keep_nulls_and_types():
    assert _values(pa.array([2**60 + 1, None])) == [2**60 + 1, None]
    assert [(v, type(v)) for v in _values(pa.array([2**60 + 1]))] == [(2**60 + 1, int)]
    assert _values(pa.array(["é", ""])) == ["é", ""] and _values(pa.array([0.5])) == [0.5]
