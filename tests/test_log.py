"""The event log under several writers, repeated and broken deliveries, late rows and folding."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from verdikt.sources import log


def events(spark, keys, note=""):
    return spark.createDataFrame([(r, i, "request_received", f'{{"note": "{note}"}}', 0.0) for r, i in keys], log.EVENT)


def keys(df):
    return [(r["run_id"], r["seq"]) for r in df.collect()]


def store_at(spark, tmp_path, **more):
    return log.EventLog(spark, str(tmp_path / "log"), **more)


def test_two_writers_of_the_same_events(spark, tmp_path):
    wanted = [("a", i) for i in range(1000)]
    rows = events(spark, wanted).repartition(3)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store_at(spark, tmp_path).append(rows), range(4)))
    store = store_at(spark, tmp_path)
    assert sorted(keys(store.read_all())) == wanted
    assert sorted(r["arrival"] for r in store.batches().collect()) == [0, 1, 2, 3]


def test_a_name_is_given_once(spark, tmp_path):
    files = store_at(spark, tmp_path).files
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.put_new("arrivals/x", str(k)), range(24)))
    assert won.count(True) == 1 and files.names("arrivals") == ["x"]
    assert (tmp_path / "log/arrivals/x").read_text() == str(won.index(True)) and files.names("staging") == []


def test_appending_reads_nothing_of_the_log(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    store.append(events(spark, [("a", 1)]), "w", 0)
    for name in ("read_all", "arrived", "batches", "_stored", "_since"):
        monkeypatch.setattr(log.EventLog, name, lambda *_: pytest.fail("the log was read"))
    store.append(events(spark, [("a", 1), ("a", 2)]), "w", 1)
    store.append(events(spark, [("a", 9)]), "w", 1)  # published: nothing happens
    monkeypatch.undo()
    assert sorted(keys(store.read_all())) == [("a", 1), ("a", 2)]


def test_a_batch_that_broke_is_replaced(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(store.files, "put_new", lambda *_: (_ for _ in ()).throw(RuntimeError("dies before it publishes")))
        with pytest.raises(RuntimeError):
            store.append(events(spark, [("a", i) for i in range(5)]), "w", 0)
    assert keys(store.read_all()) == []  # what is not published is not there
    store.append(events(spark, [("a", i) for i in range(6)]), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(store.files, "mark", lambda *_: (_ for _ in ()).throw(RuntimeError("dies before it notes that it published")))
        with pytest.raises(RuntimeError):
            store.append(events(spark, [("b", 0)]), "w", 1)
    store.append(events(spark, [("b", 0)]), "w", 1)
    assert sorted(keys(store.read_all())) == [("a", i) for i in range(6)] + [("b", 0)]
    assert [r["arrival"] for r in store.batches().orderBy("arrival").collect()] == [0, 1]


def test_first_copy_stays(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.append(events(spark, [("a", 1), ("a", 2)], "first"))
    store.append(events(spark, [("a", 2), ("a", 3)], "second"))
    notes = lambda: {r["seq"]: r["payload"] for r in store.read_all().collect()}
    want = {1: '{"note": "first"}', 2: '{"note": "first"}', 3: '{"note": "second"}'}
    assert notes() == want
    store.fold()
    store.append(events(spark, [("a", 1), ("a", 3)], "third"))
    assert notes() == want
    store.fold()
    store.vacuum()
    assert notes() == want and store.files.names("bases") == [f"{2:019d}"]


@pytest.mark.parametrize("fold_after", [0, 1, 3])
@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_cursor_goes_by_arrival(spark, tmp_path, fold_after, limit):
    """Every event comes once, late ones too, whatever batches repeat, with folds between the pages."""
    rng, store = random.Random(limit), store_at(spark, tmp_path, fold_after=fold_after)
    known, want, seen, at = set(), [], [], (-1, -1)
    every = [(r, i) for r in "ab" for i in range(12)]
    for batch in range(4):
        rows = [rng.choice(every) for _ in range(9)]
        store.append(events(spark, rows).coalesce(1))
        for k in rows:
            if k not in known:
                known.add(k)
                want.append(k)
        for _ in range(2):
            page = store.tail(at, limit).collect()
            seen += [(r["run_id"], r["seq"]) for r in page]
            at = (page[-1]["arrival"], page[-1]["place"]) if page else at
    while page := store.tail(at, max(limit, 5)).collect():
        seen += [(r["run_id"], r["seq"]) for r in page]
        at = (page[-1]["arrival"], page[-1]["place"])
    assert seen == want


def test_a_page_reads_the_batches_that_hold_it(spark, tmp_path):
    store = store_at(spark, tmp_path, fold_after=0)
    for b in range(6):
        store.append(events(spark, [("a", 10 * b + i) for i in range(10)]).coalesce(1))
    read = []
    since = log.EventLog._since
    log.EventLog._since = lambda self, batches: read.append([b["arrival"] for b in batches]) or since(self, batches)
    try:
        page = store.tail((1, 9), 10).collect()
    finally:
        log.EventLog._since = since
    assert [r["seq"] for r in page] == list(range(20, 30)) and read[0] == [1, 2]


def test_stream_of_arrivals(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.append(events(spark, [("a", 5)]))
    got = str(tmp_path / "got")
    for late in ([], [("a", 2), ("a", 5)]):
        if late:
            store.append(events(spark, late))
        once = store.arrivals().dropDuplicates(["run_id", "seq"])
        once.writeStream.format("parquet").option("path", got).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(keys(spark.read.parquet(got).select("run_id", F.col("seq")))) == [("a", 2), ("a", 5)]


def test_a_long_page_meets_in_no_task(spark):
    """Slices are cut where the page ends, at every size and with more slices than rows."""
    rows = spark.range(997).select(*[F.lit(None).cast(t).alias(c) for c, t in log.EVENT_COLUMNS if c != "seq"], F.col("id").alias("seq"), (F.col("id") * 37 % 5).alias("arrival"), (F.col("id") * 101 % 997).alias("place"))
    rows = rows.repartition(7).select(*log.STORED_COLUMNS)
    want = sorted((r["arrival"], r["place"]) for r in rows.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for limit in (0, 1, 199, 200, 500, 996, 997, 2000):
            page = log._first_arrived(rows, limit, most=0)
            assert page.columns == log.STORED_COLUMNS and sorted((r["arrival"], r["place"]) for r in page.collect()) == want[:limit]
        assert len(log._first_arrived(rows, 900, most=0).inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
