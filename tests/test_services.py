"""Stateful services: order by the watermark, the drift ring, live shares, the state surface."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.functions import mathx
from verdikt.operators import folds, metrics
from verdikt.streaming import pipeline, services

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State in memory."""

    def __init__(self):
        self.timers, self.maps = set(), {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, t):
        self.timers.add(t)

    def listTimers(self):
        return list(self.timers)


def started(service):
    service.handle = Handle()
    service.init(service.handle)
    return service


def told(service, rows, now=0):
    return [r for p in service.take(("run",), rows, now) for r in p.itertuples(index=False)]


def deliver(service, rows, watermark):
    """A micro-batch of (at, index, value), then the timers that the watermark has passed."""
    import pandas as pd

    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    out = list(service.handleInputRows(("run",), iter([pd.DataFrame(rows, columns=["at", "request_index", "value"])]), clock)) if rows else []
    for t in sorted(t for t in service.handle.timers if t <= watermark):
        service.handle.timers.discard(t)
        out += list(service.handleExpiredTimer(("run",), clock, None))
    return out


def test_rows_go_in_order_and_only_what_is_due_is_read():
    order = []

    class Seen(services.Ordered):
        def take(self, key, rows, now):
            order.extend(rows)
            yield from ()

    rng, service = random.Random(1), started(Seen())
    rows = [(i * 20_000, i, str(i % 3)) for i in range(400)]
    shuffled = sorted(rows, key=lambda r: r[0] + rng.randint(0, 150_000))
    read, plain = [], service.waiting.getValue
    service.waiting.getValue = lambda k: read.append(k) or plain(k)
    for at in range(0, 400, 40):
        batch = shuffled[at : at + 40]
        deliver(service, batch, max(0, max(r[0] for r in shuffled[: at + 40]) - 200_000))
        assert all((k[0] + 1) * services.BUCKET > max(r[1] for r in order or [(0, -1)]) for k in service.waiting)
    deliver(service, [], 10**12)
    assert [(i, t, v) for t, i, v in rows] == order and not service.waiting and len(read) == len(set(read))


def test_calls_grow_with_chunks_and_not_with_buckets():
    """A long micro-batch takes one timer and a value a chunk; chunks that are due in part are split in order."""
    order, calls = [], []

    class Seen(services.Ordered):
        def take(self, key, rows, now):
            order.extend(rows)
            yield from ()

    service = started(Seen())
    for name in ("updateValue", "getValue"):
        setattr(service.waiting, name, lambda *a, plain=getattr(service.waiting, name): calls.append(1) or plain(*a))
    timer = service.handle.registerTimer
    service.handle.registerTimer = lambda t: calls.append(1) or timer(t)
    rows = [(i * 20_000, i, str(i % 3)) for i in range(20_000)]
    deliver(service, random.Random(4).sample(rows[:15_000], 15_000), 0)
    deliver(service, rows[15_000:], 7_000 * 20_000)
    assert len(order) == 7_000 - 7_000 % 3 and len(service.handle.timers) == 1
    deliver(service, [], 10**12)
    assert [(t, i, v) for i, t, v in order] == rows and not service.waiting and not service.handle.timers
    assert len(calls) < 25


@pytest.mark.parametrize("window,stride,n", [(200, 50, 1500), (1500, 70, 6000), (100_000, 5000, 260_000), (7, 1, 90)])
def test_drift_ring_against_whole_windows(window, stride, n):
    rng = np.random.default_rng(window)
    names = np.array(["a", "b", "c", "elsewhere"])
    drawn = names[np.concatenate([rng.choice(4, n // 2, p=[0.5, 0.3, 0.15, 0.05]), rng.choice(4, n - n // 2, p=[0.2, 0.2, 0.5, 0.1])])]
    counts = np.cumsum(np.pad(drawn[:, None] == names[:3], ((1, 0), (0, 0))), axis=0)
    values = {c: mathx.psi(counts[window], counts[c] - counts[c - window], window) for c in range(stride, n + 1, stride) if c >= 2 * window}
    limit = sorted(values.values())[len(values) // 2]
    want = min(c for c, v in values.items() if v >= limit)
    service, out, at = started(services.DriftRing(folds.Drift(("a", "b", "c"), window, stride, limit))), [], 0
    while at < n:
        stop = min(n, at + int(rng.integers(1, max(2, n // 20))))
        out += told(service, [(i, i, c) for i, c in enumerate(drawn[at:stop].tolist(), at)])
        assert len(service.ring) <= window // services.BLOCK + 3 + (stop - at) // services.BLOCK
        at = stop
    assert [(r.request_index, r.kind) for r in out] == [(want - 1, "drift_alarm")] and json.loads(out[0].detail)["psi"] == pytest.approx(values[want])
    assert not service.ring  # nothing is kept behind the alarm


def written_stream(spark, path, rows, schema, parts):
    """rows as files that come one after the other; parts: their row ranges."""
    for lo, hi in parts:
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, df, path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


START = datetime(2024, 1, 1)


def test_share_updates_hold_from_their_index_on(spark, tmp_path):
    """Updates that come after the requests they move, within the delay, and out of order."""
    schema = "run_id string, ts timestamp, request_index long, note string"
    asked = [("r", START + timedelta(minutes=i), i, f"n{i}" if i % 7 else None) for i in range(120)] + [("~end", START + timedelta(days=99), 0, None)]
    source = written_stream(spark, tmp_path / "asked", asked, schema, [(0, 60), (60, 120), (120, 121)]).withWatermark("ts", "2 hours")
    moves = [("r", START + timedelta(minutes=i), i, s) for i, s in ((80, 0.9), (30, 0.5), (95, 0.0))] + [("~end", START + timedelta(days=99), 0, 0.0)]
    control = written_stream(spark, tmp_path / "moves", moves, "run_id string, ts timestamp, request_index long, share double", [(0, 1), (1, 3), (3, 4)])
    updates = control.withWatermark("ts", "2 hours").withColumn("at", F.unix_millis("ts"))
    got = run(spark, services.routed_live(source, updates, 5, 0.3, F.lit(0.5), shards=4), tmp_path).filter("run_id = 'r'").collect()
    assert sorted((r["request_index"], r["note"]) for r in got) == [(i, n) for _, _, i, n in asked[:-1]]
    share = lambda i: 0.0 if i < 30 or i >= 95 else 0.5 if i < 80 else 0.9
    assert all(r["share"] == share(r["request_index"]) for r in got)
    assert Counter(r["served_by"] for r in got if 80 <= r["request_index"] < 95)["challenger"] >= 10
    # the batch router gives the same where it is told the ranges
    ranges = spark.createDataFrame([(0, 30, 0.0), (30, 80, 0.5), (80, 95, 0.9), (95, 1 << 62, 0.0)], "lo long, hi long, share double")
    plain = pipeline.routed(spark.createDataFrame([(i,) for _, _, i, _ in asked[:-1]], "request_index long"), ranges, 5, 0.3, F.lit(0.5))
    columns = ["request_index", "served_by", "shadowed", "b_pool"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(map(tuple, plain.select(*columns).collect()))


def test_surface_after_every_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice(["a", "b", "tie"]), None, None) for i in range(90)]
    moves = [("a", 20, None, "canary-1", 0.01), ("a", 70, None, "canary-5", 0.05), ("b", 50, None, "rolled-back", 0.0)]
    both = sorted(rows + moves, key=lambda r: r[1])
    schema = "run_id string, request_index long, winner string, stage string, share double"
    parts = [(k, min(k + 31, len(both))) for k in range(0, len(both), 31)]
    stream = written_stream(spark, tmp_path / "in", both, schema, parts)
    run(spark, services.keep_state(stream.filter("winner IS NOT NULL"), stream.filter("stage IS NOT NULL"), 20), tmp_path)
    for k in range(len(parts)):
        seen = both[: parts[k][1]]
        got = {r["run_id"]: r for r in services.live_state(spark, f"{tmp_path}/cp", k).collect()}
        for run_id in {r[0] for r in seen}:
            v = spark.createDataFrame([r[1:3] for r in seen if r[0] == run_id and r[2]], "request_index long, winner string")
            m = spark.createDataFrame([r[1:2] + r[3:] for r in seen if r[0] == run_id and r[3]], "request_index long, stage string, share double")
            want = metrics.state(v, 20, m).first()
            assert [got[run_id][c] for c in ("verdicts_seen", "transitions", "stage", "share")] == [want[c] for c in ("verdicts_seen", "transitions", "stage", "share")]
            assert got[run_id]["recent_win_rate"] == pytest.approx(want["recent_win_rate"])


def test_decisions_reset_by_a_live_drift_alarm(spark, tmp_path):
    """Drift to decision in one query: equal to the batch with the alarm's index as the reset."""
    rng = random.Random(5)
    asked = [("r", START + timedelta(minutes=i), i, rng.choices("abc", (6, 3, 1) if i < 500 else (1, 3, 6))[0]) for i in range(1000)]
    wins = [("r", START + timedelta(minutes=i), i, int(rng.random() < 0.44)) for i in range(0, 1000, 2)]
    end = ("~end", START + timedelta(days=99), 0, None)
    streams = [  # the last row moves the watermark past all others
        written_stream(spark, tmp_path / n, [*rows, end], f"run_id string, ts timestamp, request_index long, {c}", [(k, k + s) for k in range(0, len(rows), s)] + [(len(rows), len(rows) + 1)]).withWatermark("ts", "1 hour")
        for n, rows, c, s in (("asked", asked, "topic string", 250), ("wins", wins, "win int", 125))
    ]
    monitor, rule = folds.Drift(tuple("abc"), 100, 20, 0.3), folds.Decision(h=2.0)
    got = run(spark, services.decided(streams[1], services.drift_alarms(streams[0], monitor), rule), tmp_path).collect()
    found = {r["kind"]: r["request_index"] for r in got}
    assert 500 <= found["drift_alarm"] == found["test_reset"] < 700
    resets = spark.createDataFrame([("r", found["drift_alarm"])], "run_id string, request_index long")
    want = folds.decisions(spark.createDataFrame(wins, "run_id string, ts timestamp, request_index long, win int"), "run_id", rule, resets).collect()
    assert {r["kind"]: r["request_index"] for r in want} == {k: v for k, v in found.items() if k not in ("drift_alarm", "test_reset")} and want
