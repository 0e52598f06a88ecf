"""Stateful services of a live rollout, chained within one query.

Rows wait in state until the watermark has passed them, then go on in order of request_index.
They wait in chunks of event time, so a micro-batch writes what came and reads what is due,
never all that waits. What a service tells carries an event time just behind the watermark at
which it was told: a service that reads it has not yet let go of any row at or after the one it
speaks of, as that service's watermark is the same or an earlier one. So alarms reset tests, and
transitions move traffic, at the very row at which they do in batch.
"""

from __future__ import annotations

import json
from abc import abstractmethod
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship
from ..functions.draws import below, uniform
from ..functions.mathx import psi
from ..operators.folds import Canary, Decision, Drift, Rebaseline

#: ``at`` is the event time in milliseconds of the row spoken of; ``ts`` the time at which it was told.
TOLD = "run_id string, request_index long, kind string, detail string, at long, ts timestamp"
#: Milliseconds of event time that wait and go together.
BUCKET = 60_000
#: Rows in a chunk of what waits, and the rest of its last bucket.
CHUNK = 4096
#: Categories in a block of a drift monitor's ring.
BLOCK = 1024


class Ordered(StatefulProcessor):
    """Lets rows (at, request_index, value) of a key go in order of (request_index, value) once the watermark has passed them.

    What a micro-batch brings waits in chunks of whole buckets, each named by the first bucket in it. A
    chunk that is due in part is split: what is left is named by its own first bucket. A key has one
    timer, for the first bucket that waits, so a micro-batch costs no more calls than it has chunks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows string")
        self.parts = handle.getValueState("parts", "n long")

    def _wake(self, bucket: int, now: int, gone: int = -1) -> None:
        """Has a timer by the time the bucket is due; those up to ``gone`` have rung."""
        due = max(now + 1, (bucket + 1) * BUCKET)
        if not any(gone < t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple[int, int, str]] = []
        for p in rows:
            new += zip(p["request_index"].tolist(), p["at"].tolist(), p["value"].tolist())
        if new:
            part = self.parts.get()[0] + 1 if self.parts.exists() else 0
            self.parts.update((part,))
            new.sort(key=lambda r: r[1])
            at = 0
            while at < len(new):
                end = min(at + CHUNK, len(new))
                last = new[end - 1][1] // BUCKET
                while end < len(new) and new[end][1] // BUCKET == last:
                    end += 1
                self.waiting.updateValue((new[at][1] // BUCKET, part), (json.dumps(new[at:end]),))
                at = end
            self._wake(new[0][1] // BUCKET, max(0, timerValues.getCurrentWatermarkInMs()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows, left = [], []
        for k in list(self.waiting.keys()):
            if (k[0] + 1) * BUCKET > now:
                left.append(k[0])
                continue
            held = [tuple(r) for r in json.loads(self.waiting.getValue(k)[0])]
            self.waiting.removeKey(k)
            end = bisect_left(held, now // BUCKET, key=lambda r: r[1] // BUCKET)
            rows += held[:end]
            if held[end:]:
                left.append(held[end][1] // BUCKET)
                self.waiting.updateValue((left[-1], k[1]), (json.dumps(held[end:]),))
        if left:
            self._wake(min(left), now, now)
        if rows:
            rows.sort(key=lambda r: (r[0], r[2]))
            yield from self.take(key, rows, now)

    @abstractmethod
    def take(self, key: tuple, rows: list[tuple[int, int, str]], now: int) -> Iterator[pd.DataFrame]:
        """rows: (request_index, at, value) in order; now: the watermark that let them go."""

    def close(self) -> None:
        pass


def _told(run: str, out: list[tuple[int, str, str, int]], now: int) -> Iterator[pd.DataFrame]:
    if out:
        p = pd.DataFrame(out, columns=["request_index", "kind", "detail", "at"])
        p.insert(0, "run_id", run)
        p["ts"] = pd.Timestamp(now + 1, unit="ms", tz="UTC")
        yield p


class Folded(Ordered):
    """A fold over a run's rows. Its state is a JSON value; step(state, index, value) gives (kind, detail) pairs."""

    def __init__(self, start: Callable[[], dict], step: Callable[[dict, int, str], list[tuple[str, str]]]):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fold = handle.getValueState("fold", "state string")

    def take(self, key, rows, now):
        st = json.loads(self.fold.get()[0]) if self.fold.exists() else self.start()
        out = [(i, *event, at) for i, at, value in rows for event in self.step(st, i, value)]
        self.fold.update((json.dumps(st),))
        yield from _told(key[0], out, now)


class DriftRing(Ordered):
    """Population stability of the last categories against the first, at constant cost a row.

    Categories stand in blocks with the counts of all before the block. A check takes the counts
    at the window's two ends, each from one block; blocks that left the window are deleted.
    """

    def __init__(self, monitor: Drift):
        self.monitor = monitor

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getMapState("ring", "block long", "before string, categories string")
        self.seen = handle.getValueState("seen", "n long, first long, reference string, over long")

    def take(self, key, rows, now):
        m = self.monitor
        n, first, reference, over = self.seen.get() if self.seen.exists() else (0, 0, "", 0)
        if over:
            return
        place, k = {c: i + 1 for i, c in enumerate(m.categories)}, len(m.categories)
        new = np.array([place.get(value, 0) for *_, value in rows], np.int64)  # 0: no category
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def block(b: int) -> tuple[np.ndarray, np.ndarray]:
            if b not in blocks:
                before, categories = self.ring.getValue((b,))
                blocks[b] = np.array(json.loads(before), np.int64), np.frombuffer(categories.encode("utf-32-le"), "<u4").astype(np.int64) - 32
            return blocks[b]

        def counts(upto: int) -> np.ndarray:
            """Of the first ``upto`` rows, by category."""
            if upto == 0:
                return np.zeros(k + 1, np.int64)
            before, categories = block((upto - 1) // BLOCK)
            return before + np.bincount(categories[: (upto - 1) % BLOCK + 1], minlength=k + 1)

        at, end = n, n + len(new)
        while at < end:
            b = at // BLOCK
            stop = min(end, (b + 1) * BLOCK)
            before, held = block(b) if at % BLOCK else (counts(at), np.zeros(0, np.int64))
            blocks[b] = before, np.concatenate([held, new[at - n : stop - n]])
            self.ring.updateValue((b,), (json.dumps(blocks[b][0].tolist()), "".join(map(chr, (blocks[b][1] + 32).tolist()))))
            at = stop
        if not reference and end >= m.window:
            reference = json.dumps(counts(m.window).tolist())
        out = []
        checks = range(-(-max(n + 1, 2 * m.window) // m.stride) * m.stride, end + 1, m.stride)
        for c in checks:
            value = float(psi(np.array(json.loads(reference))[1:], (counts(c) - counts(c - m.window))[1:], m.window))
            if value >= m.threshold:
                index, when, _ = rows[c - n - 1]
                out.append((index, "drift_alarm", json.dumps({"psi": value, "threshold": m.threshold}), when))
                over = 1
                break
        gone = max(0, end - m.window) // BLOCK
        for b in range(first, gone if not over else end // BLOCK + 1):
            self.ring.removeKey((b,))
        self.seen.update((end, gone, reference, over))
        yield from _told(key[0], out, now)


class LiveRouter(Ordered):
    """Requests with the share that the last update at or before them has set; a rollout has a handful of updates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.shares = handle.getMapState("shares", "request_index long", "share double")

    def take(self, key, rows, now):
        history = dict((k[0], v[0]) for k, v in self.shares.iterator())
        for i, _, value in rows:
            if value[0] == "!":  # an update sorts before the request of its index
                history[i] = float(value[1:])
                self.shares.updateValue((i,), (history[i],))
        known = np.array(sorted(history), np.int64)
        index = np.array([i for i, _, value in rows if value[0] != "!"], np.int64)
        if len(index):
            at = np.searchsorted(known, index, "right") - 1
            told = np.array([history[i] for i in known.tolist()] or [0.0])
            yield pd.DataFrame({"run_id": key[0], "request_index": index, "share": np.where(at >= 0, told[np.maximum(at, 0)], 0.0), "payload": [value for *_, value in rows if value[0] != "!"], "at": [t for _, t, value in rows if value[0] != "!"], "ts": pd.Timestamp(now + 1, unit="ms", tz="UTC")})


def ordered_rows(df: DataFrame, value: Column, *more: str, at: str | None = None) -> DataFrame:
    """run_id, ts, at, request_index, value of rows; one without an index is left out."""
    when = F.unix_millis("ts") if at is None else F.col(at)
    return df.select("run_id", *more, "ts", when.alias("at"), "request_index", value.alias("value")).filter("request_index IS NOT NULL")


def told_by(rows: DataFrame, service: Ordered, *keys: str, schema: str = TOLD) -> DataFrame:
    ship(rows.sparkSession)
    return rows.groupBy(*(keys or ["run_id"])).transformWithStateInPandas(service, schema, "append", "eventTime", eventTimeColumnName="ts")


def drift_alarms(requests: DataFrame, monitor: Drift) -> DataFrame:
    """The drift alarm of each run of run_id, ts, request_index, topic."""
    return told_by(ordered_rows(requests, F.col("topic")), DriftRing(monitor))


def _with_alarms(verdicts: DataFrame, alarms: DataFrame) -> DataFrame:
    """One stream of verdicts and of alarms, whose value begins with ! and so comes before the verdict of its index."""
    wins = ordered_rows(verdicts, F.col("win").cast("int").cast("string"))
    return wins.unionByName(ordered_rows(alarms, F.concat(F.lit("!"), "detail"), at="at"))


def rebaselined(verdicts: DataFrame, alarms: DataFrame, rule: Rebaseline) -> DataFrame:
    """Drift alarms, the resets that they cause and the alarms raised against the new baseline.

    verdicts: run_id, ts, request_index, win; alarms as ``drift_alarms`` tells them. An alarm resets the
    test at its index, the verdict there included; ``rule.gate`` is not looked at.
    """

    def step(st: dict, index: int, value: str) -> list[tuple[str, str]]:
        if value[0] == "!":
            if st["gated"]:
                return []
            st.update(gated=1, stat=0.0, n=0, s=0)
            return [("drift_alarm", value[1:]), ("test_reset", json.dumps({"cause": "drift_alarm"}))]
        alarm = rule.step(st, int(value), index)
        return [(alarm[0], json.dumps({"p0": alarm[1]}))] if alarm else []

    return told_by(_with_alarms(verdicts, alarms), Folded(rule.start, step))


def decided(verdicts: DataFrame, alarms: DataFrame, rule: Decision) -> DataFrame:
    """First quality alarm and first promotion of each run, both tests starting anew at a drift alarm."""

    def step(st: dict, index: int, value: str) -> list[tuple[str, str]]:
        if value[0] == "!":
            rule.reset(st)
            return [("drift_alarm", value[1:]), ("test_reset", json.dumps({"cause": "drift_alarm"}))]
        return [(kind, "") for kind in rule.step(st, int(value), index)]

    return told_by(_with_alarms(verdicts, alarms), Folded(rule.start, step))


def canary_moves(verdicts: DataFrame, canary: Canary) -> DataFrame:
    """Transitions of each run of run_id, ts, request_index, win; their detail has stage, share and verdicts_in_stage."""

    def step(st: dict, index: int, win: str) -> list[tuple[str, str]]:
        t = canary.step(st, int(win))
        return [(t[0], json.dumps({"stage": t[1], "share": t[2], "verdicts_in_stage": t[3]}))] if t else []

    return told_by(ordered_rows(verdicts, F.col("win").cast("int").cast("string")), Folded(canary.start, step))


def share_updates(moves: DataFrame) -> DataFrame:
    """run_id, request_index, share, at, ts of transitions, as they come out of ``canary_moves``."""
    return moves.select("run_id", "request_index", F.get_json_object("detail", "$.share").cast("double").alias("share"), "at", "ts")


def routed_live(requests: DataFrame, updates: DataFrame, seed: int, shadow_rate: float, epsilon: Column, shards: int = 32) -> DataFrame:
    """Requests with who serves them, while share updates come in: run_id, request_index, at, ts, share,
    served_by, shadowed, a_pool, b_pool and the requests' other columns.

    requests: run_id, ts, request_index and more. updates: as ``share_updates`` makes them; one holds
    from its index on. A run's requests are dealt over ``shards`` keys, to all of which its few updates
    go, so a hot run is no single task.
    """
    more = [c for c in requests.columns if c not in ("run_id", "ts", "request_index")]
    payload = F.to_json(F.struct(*[F.col(c) for c in more]), {"ignoreNullFields": "false"}) if more else F.lit("{}")
    rows = ordered_rows(requests.withColumn("shard", F.pmod(F.col("request_index"), F.lit(shards)).cast("int")), payload, "shard")
    told = updates.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    told = ordered_rows(told, F.concat(F.lit("!"), F.col("share").cast("string")), "shard", at="at")
    schema = "run_id string, request_index long, share double, payload string, at long, ts timestamp"
    df = told_by(rows.unionByName(told), LiveRouter(), "run_id", "shard", schema=schema)
    fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in more)
    df = df.select("run_id", "request_index", "at", "ts", "share", *([F.from_json("payload", fields).alias("p")] if more else [])).select("run_id", "request_index", "at", "ts", "share", *(["p.*"] if more else []))
    serves = uniform(seed, "request_index", "__canary__") < F.col("share")
    sampled = below(seed, "request_index", "__router__", shadow_rate)
    df = df.withColumns({"served_by": F.when(serves, "challenger").otherwise("champion"), "shadowed": sampled | serves, "epsilon_active": epsilon})
    bad = uniform(seed, "request_index", "challenger#mixture") < F.col("epsilon_active")
    return df.withColumns({"a_pool": F.lit("good"), "b_pool": F.when(bad, "bad").otherwise("good")})


class LiveState(StatefulProcessor):
    """What a dashboard asks of a run, kept up with every micro-batch: verdicts seen, the last decisive
    ones, the newest transition. Read it with ``live_state``, or as any Spark state."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.surface = handle.getValueState("surface", "verdicts_seen long, recent string, transitions long, moved_at long, stage string, share double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, recent, moves, moved, stage, share = self.surface.get() if self.surface.exists() else (0, "[]", 0, -1, "shadow", 0.0)
        recent = json.loads(recent)
        for p in rows:
            for index, winner, to, traffic in zip(p["request_index"].tolist(), p["winner"].tolist(), p["stage"].tolist(), p["share"].tolist()):
                if to is not None:
                    moves += 1
                    if index > moved:
                        moved, stage, share = index, to, traffic
                    continue
                seen += 1
                if winner != "tie":
                    recent.append((index, int(winner == "b")))
        recent = sorted(map(tuple, recent))[-self.last :]
        self.surface.update((seen, json.dumps(recent), moves, moved, stage, share))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from ()

    def close(self) -> None:
        pass


def keep_state(verdicts: DataFrame, moves: DataFrame, last: int = 500) -> DataFrame:
    """A query whose state is the surface of each run; it puts out nothing. verdicts: run_id, request_index,
    winner, each once; moves: run_id, request_index, stage, share."""
    ship(verdicts.sparkSession)
    told = verdicts.select("run_id", "request_index", "winner", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("double").alias("share"))
    both = told.unionByName(moves.select("run_id", "request_index", F.lit(None).cast("string").alias("winner"), "stage", "share"))
    return both.groupBy("run_id").transformWithStateInPandas(LiveState(last), "run_id string", "append", "None")


def live_state(spark, checkpoint: str, batch: int | None = None) -> DataFrame:
    """run_id, verdicts_seen, recent_win_rate, transitions, stage, share as of a micro-batch (the last), from the query's checkpoint."""
    read = spark.read.format("statestore").option("stateVarName", "surface")
    rows = (read if batch is None else read.option("batchId", batch)).load(checkpoint).select("key.run_id", "value.*")
    wins = F.transform(F.from_json("recent", "array<array<int>>"), lambda r: r[1])
    rate = F.aggregate(wins, F.lit(0), lambda a, w: a + w) / F.size(wins)
    return rows.select("run_id", "verdicts_seen", F.when(F.size(wins) > 0, rate).alias("recent_win_rate"), "transitions", "stage", "share")
