"""Text-model judging under faults: nothing is asked or paid for twice."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from verdikt.operators import judging
from verdikt.sources import log


def asked(spark, n):
    return spark.createDataFrame([(i, "t", f"question {i}", "a" * (i % 5 + 1), "b" * (i % 3 + 1)) for i in range(n)], "request_index long, topic string, query_text string, a_text string, b_text string")


def flaky(folder, fails):
    """A client that notes its calls; ``fails(index, k)`` says whether the k-th call about an index fails."""

    def load():
        def client(prompt):
            index = prompt.split("question ")[1].split("\n")[0]
            path = os.path.join(folder, index)
            with open(path, "a") as f:
                f.write("x")
            if fails(int(index), os.path.getsize(path)):
                raise ConnectionError("lost")
            first, second = prompt.split("\n\nResponse 1: ", 1)[1].split("\n\nResponse 2: ")
            return f'{{"winner": "{"tie" if len(first) == len(second) else 1 if len(first) > len(second) else 2}"}}', "end_turn"

        return client

    return load


def calls(folder):
    return {int(n): os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder)}


def want(i):
    return "tie" if i % 5 == i % 3 else "a" if i % 5 > i % 3 else "b"


def test_one_call_in_ten_fails(spark, tmp_path):
    folder, store = str(tmp_path / "calls"), log.EventLog(spark, str(tmp_path / "log"))
    os.makedirs(folder)
    load = flaky(folder, lambda i, k: i % 10 == 0 and k == 1 or i == 33)
    failed = judging.judge_into_log(asked(spark, 60), store, "r", "m", 3, load, batches=3, pause=0.01).collect()
    assert [(r["request_index"], r["error"]) for r in failed] == [(33, "ConnectionError: lost")]
    got = {r["request_index"]: r["winner"] for r in log.typed(store.read("r"), "verdict_recorded").collect()}
    assert got == {i: want(i) for i in range(60) if i != 33}
    assert calls(folder) == {i: 3 if i == 33 else 2 if i % 10 == 0 else 1 for i in range(60)}


def test_killed_half_way_and_started_again(spark, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "calls"), log.EventLog(spark, str(tmp_path / "log"))
    os.makedirs(folder)
    appended, append = [], log.EventLog.append

    def dying(self, events, *more):
        if len(appended) == 2:
            raise RuntimeError("killed")
        append(self, events, *more)
        appended.append(1)

    monkeypatch.setattr(log.EventLog, "append", dying)
    with pytest.raises(RuntimeError):
        judging.judge_into_log(asked(spark, 80), store, "r", "m", 3, flaky(folder, lambda i, k: False), batches=4)
    monkeypatch.undo()
    logged = {r["request_index"] for r in log.typed(store.read("r"), "verdict_recorded").collect()}
    assert 0 < len(logged) < 80
    judging.judge_into_log(asked(spark, 80), store, "r", "m", 3, flaky(folder, lambda i, k: False), batches=4)
    got = {r["request_index"]: r["winner"] for r in log.typed(store.read("r"), "verdict_recorded").collect()}
    assert got == {i: want(i) for i in range(80)}
    # what was logged is not asked again; of the rest only the batch that was lost
    times = calls(folder)
    assert all(times[i] == 1 for i in logged) and max(times.values()) == 2 and sum(t == 2 for t in times.values()) < 40
    assert judging.judge_into_log(asked(spark, 80), store, "r", "m", 3, flaky(folder, lambda i, k: True), batches=4).count() == 0


def test_calls_are_bounded_and_at_once(spark):
    rows = asked(spark, 24).coalesce(1).select(F.col("query_text").alias("query"), F.col("a_text").alias("first"), F.col("b_text").alias("second"))

    def load():
        lock, now, most = threading.Lock(), [0], [0]

        def client(prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            return '{"winner": "1"}' if most[0] <= 4 else "too many at once", "end_turn"

        return client

    start = time.time()
    got = judging.llm_verdicts(rows, load, at_once=4, tries=1).collect()
    assert {r["place"] for r in got} == {"first"} and time.time() - start < 24 * 0.05 + 20
    with pytest.raises(ValueError):
        judging.llm_verdicts(rows, load, at_once=0)


def test_a_failed_row_has_no_winner(spark):
    df = asked(spark, 6).withColumns({"a_pool": F.lit("good"), "b_pool": F.lit("good")})
    judge = judging.text_judge(lambda: lambda prompt: ("nonsense", "end_turn"), tries=1)
    got = judging.compare_with(df, 3, "m", judge).collect()
    assert {r["winner"] for r in got} == {None} and all(r["error"].startswith("JudgeError") for r in got)
