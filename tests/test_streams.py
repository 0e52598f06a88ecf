"""Window forms against plain folds, state machines, the log."""

import hashlib
import math
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdikt.functions import mathx
from verdikt.functions.mathx import SprtDesign
from verdikt.operators import folds, judging, metrics, seqtest, traffic
from verdikt.sources import log


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(4)
    rows = [(k, i * 3, int(rng.random() < p)) for k, p in (("a", 0.5), ("b", 0.35), ("c", 0.65), ("d", 0.0)) for i in range(400)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, request_index long, win int")


def groups(stream):
    for k, g in stream.toPandas().groupby("k"):
        yield k, g.sort_values("request_index")


def test_cusum_equals_recursion(stream):
    got = {r["k"]: r for r in seqtest.cusum(stream, ["k"], "request_index", 0.5, 0.45, 4.0).collect()}
    for k, g in groups(stream):
        stat, top, alarm = 0.0, 0.0, None
        for n, w in enumerate(g["win"], 1):
            stat = max(0.0, stat + (math.log(0.9) if w else math.log(1.1)))
            top = max(top, stat)
            if alarm is None and stat >= 4.0:
                alarm = n
        assert got[k]["alarm_n"] == alarm and got[k]["max_stat"] == pytest.approx(top, abs=1e-9)


def test_sprt_and_mixture_equal_folds(stream):
    d = SprtDesign(0.5, 0.6)
    got = {r["k"]: r for r in seqtest.sprt(stream, ["k"], "request_index", d).collect()}
    mixed = {r["k"]: r["reject_n"] for r in seqtest.mixture_sprt(stream, ["k"], "request_index", 0.5, 0.05).collect()}
    canary = folds.Canary(p0=0.5, p1=0.01, h=1e9, margin=1e-12, alpha=0.2)
    for k, g in groups(stream):
        llr, decision, stop = 0.0, 0, len(g)
        for n, w in enumerate(g["win"], 1):
            llr += d.win if w else d.loss
            if llr >= d.upper or llr <= d.lower:
                decision, stop = (1 if llr >= d.upper else -1), n
                break
        assert (got[k]["decision"], got[k]["stop"]) == (decision, stop)
        first = next(iter(folds.fold_rows(canary, zip(range(len(g)), g["win"].tolist()))), None)
        assert mixed[k] == (first and first[0] + 1)


def test_canary_batch_equals_fold(stream):
    canary = folds.Canary(h=5.0, margin=0.1, alpha=0.2)
    got = sorted(tuple(r) for r in folds.canary_transitions(stream, "k", canary).collect())
    want = sorted((k, *t) for k, g in groups(stream) for t in folds.fold_rows(canary, zip(g["request_index"].tolist(), g["win"].tolist())))
    assert got == want and any(t[2] == "canary_rolled_back" for t in got) and any(t[2] == "canary_advanced" for t in got)
    with pytest.raises(ValueError):
        folds.Canary(p0=0.4, p1=0.5)


def test_rolling_and_crossings(spark):
    df = spark.createDataFrame([("x", i, int(i >= 50)) for i in range(100)], "k string, request_index long, bad int")
    r = seqtest.rolling_mean(df, ["k"], "request_index", "bad", 20).orderBy("request_index").collect()
    assert (len(r), r[0]["mean"], r[-1]["mean"]) == (81, 0.0, 1.0)
    first = seqtest.first_crossings(df, ["k"], "request_index", F.col("bad") == 1).collect()
    assert [f["request_index"] for f in first] == [50]


def test_log_is_idempotent(spark, tmp_path):
    events = spark.createDataFrame([("a", i, "request_received", "{}", 0.0) for i in range(8)] + [("b", 0, "request_received", "{}", 0.0)], log.EVENT)
    store = log.EventLog(spark, str(tmp_path / "log"))
    store.append(events)
    store.append(events)
    store.append(events.filter("seq between 3 and 5"))
    assert store.read("a").count() == 8 and store.read("b").count() == 1
    assert store.max_seq("a") == 7 and store.max_seq("none") == -1
    assert [r[0] for r in store.run_ids().collect()] == ["a", "b"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        (tmp_path / "broken.json").write_text('{"id": 1}\nnot json\n')
        log.load_queries(spark, str(tmp_path / "broken.json")).collect()


def test_fingerprint_ignores_order_run_and_time(spark):
    rows = [("r", i, "request_received", f'{{"i": {i}}}', float(i)) for i in range(30)]
    a = spark.createDataFrame(rows, log.EVENT)
    b = spark.createDataFrame([("s", 900 - r[1], *r[2:4], 5.0) for r in reversed(rows)], log.EVENT)
    f = lambda d: metrics.fingerprint(d, log.DATA_EVENTS).first()[0]
    assert f(a) == f(b) and f(a) != f(a.filter("seq > 0"))


def test_fingerprint_of_many_events_has_two_levels(spark):
    """Short hashes by their first digits, then one hash over all, however many digits those are."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for n, digits in ((1_000, 2), (1_100_000, 5)):
        payload = F.concat(F.lit('{"i":'), "id", F.lit("}"))
        events = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.lit("request_received").alias("type"), payload.alias("payload"), F.lit(0.0).alias("ts"))
        groups = {}
        for h in sorted(sha(f'{{"type":"request_received","payload":{{"i":{i}}}}}') for i in range(n)):
            groups.setdefault(h[:digits], []).append(sha(f"{h}:1"))
        want = sha("".join(sha("".join(groups[k])) for k in sorted(groups)))
        assert metrics.fingerprint(events, log.DATA_EVENTS).first()[0] == want


def test_json_sources(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text('{"id": 7, "text": "x"}\n\n{"id": "b", "text": "y", "topic": "t"}\n')
    assert sorted(tuple(r) for r in log.load_queries(spark, str(p)).collect()) == [("7", "x", "none"), ("b", "y", "t")]
    pool = traffic.synthetic_pool(traffic.synthetic_queries(spark, 3, ["t"]))
    log.save_pool(pool, str(tmp_path / "pool"))
    assert metrics.same_multiset(log.load_pool(spark, str(tmp_path / "pool")), pool)


def test_missing_pool_and_empty_rate_are_errors(spark):
    df = spark.createDataFrame([(1, "nobody", "good")], "request_index long, query_id string, source_pool string")
    pool = traffic.synthetic_pool(traffic.synthetic_queries(spark, 2, ["t"]))
    with pytest.raises(PySparkException):
        traffic.pool_join(df, pool).collect()
    with pytest.raises(PySparkException):
        metrics.win_rate(spark.createDataFrame([("tie",)], "winner string")).collect()
    with pytest.raises(PySparkException):
        metrics.position_bias(spark.createDataFrame([("tie", "a")], "winner string, first_shown string")).collect()
    with pytest.raises(PySparkException):
        metrics.measured_epsilon(spark.createDataFrame([(3, "bad")], "request_index long, source_pool string"), 5, 9).collect()


def test_judges(spark):
    assert [judging.parse_verdict(f'{{"winner": "{w}"}}') for w in ("1", "2", "tie")] == ["first", "second", "tie"]
    with pytest.raises(judging.JudgeError):
        judging.parse_verdict("garbage")
    df = spark.createDataFrame([("q", "long answer", "short")], "query string, first string, second string")
    assert judging.llm_verdicts(df, lambda: lambda text: ('{"winner": "1"}', "end_turn")).first()["place"] == "first"
    scored = judging.reward_scores(df, lambda: lambda q, a: [float(len(x)) for x in a], "query", "first", "s")
    assert scored.first()["s"] == 11.0
    votes = spark.createDataFrame([(0, "m2", "m1", "model_a"), (0, "m1", "m2", "model_b"), (0, "m1", "m2", "tie"), (1, "m1", "m2", "model_a"), (1, "m1", "m2", "model_b")], "question_id long, model_a string, model_b string, winner string")
    assert [tuple(r) for r in judging.consensus(votes).collect()] == [(0, "m1", "m2", 0, 2, 1, "b")]


def test_rebaseline_learns_a_new_level(spark):
    rng = random.Random(1)
    rows = [("x", i, int(rng.random() < (0.5 if i < 500 else 0.3))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, request_index long, win int")
    ungated = folds.rebaselined_alarms(df, "k", folds.Rebaseline(h=7.0)).toPandas()
    gated = folds.rebaselined_alarms(df, "k", folds.Rebaseline(h=7.0, gate=500)).toPandas()
    assert ungated["request_index"].iloc[0] > 500 and gated.empty  # the new level is learned, and holds
    again = folds.rebaselined_alarms(df.withColumn("win", F.when(F.col("request_index") >= 2000, 0).otherwise(F.col("win"))), "k", folds.Rebaseline(h=7.0, gate=500)).toPandas()
    assert again["request_index"].iloc[0] >= 2000 and again["p0"].iloc[0] == pytest.approx(0.3, abs=0.06)


def test_general_prior_equals_window_form_and_hand_value(stream):
    assert mathx.log_mixture_ratio([1], [0], 0.5)[0] == pytest.approx(math.log(1.5))
    for a, b, p0 in ((1.0, 1.0, 0.5), (2.0, 3.0, 0.44), (0.5, 7.25, 0.3), (30.0, 0.1, 0.6)):
        got = seqtest.mixture_sprt_path(stream, ["k"], "request_index", p0, a, b).toPandas()
        ahead = got[got["s"] > p0 * got["n"]]
        want = mathx.log_mixture_ratio(ahead["s"].to_numpy(), (ahead["n"] - ahead["s"]).to_numpy(), p0, a, b)
        assert len(ahead) and np.allclose(ahead["log_mix"], want, rtol=1e-9, atol=1e-9)
        behind = got[got["s"] <= p0 * got["n"]]
        assert behind["log_mix"].isna().all() and (mathx.log_mixture_ratio(behind["s"].to_numpy(), (behind["n"] - behind["s"]).to_numpy(), p0, a, b) < 1e-9).all()


def plain_steps(rule, rows, resets=()):
    """A fold over (request_index, win) in order, resets before the verdicts of their index."""
    st, out = rule.start(), []
    for i, w in sorted([*rows, *((r, -1) for r in resets)]):
        if w < 0:
            rule.reset(st)
        elif isinstance(rule, folds.Canary):
            t = rule.step(st, w)
            out += [(i, *t)] if t else []
        elif isinstance(rule, folds.Rebaseline):
            t = rule.step(st, w, i)
            out += [(i, *t)] if t else []
        else:
            out += [(i, kind) for kind in rule.step(st, w, i)]
    return out


@pytest.mark.parametrize("span", [1 << 17, 37])
def test_restarts_by_windows_equal_the_fold(spark, monkeypatch, span):
    """Streams that are promoted, rolled back at each stage, left in the middle, of one verdict."""
    monkeypatch.setattr(seqtest, "SPAN", span)
    rng, data = random.Random(8), {}
    for k in range(14):
        change, before, after = rng.choice([0, 150, 400, 900]), rng.choice([0.3, 0.5, 0.7]), rng.choice([0.2, 0.5, 0.75])
        data[f"k{k}"] = [(3 * i + rng.randint(0, 2), int(rng.random() < (before if i < change else after))) for i in range(rng.choice([1, 60, 1200]))]
    data["up"], data["down"] = [(i, 1) for i in range(300)], [(i, 0) for i in range(300)]
    df = spark.createDataFrame([(k, i, w) for k, rows in data.items() for i, w in rows], "k string, request_index long, win int").repartition(4)
    canary = folds.Canary(h=5.0, margin=0.1, alpha=0.2)
    got = folds.canary_transitions(df, "k", canary)
    assert sorted(map(tuple, got.collect())) == sorted((k, *t) for k, rows in data.items() for t in plain_steps(canary, rows))
    kinds = {r["kind"] for r in got.collect()}
    assert kinds == {"canary_advanced", "canary_promoted", "canary_rolled_back"}
    for rule in (folds.Rebaseline(h=3.0), folds.Rebaseline(h=3.0, learn=40, gate=500)):
        got = sorted(map(tuple, folds.rebaselined_alarms(df, "k", rule).collect()))
        want = sorted((k, *t) for k, rows in data.items() for t in plain_steps(rule, rows))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want]) and got
    resets = {k: rng.sample(range(1500), rng.choice([0, 1, 3])) for k in data}
    rule = folds.Decision(h=2.0)
    told = spark.createDataFrame([(k, i) for k, rs in resets.items() for i in rs], "k string, request_index long")
    got = sorted(map(tuple, folds.decisions(df, "k", rule, told).collect()))
    assert got == sorted((k, *t) for k, rows in data.items() for t in plain_steps(rule, rows, resets[k])) and got


def test_gates_of_each_stream(spark):
    rows = [(k, i, int(i % 5 < (3 if i < 400 else 1))) for k in "ab" for i in range(900)]
    df = spark.createDataFrame(rows, "k string, request_index long, win int")
    gates = spark.createDataFrame([("a", 380)], "k string, gate long")
    got = {r["k"]: r["request_index"] for r in folds.rebaselined_alarms(df, "k", folds.Rebaseline(h=4.0, learn=300), gates).collect()}
    plain = {k: plain_steps(folds.Rebaseline(h=4.0, learn=300, gate=g), [r[1:] for r in rows if r[0] == k]) for k, g in (("a", 380), ("b", None))}
    assert got == {k: v[0][0] for k, v in plain.items() if v}


def test_a_hot_stream_is_many_tasks(spark, monkeypatch):
    """Neither the window passes nor the joins between them bring a stream's rows together."""
    monkeypatch.setattr(seqtest, "SPAN", 50)
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("request_index"), (F.col("id") % 3 == 0).cast("int").alias("win"))
    path = seqtest.mixture_sprt_path(df, ["k"], "request_index", 0.4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert path.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = folds.canary_transitions(df, "k", folds.Canary(h=50.0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_decisions_reset_on_drift(spark):
    rows = [("x", i, int(i % 5 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, request_index long, win int")
    rule = folds.Decision(h=2.0)
    first = folds.decisions(df, "k", rule).collect()
    assert [r["kind"] for r in first] == ["quality_alarm"]
    at = first[0]["request_index"]
    later = folds.decisions(df, "k", rule, spark.createDataFrame([("x", at)], "k string, request_index long")).collect()
    assert later[0]["request_index"] > at
    up = folds.decisions(df.withColumn("win", F.lit(1)), "k", rule).collect()
    assert [r["kind"] for r in up] == ["promotion"]


def test_anchors_and_reward(spark):
    items = spark.range(400).withColumnRenamed("id", "request_index")
    judged = judging.compare_randomised(judging.anchors(items, 3), 3, "j", judging.NoisyOracle(1.0))
    assert judged.filter("winner <> label").count() == 0 and 150 < judged.filter("label = 'a'").count() < 250


def test_blocks_change_nothing(spark, stream, monkeypatch):
    """Streams cut into many blocks: the same counts, statistics, places and rolling means."""
    def results():
        cusum = seqtest.cusum_path(stream, ["k"], "request_index", 0.5, 0.45).orderBy("k", "request_index").collect()
        mixed = seqtest.mixture_sprt_path(stream, ["k"], "request_index", 0.5).orderBy("k", "request_index").collect()
        mean = seqtest.rolling_mean(stream, ["k"], "request_index", "win", 25, centred=True).orderBy("k", "request_index").collect()
        psi = seqtest.psi_path(stream.withColumn("c", F.col("win").cast("string")), ["k"], "request_index", "c", ["0", "1"], 50, 10).orderBy("k", "n").collect()
        return cusum, mixed, mean, psi

    whole = results()
    monkeypatch.setattr(seqtest, "SPAN", 90)
    cut = results()
    for a, b in zip(whole, cut):
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert [v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in x] == list(y)


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_of_ties_and_hot_groups(spark, accuracy):
    """With the whole of each group ranked, and with bounds from a sketch."""
    rng = random.Random(8)
    rows = [("hot", 1.0)] * 700 + [("hot", rng.random()) for _ in range(600)] + [("far", rng.gauss(0, 1e6)) for _ in range(900)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r["k"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99, "d": 1.0, "e": 0.0, "f": 0.731}, accuracy).collect()}
    assert set(got) == {"hot", "far", "one", "two"}
    for k, r in got.items():
        assert list(r)[1:] == pytest.approx(list(np.quantile([v for g, v in rows if g == k], [0.1, 0.5, 0.99, 1.0, 0.0, 0.731])))


def test_later_duplicates_replace_earlier_ones(spark):
    a = spark.createDataFrame([(1, 10, "t", "good"), (1, 12, "t", "bad"), (2, 20, "t", "good")], "request_index long, seq long, topic string, source_pool string")
    b = spark.createDataFrame([(1, 11, "bad"), (1, 13, "good"), (3, 30, "good")], "request_index long, seq long, source_pool string")
    assert [tuple(r) for r in judging.pairs(a, b).collect()] == [(1, "t", "bad", "good")]


@pytest.mark.parametrize("span", [1 << 17, 16])
def test_as_of_over_blocks(spark, monkeypatch, span):
    """The last value at or before each row, across blocks without one, on a hot key."""
    monkeypatch.setattr(seqtest, "SPAN", span)
    rng = random.Random(2)
    asked = [("hot", i) for i in range(300)] + [("cold", i) for i in (3, 170, 299)] + [("none", 7)]
    told = [("hot", i, round(rng.random(), 3)) for i in rng.sample(range(300), 9)] + [("cold", 20, 0.5), ("cold", 170, 0.25)]
    left, right = spark.createDataFrame(asked, "k string, request_index long"), spark.createDataFrame(told, "k string, request_index long, share double")
    got = {(r["k"], r["request_index"]): r["share"] for r in traffic.as_of(left, right, ["k"], "request_index", "share", 0.0).collect()}
    want = {(k, i): max(((j, v) for g, j, v in told if g == k and j <= i), default=(0, 0.0))[1] for k, i in asked}
    assert got == want
    assert {r["share"] for r in traffic.as_of(left, right.limit(0), ["k"], "request_index", "share").collect()} == {None}
