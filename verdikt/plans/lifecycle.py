"""Queries over the log, streams, state machines and keyed simulations, each beside its SQL."""

from __future__ import annotations

import os
import sqlite3
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from ..cluster import shared_dir, ship, written
from ..functions import mathx
from ..functions.mathx import JudgeChannel, SprtDesign
from ..operators import folds, judging, metrics, seqtest, traffic
from ..operators import montecarlo as mc
from ..operators.judging import NoisyOracle
from ..sources import log
from ..sources.database import DatabaseLog
from ..streaming import pipeline, services
from .queries import CUSUM_SQL, LOGGED, MIX_SQL, SEED, TOPICS, U, _events, champion, midpoint, oracle, psi_sql, query, r6, requests, shadow, table, verdicts, win_stream

with_base = lambda more: oracle("").rstrip() + f", {more}"  # noqa: E731  more common tables behind the base ones

# --- log, sources, sinks --------------------------------------------------------------------


def _logged(spark: SparkSession, sf: str) -> log.EventLog:
    """The test events in a new log, delivered twice, and once more as a second run."""
    store, e = log.EventLog(spark, shared_dir(spark)), written(_events(spark, sf))
    store.append(e.unionByName(e))
    store.append(e)
    store.append(e.filter("type = 'verdict_recorded'").withColumn("run_id", F.lit("run-2")))
    return store


@query(with_base(f"{LOGGED} SELECT seq, type FROM logged"))
def log_read(spark, sf):
    return _logged(spark, sf).read("run-1").select("seq", "type")


@query(with_base(f"{LOGGED} SELECT 'run-1' AS run_id, max(seq) AS max_seq FROM logged UNION ALL SELECT 'run-2', max(seq) FROM logged WHERE type = 'verdict_recorded'"))
def log_max_seqs(spark, sf):
    return _logged(spark, sf).max_seqs()


@query(with_base(f"{LOGGED} SELECT seq, type, seq // 10 % 3 AS arrival FROM logged ORDER BY arrival, seq LIMIT 4 * (SELECT (count(*) + 5) // 6 FROM logged)"))
def log_pages(spark, sf):
    """Four pages of a log in order of arrival. Each of three batches repeats the ones before and
    brings seqs that lie before theirs; the second and the third come when the first page is read."""
    e = written(_events(spark, sf))
    store, at, size = log.EventLog(spark, shared_dir(spark)), (-1, -1), (e.count() + 5) // 6
    third = F.floor(F.col("seq") / 10) % 3
    store.append(e.unionByName(e).filter(third == 0).orderBy("seq"))
    pages = []
    for k in range(4):
        pages.append(store.tail(at, size))
        at = pages[-1].agg(F.max(F.struct("arrival", "place")).alias("m")).select("m.*").first() or at
        if k == 0:
            store.append(e.filter(third <= 1).orderBy("seq"), "late", 0)
            store.append(e.filter(third <= 1).orderBy("seq"), "late", 0)  # delivered again
            store.append(e.orderBy("seq"), "late", 1)
            store.fold()
    return reduce(DataFrame.unionByName, pages).select("seq", "type", "arrival")


@query(with_base(f"{LOGGED} SELECT type, count(*) AS n, max(seq) AS max_seq FROM logged GROUP BY type"))
def concurrent_append(spark, sf):
    """Four writers append the same events at once, in two batches each, while one of them folds."""
    store, e = log.EventLog(spark, shared_dir(spark), fold_after=3), written(_events(spark, sf))

    def write(k: int) -> None:
        own = log.EventLog(spark, store.path, fold_after=3)
        for b in range(2):
            own.append(e.filter(F.col("seq") % 2 == (b + k) % 2), f"writer-{k}", b)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    return store.read_all().groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("max_seq"))


def _sqlite(spark: SparkSession, events: int) -> DatabaseLog:
    """Databases in files, which stand for a server: for executors on one machine. A file lets one writer in at
    a time, so there are as many as cores, and more where they would hold over 250,000 events each."""
    path = shared_dir(spark).removeprefix("file://")
    os.makedirs(path, exist_ok=True)

    def connect(k: int) -> sqlite3.Connection:
        connection = sqlite3.connect(f"{path}/{k}.db", timeout=60)
        # writers append to a journal that is copied into the table now and then; a commit waits for no disk
        connection.execute("PRAGMA journal_mode = WAL")
        connection.execute("PRAGMA synchronous = NORMAL")
        connection.execute("PRAGMA cache_size = -32000")  # most of a file's keys, for rows that come in no order
        return connection

    store = DatabaseLog(spark, [partial(connect, k) for k in range(max(spark.sparkContext.defaultParallelism, -(-events // 250_000)))])
    store.create()
    return store


@query(with_base(f"{LOGGED} SELECT type, count(*) AS n, max(seq) AS max_seq FROM logged GROUP BY type"))
def database_append(spark, sf):
    """Two jobs append the same events to a table at once, then a stream delivers them all twice."""
    e, source = written(_events(spark, sf)), shared_dir(spark)
    events = e.count()
    store = _sqlite(spark, events)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: store.append(e.filter(F.col("seq") % 3 != k)), range(2)))
    timed = e.withColumn("ts", F.timestamp_seconds(F.col("seq")))
    timed.unionByName(timed).repartition(max(3, events // 250_000)).write.parquet(source)  # so a file holds no more where there are more events
    store.append_stream(spark.readStream.schema(timed.schema).parquet(source), shared_dir(spark)).awaitTermination()
    return written(store.read("run-1").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("max_seq")))


@query(with_base(f"{LOGGED} SELECT type, count(*) AS n FROM logged GROUP BY type"))
def jdbc_append(spark, sf):
    """The log in a database, which here lives in the driver: of a local master only."""
    name = shared_dir(spark).rsplit("/", 1)[1].replace("-", "_")
    store = log.JdbcLog(spark, f"jdbc:derby:memory:{name};create=true", "events", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    store.create()
    e = written(_events(spark, sf))
    store.append(e.filter("seq % 3 = 0"))
    store.append(e)
    store.append(e)
    return written(store.read("run-1").groupBy("type").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT 'q' || lpad(CAST(i AS VARCHAR), 5, '0') AS id, CASE WHEN i % 5 = 0 THEN 'none' ELSE ['click','error','purchase','signup','view'][i % 5 + 1] END AS topic FROM range(200) r(i)")
def query_lines(spark, sf):
    path = shared_dir(spark)
    made = traffic.synthetic_queries(spark, 200, TOPICS)
    log.save_json(made.withColumn("topic", F.when(F.col("topic") != "click", F.col("topic"))), path)
    return log.load_queries(spark, path).select("id", "topic")


@query("SELECT 'q' || lpad(CAST(i AS VARCHAR), 5, '0') AS query_id, q AS quality, CASE WHEN i % 2 = 0 THEN 1 ELSE 4 END AS n FROM range(20) r(i), (VALUES ('good'), ('bad')) t(q)")
def pool_lines(spark, sf):
    """A pool saved and loaded; of keys that come again the later line holds."""
    path, again = shared_dir(spark), shared_dir(spark)
    pool = traffic.synthetic_pool(traffic.synthetic_queries(spark, 20, TOPICS))
    log.save_pool(pool, path)
    later = pool.filter("CAST(substr(query_id, 2) AS INT) % 2 = 0").withColumn("responses", F.slice("responses", 1, 1))
    both = pool.withColumn("o", F.lit(0)).unionByName(later.withColumn("o", F.lit(1)))
    both.coalesce(1).sortWithinPartitions("o").select(F.to_json(F.struct("query_id", "quality", "responses")).alias("value")).write.text(again)
    return log.load_pool(spark, again).join(log.load_pool(spark, path).select("query_id", "quality"), ["query_id", "quality"]).select("query_id", "quality", F.size("responses").alias("n"))


_PAIRED_TURNS = "FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn = 0 AND a.turn = 1"


@query(f"SELECT q.conv_id AS question_id, q.text AS question, a.text AS text_a, a.text || '!' AS text_b {_PAIRED_TURNS}")
def vote_rows(spark, sf):
    """Pairwise votes with their conversations as arrays, flattened to first turns."""
    said = lambda t, text: F.named_struct(F.lit("role"), t["role"], F.lit("content"), text)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.lit("anyone").alias("role"), F.col("text").alias("content"))))
    c = table(spark, sf, "conversations").filter("turn < 2").groupBy("conv_id").agg(turns.alias("a"))
    loud = F.transform("a", lambda t: said(t, F.concat(t["content"], F.lit("!"))))
    rows = c.select(F.col("conv_id").alias("question_id"), F.lit("x").alias("model_a"), F.lit("y").alias("model_b"), F.lit("tie").alias("winner"), F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"), F.col("a").alias("conversation_a"), loud.alias("conversation_b"))
    return judging.vote_rows(rows).filter("text_a IS NOT NULL").select("question_id", "question", "text_a", "text_b")


@query("""SELECT question_id, model_0, model_1, label, text_0, text_1 FROM (
  SELECT l_partkey AS question_id, least(a, b) AS model_0, greatest(a, b) AS model_1,
    CASE WHEN count_if(w <> 'tie' AND (w = 'model_a') = (a <= b)) > count_if(w <> 'tie' AND (w = 'model_a') <> (a <= b)) THEN 'a' ELSE 'b' END AS label,
    count_if(w <> 'tie' AND (w = 'model_a') = (a <= b)) - count_if(w <> 'tie' AND (w = 'model_a') <> (a <= b)) AS lead,
    CAST(arg_min(CASE WHEN a <= b THEN ta ELSE tb END, o) AS VARCHAR) AS text_0, CAST(arg_min(CASE WHEN a <= b THEN tb ELSE ta END, o) AS VARCHAR) AS text_1
  FROM (SELECT l_partkey, l_suppkey % 3 AS a, CAST(l_linenumber % 3 AS BIGINT) AS b, CASE l_returnflag WHEN 'A' THEN 'model_a' WHEN 'R' THEN 'model_b' ELSE 'tie' END AS w,
    'a' || CAST(l_orderkey AS VARCHAR) AS ta, 'b' || CAST(l_linenumber AS VARCHAR) AS tb, l_orderkey * 10 + l_linenumber AS o FROM lineitem) GROUP BY ALL) WHERE lead <> 0""".replace("GROUP BY ALL", "GROUP BY l_partkey, least(a, b), greatest(a, b)"))
def consensus_texts(spark, sf):
    """Consensus with the texts of each pair's first vote."""
    won = F.when(F.col("l_returnflag") == "A", "model_a").when(F.col("l_returnflag") == "R", "model_b").otherwise("tie")
    votes = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("question_id"), (F.col("l_suppkey") % 3).alias("model_a"), (F.col("l_linenumber") % 3).cast("long").alias("model_b"), won.alias("winner"),
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("text_a"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("text_b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return judging.consensus(votes).select("question_id", "model_0", "model_1", "label", "text_0", "text_1")


@query(with_base(f"{LOGGED} SELECT seq, type FROM logged WHERE type IN ('request_received', 'champion_response', 'shadow_response')"))
def data_event_filter(spark, sf):
    return log.data_events(_events(spark, sf)).select("seq", "type")


_TWO_JUDGES = "SELECT request_index, winner FROM verdicts WHERE request_index % 3 <> 0"


@query(oracle(_TWO_JUDGES))
def verdicts_of_judge(spark, sf):
    """The verdicts of one of two judges in a run."""
    v = verdicts(spark, sf).withColumn("judge_id", F.when(F.col("request_index") % 3 == 0, "judge-1").otherwise(F.col("judge_id")))
    e = log.to_events(v, "run-1", "verdict_recorded", ["request_index", "winner", "first_shown", "topic", "judge_id"])
    return log.verdicts_of(e, "judge-0").select("request_index", "winner")


@query(oracle("SELECT request_index, winner FROM verdicts ORDER BY request_index LIMIT 40"))
def first_verdicts(spark, sf):
    return verdicts(spark, sf).orderBy("request_index").limit(40).select("request_index", "winner")


# --- traffic and judging ----------------------------------------------------------------------


@query(oracle(f"""SELECT request_index, t AS topic, 'q' || lpad(CAST(5 * CAST(floor({U('__traffic__:query')} * 40) AS BIGINT) + k AS VARCHAR), 5, '0') AS query_id FROM (
  SELECT *, CASE t WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS k FROM (
  SELECT request_index, CASE WHEN u < 0.2 THEN 'click' WHEN u < 0.4 THEN 'error' WHEN u < 0.6 THEN 'purchase' WHEN u < 0.8 THEN 'signup' ELSE 'view' END AS t FROM (
  SELECT *, {U('__traffic__:topic')} AS u FROM requests)))"""))
def query_pick(spark, sf):
    picked = traffic.pick_topic(SEED, {t: 1.0 for t in TOPICS})
    return traffic.pick_query(requests(spark, sf), SEED, picked, traffic.synthetic_queries(spark, 200, TOPICS)).select("request_index", "topic", "query_id")


def _responses(spark, sf):
    """Requests, champion and shadow responses as events; the shadow's come twice, the later one right."""
    text = lambda pool: F.concat(pool, F.lit(" answer "), F.col("request_index").cast("string"))
    r = requests(spark, sf).withColumn("query_text", F.concat(F.lit("Question "), F.col("request_index").cast("string")))
    out = log.to_events(r, "run-1", "request_received", ["request_index", "query_text", "topic"])
    c = champion(spark, sf).withColumns({"config_id": F.lit("champion"), "text": text(F.lit("good"))})
    s = shadow(spark, sf).withColumns({"config_id": F.lit("challenger"), "text": text(F.col("source_pool"))})
    columns = ["request_index", "config_id", "source_pool", "text"]
    wrong = log.to_events(s.withColumn("source_pool", F.lit("bad")), "run-1", "shadow_response", columns)
    right = log.to_events(s, "run-1", "shadow_response", columns).withColumn("seq", F.col("seq") + 1)
    return out.unionByName(log.to_events(c, "run-1", "champion_response", columns)).unionByName(wrong).unionByName(right)


@query(oracle("SELECT request_index, 'Question ' || CAST(request_index AS VARCHAR) AS query_text, a_pool || ' answer ' || CAST(request_index AS VARCHAR) AS a_text, b_pool || ' answer ' || CAST(request_index AS VARCHAR) AS b_text FROM paired"))
def pair_texts(spark, sf):
    e = _responses(spark, sf)
    a = log.typed(e, "champion_response").join(log.typed(e, "request_received").select("request_index", "topic"), "request_index")
    return judging.pairs(a, log.typed(e, "shadow_response"), log.typed(e, "request_received")).select("request_index", "query_text", "a_text", "b_text")


@query(oracle("SELECT request_index, winner, first_shown, 1 + greatest((SELECT max(request_index) * 10 + 3 FROM paired), (SELECT max(request_index) * 10 + 1 FROM requests)) + request_index AS seq FROM verdicts"))
def judge_run(spark, sf):
    """Verdicts of a run appended to its log behind the greatest seq."""
    store, e = log.EventLog(spark, shared_dir(spark)), _responses(spark, sf)
    store.append(e)
    top = store.max_seq("run-1")
    judge = judging.oracle_judge(NoisyOracle(accuracy=0.85, tie_rate=0.1, position_bias=0.1), SEED, "judge-0")
    store.append(judging.judge_run(store.read_all(), "run-1", SEED, "judge-0", judge, 0.9, after=top))
    v = log.typed(store.read_all(), "verdict_recorded")
    return v.select("request_index", "winner", "first_shown", "seq")


@query(f"SELECT q.conv_id, CASE WHEN length(q.text) = length(a.text) THEN 'tie' WHEN length(q.text) > length(a.text) THEN 'first' ELSE 'second' END AS place {_PAIRED_TURNS} WHERE q.text IS NOT NULL AND a.text IS NOT NULL")
def text_model_judge(spark, sf):
    """A text model's verdicts by a stand-in client, which prefers the longer response."""

    def load():
        def client(prompt: str) -> tuple[str, str]:
            first, second = prompt.split("\n\nResponse 1: ", 1)[1].split("\n\nResponse 2: ")
            winner = "tie" if len(first) == len(second) else "1" if len(first) > len(second) else "2"
            return f'{{"winner": "{winner}"}}', "end_turn"

        return client

    turns = judging.first_turns(table(spark, sf, "conversations")).filter("question IS NOT NULL AND answer IS NOT NULL")
    df = turns.select("conv_id", F.lit("?").alias("query"), F.col("question").alias("first"), F.col("answer").alias("second"))
    return judging.llm_verdicts(df, load).select("conv_id", "place")


_ASKED = f"""asked AS (SELECT q.conv_id AS request_index, q.text AS a_text, a.text AS b_text, CASE WHEN {U('__judge__model:swap', index='q.conv_id')} < 0.5 THEN 'b' ELSE 'a' END AS first_shown {_PAIRED_TURNS} WHERE q.text IS NOT NULL AND a.text IS NOT NULL)"""


@query(f"""WITH {_ASKED} SELECT request_index, first_shown, CASE WHEN length(a_text) = length(b_text) THEN 'tie' WHEN length(a_text) > length(b_text) THEN 'a' ELSE 'b' END AS winner, 'verdict' AS kind FROM asked WHERE length(a_text) + length(b_text) > 30
    UNION ALL SELECT request_index, NULL, NULL, 'failed' FROM asked WHERE length(a_text) + length(b_text) <= 30""")
def model_judging(spark, sf):
    """A text model judges into the log in two runs. In the first it has no answer for some pairs and the
    run ends half-way; the second asks for what is not logged, and the pairs it cannot judge are rows."""

    def load():
        def client(prompt: str) -> tuple[str, str]:
            first, second = prompt.split("\n\nResponse 1: ", 1)[1].split("\n\nResponse 2: ")
            if len(first) + len(second) <= 30:
                raise ConnectionError("no answer")
            winner = "tie" if len(first) == len(second) else "1" if len(first) > len(second) else "2"
            return f'{{"winner": "{winner}"}}', "end_turn"

        return client

    turns = judging.first_turns(table(spark, sf, "conversations")).filter("question IS NOT NULL AND answer IS NOT NULL")
    asked = turns.select(F.col("conv_id").alias("request_index"), F.lit("none").alias("topic"), F.lit("?").alias("query_text"), F.col("question").alias("a_text"), F.col("answer").alias("b_text"))
    store = log.EventLog(spark, shared_dir(spark))
    judging.judge_into_log(asked.filter("request_index % 2 = 0"), store, "run-1", "model", SEED, load, batches=2, tries=1)
    failed = judging.judge_into_log(asked, store, "run-1", "model", SEED, load, batches=2, tries=1)
    told = log.typed(store.read("run-1"), "verdict_recorded").select("request_index", "first_shown", "winner", F.lit("verdict").alias("kind"))
    none = F.lit(None).cast("string")
    return told.unionByName(failed.select("request_index", none.alias("first_shown"), none.alias("winner"), F.lit("failed").alias("kind")))


@query(f"""SELECT q.conv_id AS request_index, CASE WHEN length(q.text) = length(a.text) THEN 'tie' WHEN length(q.text) > length(a.text) THEN 'a' ELSE 'b' END AS winner,
  CASE WHEN {U('__judge__reward:swap', index='q.conv_id')} < 0.5 THEN 'b' ELSE 'a' END AS first_shown {_PAIRED_TURNS} WHERE q.text IS NOT NULL AND a.text IS NOT NULL""")
def reward_model_judge(spark, sf):
    """A reward model behind the judges' common interface; here it scores by length."""
    turns = judging.first_turns(table(spark, sf, "conversations")).filter("question IS NOT NULL AND answer IS NOT NULL")
    df = turns.select(F.col("conv_id").alias("request_index"), F.lit("?").alias("query_text"), F.col("question").alias("a_text"), F.col("answer").alias("b_text"), F.lit("good").alias("a_pool"), F.lit("good").alias("b_pool"))
    judge = judging.reward_judge(lambda: lambda q, a: [float(len(x)) for x in a])
    return judging.compare_with(df, SEED, "reward", judge).select("request_index", "winner", "first_shown")


_PANEL = "CAST(len(list_distinct([" + ", ".join(
    f"CASE WHEN {U(f'__judge__panel:{k}:tie')} < 0.1 THEN 'tie' WHEN a_pool = b_pool THEN CASE WHEN {U(f'__judge__panel:{k}:coin')} < 0.5 THEN 'first' ELSE 'second' END WHEN ({U(f'__judge__panel:{k}:acc')} < {acc}) = (CASE WHEN {U('__judge__panel:swap')} < 0.5 THEN 'b' ELSE 'a' END = 'a') THEN 'first' ELSE 'second' END"
    for k, acc in enumerate((0.85, 0.85, 0.75))
) + "])) > 1 AS INTEGER)"
_ROLLED = f"rolled AS (SELECT *, avg(disagreed) OVER w AS m, count(*) OVER w AS k, row_number() OVER (PARTITION BY topic ORDER BY request_index) AS i FROM (SELECT request_index, topic, {_PANEL} AS disagreed FROM paired) WINDOW w AS (PARTITION BY topic ORDER BY request_index ROWS BETWEEN 79 PRECEDING AND CURRENT ROW))"


def _panel(spark, sf):
    members = [NoisyOracle(0.85, 0.1), NoisyOracle(0.85, 0.1), NoisyOracle(0.75, 0.1)]
    return judging.ensemble(judging.pairs(champion(spark, sf), shadow(spark, sf)), SEED, "panel", members)


@query(with_base(f"{_ROLLED} SELECT topic, request_index, round(m, 6) AS mean FROM rolled WHERE k = 80"))
def rolling_disagreement(spark, sf):
    return seqtest.rolling_mean(_panel(spark, sf), ["topic"], "request_index", "disagreed", 80).select("topic", "request_index", r6("mean"))


@query(with_base(f"{_ROLLED} SELECT topic, min(i) FILTER (WHERE k = 80 AND m >= 0.65) AS alarm_n, min(request_index) FILTER (WHERE k = 80 AND m >= 0.65) AS alarm_at FROM rolled GROUP BY topic HAVING max(k) = 80"))
def disagreement_alarm(spark, sf):
    return seqtest.rolling_alarm(_panel(spark, sf), ["topic"], "request_index", "disagreed", 80, 0.65)


@query(oracle("SELECT topic, round(greatest(0.1, least(0.9, 3 * avg(win) - 1)), 6) AS p0 FROM wins GROUP BY topic"))
def clipped_rates(spark, sf):
    return win_stream(spark, sf).groupBy("topic").agg(F.round(metrics.clip(3 * F.avg("win") - 1), 6).alias("p0"))


# --- state machines ---------------------------------------------------------------------------

_NUMBERED = "numbered AS MATERIALIZED (SELECT topic, request_index, win, row_number() OVER (PARTITION BY topic ORDER BY request_index) AS i FROM wins), starts AS MATERIALIZED (SELECT DISTINCT topic FROM wins)"
_RECURSIVE = lambda more, body: oracle("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", {_NUMBERED}, {more} {body}"

_CANARY_SQL = """canary AS (
  SELECT topic, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS request_index, 0 AS stage, 0 AS over_, CAST(0 AS DOUBLE) AS stat, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s,
    CAST(0 AS DOUBLE) AS ln_n, CAST(0 AS DOUBLE) AS ln_s, CAST(0 AS DOUBLE) AS ln_f, CAST(0.6 AS DOUBLE) AS tail, '' AS kind, CAST(0 AS BIGINT) AS seen FROM starts
  UNION ALL
  SELECT topic, i, request_index, stage + CAST(up AS INTEGER), CAST(back OR (up AND stage = 3) AS INTEGER), stat, CASE WHEN up THEN 0 ELSE n END, CASE WHEN up THEN 0 ELSE s END,
    CASE WHEN up THEN 0.0 ELSE ln_n END, CASE WHEN up THEN 0.0 ELSE ln_s END, CASE WHEN up THEN 0.0 ELSE ln_f END, CASE WHEN up THEN 0.6 ELSE tail END,
    CASE WHEN back THEN 'canary_rolled_back' WHEN up AND stage = 3 THEN 'canary_promoted' WHEN up THEN 'canary_advanced' ELSE '' END, CASE WHEN back THEN n ELSE 0 END
  FROM (SELECT *, NOT back AND tail > 0 AND s > 0.4 * n AND ln_s + ln_f - ln_n - ln(n + 1.0) + ln(CASE WHEN tail > 0 THEN tail ELSE 1.0 END) - ln(0.6::DOUBLE) - s * ln(0.4::DOUBLE) - (n - s) * ln(0.6::DOUBLE) >= ln(4 / 0.2) AS up
    FROM (SELECT *, stat >= 5.0 AS back, greatest(0.0, tail0 + CASE WHEN win = 1 THEN 0.6 ELSE -0.4 END * exp(ln_n - ln_s - ln_f + s * ln(0.4::DOUBLE) + (n - s) * ln(0.6::DOUBLE))) AS tail
      FROM (SELECT c.topic, r.i, r.request_index, r.win, c.stage, greatest(0.0, c.stat + CASE WHEN r.win = 1 THEN ln(0.45 / 0.5) ELSE ln(0.55 / 0.5) END) AS stat, c.n + 1 AS n, c.s + r.win AS s,
          c.ln_n + ln(c.n + 1) AS ln_n, c.ln_s + CASE WHEN r.win = 1 THEN ln(c.s + 1) ELSE 0.0 END AS ln_s, c.ln_f + CASE WHEN r.win = 0 THEN ln(c.n - c.s + 1) ELSE 0.0 END AS ln_f, c.tail AS tail0
        FROM canary c JOIN numbered r ON c.topic = r.topic AND r.i = c.i + 1 WHERE c.over_ = 0)))
)"""
_STAGE_SQL = "CASE WHEN kind = 'canary_rolled_back' THEN 'rolled-back' WHEN stage = 4 THEN 'full' WHEN stage = 1 THEN 'canary-1' WHEN stage = 2 THEN 'canary-5' ELSE 'canary-25' END AS stage, CAST(CASE WHEN kind = 'canary_rolled_back' THEN 0.0 WHEN stage = 4 THEN 1.0 WHEN stage = 1 THEN 0.01 WHEN stage = 2 THEN 0.05 ELSE 0.25 END AS DOUBLE) AS share"
CANARY = folds.Canary(h=5.0, margin=0.1, alpha=0.2)


@query(_RECURSIVE(_CANARY_SQL, f"SELECT topic, request_index, kind, {_STAGE_SQL}, seen AS verdicts_in_stage FROM canary WHERE kind <> ''"))
def canary_lifecycle(spark, sf):
    return folds.canary_transitions(win_stream(spark, sf), "topic", CANARY)


@query(_RECURSIVE(_CANARY_SQL, f"SELECT (SELECT count(*) FROM verdicts WHERE topic = 'click') AS verdicts_seen, count(*) AS transitions, coalesce(arg_max(stage, request_index), 'shadow') AS stage, coalesce(arg_max(share, request_index), 0.0) AS share FROM (SELECT request_index, {_STAGE_SQL} FROM canary WHERE kind <> '' AND topic = 'click')"))
def live_rollout_state(spark, sf):
    v = verdicts(spark, sf).filter("topic = 'click'")
    moved = folds.canary_transitions(metrics.wins(v), "topic", CANARY)
    return metrics.state(v, 500, moved).select("verdicts_seen", "transitions", "stage", "share")


_BASELINE_SQL = """baseline AS (
  SELECT topic, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS request_index, 0 AS state, CAST(0.5 AS DOUBLE) AS p0, CAST(0 AS DOUBLE) AS stat, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, 0 AS over_ FROM starts
  UNION ALL
  SELECT topic, i, request_index, CASE WHEN state = 1 AND n = 100 THEN 2 ELSE state END, CASE WHEN state = 1 AND n = 100 THEN least(0.9, greatest(0.1, s / n)) ELSE p0 END, stat, n, s, CAST(state <> 1 AND stat >= 3.0 AS INTEGER)
  FROM (SELECT topic, i, request_index, win, state, p0, n0 + CAST(state = 1 AS INTEGER) AS n, s0 + CASE WHEN state = 1 THEN win ELSE 0 END AS s,
      CASE WHEN state = 1 THEN 0.0 ELSE greatest(0.0, stat + CASE WHEN win = 1 THEN ln((p0 - 0.05) / p0) ELSE ln((1 - (p0 - 0.05)) / (1 - p0)) END) END AS stat
    FROM (SELECT b.topic, r.i, r.request_index, r.win, CASE WHEN b.state = 0 AND r.request_index >= cp THEN 1 ELSE b.state END AS state, b.p0, CASE WHEN b.state = 0 AND r.request_index >= cp THEN 0.0 ELSE b.stat END AS stat, b.n AS n0, b.s AS s0
      FROM baseline b JOIN numbered r ON b.topic = r.topic AND r.i = b.i + 1, mid WHERE b.over_ = 0))
)"""


@query(_RECURSIVE(_BASELINE_SQL, "SELECT topic, request_index, 'quality_alarm' AS kind, round(p0, 6) AS p0 FROM baseline WHERE over_ = 1"))
def drift_rebaseline(spark, sf):
    found = folds.rebaselined_alarms(win_stream(spark, sf), "topic", folds.Rebaseline(h=3.0, learn=100, gate=midpoint(requests(spark, sf))))
    return found.select("topic", "request_index", "kind", r6("p0"))


# each stretch between resets is a stream of its own; of an alarm and a promotion the first of all counts
_SERVED = """served AS (SELECT topic || CASE WHEN request_index >= cp THEN '2' ELSE '1' END AS topic, request_index, win FROM wins, mid),
counted2 AS (SELECT *, count(*) OVER w AS n, CAST(sum(win) OVER w AS BIGINT) AS s FROM served WINDOW w AS (PARTITION BY topic ORDER BY request_index))"""
_DECIDED = f"{_SERVED}, {CUSUM_SQL.replace('FROM counted', 'FROM counted2')}, {MIX_SQL.replace('FROM counted ', 'FROM counted2 ').replace('0.56', '0.5').replace('0.44', '0.5')}"
_DECISIONS = "SELECT substr(topic, 1, length(topic) - 1) AS topic, min(request_index) AS request_index, 'quality_alarm' AS kind FROM cusum WHERE stat >= 3.0 GROUP BY 1 UNION ALL SELECT substr(topic, 1, length(topic) - 1), min(request_index), 'promotion' FROM mixed WHERE log_mix >= ln(20.0) GROUP BY 1"


@query(with_base(f"{_DECIDED} {_DECISIONS}"))
def decision_service(spark, sf):
    r = requests(spark, sf)
    resets = r.select("topic").distinct().withColumn("request_index", F.lit(midpoint(r)))
    return folds.decisions(win_stream(spark, sf), "topic", folds.Decision(h=3.0), resets)


# --- streams ----------------------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streamed(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """rows (run_id, request_index, ...) as a stream of files, every row delivered twice, with a time from the index."""
    path = shared_dir(spark)
    timed = rows.withColumns({"seq": F.col("request_index"), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_index"))})
    timed.unionByName(timed).repartitionByRange(files, "request_index").write.parquet(path)
    end = spark.createDataFrame([("~end", datetime(2100, 1, 1))], "run_id string, ts timestamp")  # moves the watermark past all rows
    timed.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _run(spark: SparkSession, out: DataFrame, path: str | None = None) -> DataFrame:
    """A stream run to its end, into files."""
    path, before = path or shared_dir(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(_RECURSIVE(_CANARY_SQL, "SELECT topic AS run_id, request_index, kind FROM canary WHERE kind <> ''"))
def canary_stream(spark, sf):
    rows = win_stream(spark, sf).select(F.col("topic").alias("run_id"), "request_index", "win")
    made = pipeline.canary_stream(pipeline.deduplicated(_streamed(spark, rows), "1 hour"), CANARY)
    return _run(spark, made).select("run_id", "request_index", "kind")


@query(with_base(f"{_DECIDED} SELECT topic AS run_id, request_index, kind FROM ({_DECISIONS}) UNION ALL SELECT topic, cp, 'test_reset' FROM (SELECT DISTINCT topic FROM requests), mid"))
def decision_stream(spark, sf):
    rows = win_stream(spark, sf).select(F.col("topic").alias("run_id"), "request_index", "win")
    r = requests(spark, sf)
    resets = r.select(F.col("topic").alias("run_id")).distinct().withColumns({"request_index": F.lit(midpoint(r)), "win": F.lit(-1)})
    stream = _streamed(spark, rows.unionByName(resets).withColumn("reset", (F.col("win") < 0).cast("long")))
    once = stream.withColumn("seq", 2 * F.col("seq") - F.col("reset"))  # a reset is a row of its own
    return _run(spark, pipeline.decision_stream(pipeline.deduplicated(once, "1 hour"), folds.Decision(h=3.0))).select("run_id", "request_index", "kind")


MONITOR = folds.Drift(tuple(TOPICS), 50, 10, 0.2)
_DRIFTED = f"drifted AS MATERIALIZED (SELECT arm, min(request_index) AS request_index FROM ({psi_sql(50, 10)}) WHERE psi >= 0.2 GROUP BY arm)"


def _armed(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select(F.col("arm").cast("string").alias("run_id"), "request_index", "topic")


@query(with_base(f"{_DRIFTED} SELECT CAST(arm AS VARCHAR) AS run_id, request_index, 'drift_alarm' AS kind FROM drifted"))
def drift_stream(spark, sf):
    made = pipeline.drift_stream(pipeline.deduplicated(_streamed(spark, _armed(spark, sf)), "1 hour"), MONITOR)
    return _run(spark, made).select("run_id", "request_index", "kind")


# an arm's verdicts, one after the other, under the test that its drift alarm resets
_GUARDED = f"""{_DRIFTED}, armed AS MATERIALIZED (SELECT r.arm, w.request_index, w.win, row_number() OVER (PARTITION BY r.arm ORDER BY w.request_index) AS i FROM wins w JOIN requests r USING (request_index)),
guarded AS (
  SELECT arm, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS request_index, 0 AS state, CAST(0.5 AS DOUBLE) AS p0, CAST(0 AS DOUBLE) AS stat, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, 0 AS over_ FROM (SELECT DISTINCT arm FROM armed)
  UNION ALL
  SELECT arm, i, request_index, CASE WHEN state = 1 AND n = 100 THEN 2 ELSE state END, CASE WHEN state = 1 AND n = 100 THEN least(0.9, greatest(0.1, s / n)) ELSE p0 END, stat, n, s, CAST(state <> 1 AND stat >= 3.0 AS INTEGER)
  FROM (SELECT arm, i, request_index, win, state, p0, n0 + CAST(state = 1 AS INTEGER) AS n, s0 + CASE WHEN state = 1 THEN win ELSE 0 END AS s,
      CASE WHEN state = 1 THEN 0.0 ELSE greatest(0.0, stat + CASE WHEN win = 1 THEN ln((p0 - 0.05) / p0) ELSE ln((1 - (p0 - 0.05)) / (1 - p0)) END) END AS stat
    FROM (SELECT b.arm, r.i, r.request_index, r.win, CASE WHEN b.state = 0 AND r.request_index >= d.request_index THEN 1 ELSE b.state END AS state, b.p0, CASE WHEN b.state = 0 AND r.request_index >= d.request_index THEN 0.0 ELSE b.stat END AS stat, b.n AS n0, b.s AS s0
      FROM guarded b JOIN armed r ON b.arm = r.arm AND r.i = b.i + 1 LEFT JOIN drifted d ON b.arm = d.arm WHERE b.over_ = 0))
)"""


@query(oracle("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", {_GUARDED}
    SELECT CAST(arm AS VARCHAR) AS run_id, request_index, 'quality_alarm' AS kind, round(p0, 6) AS p0 FROM guarded WHERE over_ = 1
    UNION ALL SELECT CAST(arm AS VARCHAR), request_index, unnest(['drift_alarm', 'test_reset']), NULL FROM drifted""")
def guarded_stream(spark, sf):
    """Drift alarms, the resets they cause and the re-baselined alarms, in one query: two services in a row."""
    arms = requests(spark, sf).select("request_index", F.col("arm").cast("string").alias("run_id"))
    wins = win_stream(spark, sf).select("request_index", "win").join(arms, "request_index")
    streams = [pipeline.deduplicated(_streamed(spark, rows), "1 hour") for rows in (_armed(spark, sf), wins)]
    alarms = services.drift_alarms(streams[0], MONITOR)
    made = services.rebaselined(streams[1], alarms, folds.Rebaseline(h=3.0, learn=100))
    return _run(spark, made).select("run_id", "request_index", "kind", F.round(F.get_json_object("detail", "$.p0").cast("double"), 6).alias("p0"))


def _verdict_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = win_stream(spark, sf).select(F.col("topic").alias("run_id"), "request_index", "win")
    return pipeline.deduplicated(_streamed(spark, rows), "1 hour")


@query(_RECURSIVE(_CANARY_SQL, f"""SELECT r.request_index, r.topic AS run_id, coalesce(c.share, 0.0) AS share, CASE WHEN {U('__canary__', index='r.request_index')} < coalesce(c.share, 0.0) THEN 'challenger' ELSE 'champion' END AS served_by,
    CASE WHEN {U('challenger#mixture', index='r.request_index')} < CASE WHEN r.request_index >= cp THEN 0.3 ELSE 0.0 END THEN 'bad' ELSE 'good' END AS b_pool
  FROM requests r ASOF LEFT JOIN (SELECT topic, request_index, {_STAGE_SQL} FROM canary WHERE kind <> '') c ON r.topic = c.topic AND r.request_index >= c.request_index, mid"""))
def live_router(spark, sf):
    """Canaries move on verdicts while requests are routed, in one query: transitions are the router's share updates."""
    rows = requests(spark, sf).select(F.col("topic").alias("run_id"), "request_index", "value")
    asked = pipeline.deduplicated(_streamed(spark, rows), "1 hour").drop("seq")
    moves = services.canary_moves(_verdict_stream(spark, sf), CANARY)
    made = services.routed_live(asked, services.share_updates(moves), SEED, 0.8, traffic.step_schedule(midpoint(rows), 0.3), shards=4)
    return _run(spark, made).select("request_index", "run_id", "share", "served_by", "b_pool")


@query(_RECURSIVE(_CANARY_SQL, f"""SELECT v.run_id, verdicts_seen, round(recent, 6) AS recent_win_rate, coalesce(transitions, 0) AS transitions, coalesce(stage, 'shadow') AS stage, coalesce(share, 0.0) AS share
  FROM (SELECT topic AS run_id, count(*) AS verdicts_seen FROM verdicts GROUP BY 1) v
  LEFT JOIN (SELECT topic, avg(win) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY request_index DESC) AS back FROM wins) WHERE back <= 500 GROUP BY 1) w ON v.run_id = w.topic
  LEFT JOIN (SELECT topic, count(*) AS transitions, arg_max(stage, request_index) AS stage, arg_max(share, request_index) AS share FROM (SELECT topic, request_index, {_STAGE_SQL} FROM canary WHERE kind <> '') GROUP BY 1) c ON v.run_id = c.topic"""))
def live_state(spark, sf):
    """The surface that a running query keeps in its state, canary included, read from its checkpoint."""
    rows = verdicts(spark, sf).select(F.col("topic").alias("run_id"), "request_index", "winner")
    seen = pipeline.deduplicated(_streamed(spark, rows), "1 hour").filter("winner IS NOT NULL")
    moves = services.canary_moves(_verdict_stream(spark, sf), CANARY)
    told = moves.select("run_id", "request_index", F.get_json_object("detail", "$.stage").alias("stage"), F.get_json_object("detail", "$.share").cast("double").alias("share"))
    path = shared_dir(spark)
    _run(spark, services.keep_state(seen, told), path)
    return services.live_state(spark, f"{path}/checkpoint").withColumn("recent_win_rate", F.round("recent_win_rate", 6))


@query(with_base(f"{LOGGED} SELECT type, count(*) AS n, max(seq) AS max_seq FROM logged GROUP BY type"))
def stream_to_log(spark, sf):
    """Events through a stream that delivers twice into the log, in two runs of the query with a checkpoint each."""
    source, store = shared_dir(spark), shared_dir(spark)
    e = _events(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    files = max(3, requests(spark, sf).count() // 250_000)  # so one holds no more where there are more events
    e.unionByName(e).repartition(files).write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(source)
        pipeline.to_log(stream, store, shared_dir(spark)).awaitTermination()
    return log.EventLog(spark, store).read("run-1").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("max_seq"))


def _fleet(spark, sf):
    """Router, judges and log as streams over one bus, with a consumer that dies in the middle and is started again."""
    bus, store = pipeline.Bus(spark, shared_dir(spark)), shared_dir(spark)
    r, cp = requests(spark, sf), midpoint(requests(spark, sf))
    for part in range(4):
        bus.publish("requests", r.filter(F.col("request_index") % 4 == part))
    shares = pipeline.share_ranges(spark.createDataFrame([(0, 0.0), (cp, 0.25)], "request_index long, share double"))
    died: list[int] = []

    def route(batch: DataFrame, k: int) -> None:
        out = pipeline.routed(batch, shares, SEED, 0.8, traffic.step_schedule(cp, 0.3))
        bus.publish("pairs", out.filter("shadowed"))
        if k == 2 and not died:
            died.append(k)
            raise RuntimeError("a consumer dies after its effects, before its commit")

    def judge(batch: DataFrame, _: int) -> None:
        v = pipeline.judged(batch, SEED, "judge-0", NoisyOracle(0.85, 0.1, 0.1), 0.9)
        events = log.to_events(v, "run-1", "verdict_recorded", ["request_index", "topic", "winner", "first_shown", "judge_id", "served_by"])
        log.EventLog(spark, store).append(events)

    left = []
    for _ in range(2):
        try:
            bus.consume("requests", "router", route, files=1).awaitTermination()
        except StreamingQueryException:
            pass  # what it had taken is given out again
        left.append(bus.pending("requests", "router"))
    bus.consume("pairs", "judges", judge, files=2).awaitTermination()
    left += [bus.pending("pairs", "judges"), bus.pending("requests", "audit")]
    return bus, log.EventLog(spark, store), left


_FLEET = f"""routed AS (SELECT r.*, CASE WHEN {U('__canary__')} < CASE WHEN request_index >= cp THEN 0.25 ELSE 0.0 END THEN 'challenger' ELSE 'champion' END AS served_by FROM requests r, mid),
sent AS (SELECT *, CASE WHEN {U('challenger#mixture')} < CASE WHEN request_index >= cp THEN 0.3 ELSE 0.0 END THEN 'bad' ELSE 'good' END AS b_pool FROM routed, mid WHERE {U('__router__')} < 0.8 OR served_by = 'challenger'),
fshown AS (SELECT *, CASE WHEN {U('__judge__judge-0:swap')} < 0.5 THEN 'b' ELSE 'a' END AS first_shown FROM sent WHERE {U('__judge_sample__judge-0')} < 0.9),
fplaced AS (SELECT *, CASE WHEN {U('__judge__judge-0:tie')} < 0.1 THEN 'tie' WHEN {U('__judge__judge-0:bias')} < 0.1 THEN 'first'
    WHEN b_pool = 'good' THEN CASE WHEN {U('__judge__judge-0:coin')} < 0.5 THEN 'first' ELSE 'second' END
    WHEN ({U('__judge__judge-0:acc')} < 0.85) = (first_shown = 'a') THEN 'first' ELSE 'second' END AS place FROM fshown)"""


@query(with_base(f"{_FLEET} SELECT request_index, first_shown, CASE WHEN place = 'tie' THEN 'tie' WHEN (place = 'first') = (first_shown = 'b') THEN 'b' ELSE 'a' END AS winner FROM fplaced"))
def fleet_verdicts(spark, sf):
    store = _fleet(spark, sf)[1]
    return log.typed(store.read("run-1"), "verdict_recorded").select("request_index", "first_shown", "winner")


@query(with_base(f"{_FLEET} SELECT CAST((SELECT count(*) FROM requests WHERE request_index % 4 IN (2, 3)) > 0 AS INTEGER) AS left_at_death, 0 AS left_after, 0 AS pairs_left, (SELECT count(*) FROM requests) AS other_group, (SELECT count(*) FROM fplaced) AS verdicts"))
def fleet_completion(spark, sf):
    """What groups had left when a consumer died and after, and whether every pair was judged once."""
    bus, store, left = _fleet(spark, sf)
    n = store.read("run-1").count()
    bus.cleanup("requests")
    return spark.createDataFrame([(int(left[0] > 0), left[1], left[2], left[3], n)], "left_at_death int, left_after int, pairs_left int, other_group long, verdicts long")


# --- keyed simulations ------------------------------------------------------------------------

TRIALS, LENGTH = 40, 400
_TRIALS = lambda rate: f"""WITH drawn AS (SELECT id // {LENGTH} AS trial, id % {LENGTH} AS request_index, {U('__trial__', index='id')} AS u FROM range({TRIALS * LENGTH}) r(id)),
wins AS (SELECT trial AS topic, request_index, CAST(u < {rate} AS INTEGER) AS win FROM drawn), counted AS (SELECT *, count(*) OVER w AS n, CAST(sum(win) OVER w AS BIGINT) AS s FROM wins WINDOW w AS (PARTITION BY topic ORDER BY request_index))"""  # noqa: E731
_LLR = "(s * ln(0.6 / 0.5) + (n - s) * ln(0.4 / 0.5))"


def _alarms(spark, h: float = 3.0):
    drop = mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.5, 0.35, 200)
    return seqtest.cusum(drop, ["trial"], "request_index", 0.5, 0.45, h)


@query(_TRIALS("0.56") + f""" SELECT topic AS trial, CASE WHEN up < down THEN 1 WHEN down < up THEN -1 ELSE 0 END AS decision, least(up, down, n) AS stop FROM (
    SELECT topic, coalesce(min(n) FILTER (WHERE {_LLR} >= ln(0.9 / 0.05)), 4611686018427387904) AS up, coalesce(min(n) FILTER (WHERE {_LLR} <= ln(0.1 / 0.95)), 4611686018427387904) AS down, max(n) AS n FROM counted GROUP BY topic)""")
def sprt_trials(spark, sf):
    return seqtest.sprt(mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.56), ["trial"], "request_index", SprtDesign(0.5, 0.6))


_DROP = "CASE WHEN request_index >= 200 THEN 0.35 ELSE 0.5 END"


@query(_TRIALS(_DROP) + f", {CUSUM_SQL} SELECT topic AS trial, coalesce(min(n) FILTER (WHERE stat >= 3.0), -1) AS alarm, round(max(stat), 6) AS max_stat FROM cusum GROUP BY topic")
def cusum_trials(spark, sf):
    return _alarms(spark).select("trial", F.coalesce("alarm_n", F.lit(-1)).alias("alarm"), r6("max_stat"))


@query(_TRIALS(_DROP) + f", {CUSUM_SQL}, alarms AS (SELECT topic % 4 AS arm, min(n) FILTER (WHERE stat >= 3.0) AS alarm FROM cusum GROUP BY topic, topic % 4) SELECT arm, round(count(*) FILTER (WHERE alarm > 200) / count(*), 6) AS detect_rate, round(count(*) FILTER (WHERE alarm <= 200) / count(*), 6) AS premature_rate, round(quantile_cont(alarm - 200, 0.25) FILTER (WHERE alarm > 200), 6) AS latency_p25, round(quantile_cont(alarm - 200, 0.5) FILTER (WHERE alarm > 200), 6) AS latency_p50, round(quantile_cont(alarm - 200, 0.75) FILTER (WHERE alarm > 200), 6) AS latency_p75 FROM alarms GROUP BY arm")
def detection_trials(spark, sf):
    rows = _alarms(spark).select((F.col("trial") % 4).alias("arm"), F.col("alarm_n").alias("alarm"))
    out = metrics.detection_summary(rows, 200, ["arm"])
    return out.select("arm", *[r6(c) for c in out.columns[1:]])


@query(_TRIALS("0.5") + f", {CUSUM_SQL}, tops AS (SELECT topic, max(stat) AS mx FROM cusum GROUP BY topic) SELECT round(quantile_cont(mx, 0.95), 6) AS h FROM tops")
def calibrated_threshold(spark, sf):
    tops = seqtest.cusum(mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.5), ["trial"], "request_index", 0.5, 0.45, 1e9)
    return metrics.percentiles(tops, [], "max_stat", {"h": 0.95}).select(r6("h"))


_GATE = MIX_SQL.replace("0.56", "0.45").replace("0.44", "0.55")


@query(_TRIALS("0.62") + f", {_GATE} SELECT topic AS trial, min(n) FILTER (WHERE log_mix >= ln(20.0)) AS reject_n, min(request_index) FILTER (WHERE log_mix >= ln(20.0)) AS reject_at FROM mixed GROUP BY topic")
def mixture_trials(spark, sf):
    return seqtest.mixture_sprt(mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.62), ["trial"], "request_index", 0.55, 0.05)


@query(_TRIALS("0.57") + f", {_GATE}, hits AS (SELECT topic // 4 AS family, bool_or(log_mix >= ln(4.0)) AS plain, bool_or(log_mix >= ln(16.0)) AS corrected FROM mixed GROUP BY family) SELECT round(avg(CAST(coalesce(plain, false) AS INTEGER)), 6) AS plain, round(avg(CAST(coalesce(corrected, false) AS INTEGER)), 6) AS corrected FROM hits")
def family_error_trials(spark, sf):
    """Four arms a family at alpha and at a quarter of it; a family errs if any arm does."""
    path = seqtest.mixture_sprt_path(mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.57), ["trial"], "request_index", 0.55)
    hit = lambda x: F.coalesce(F.bool_or(F.col("log_mix") >= F.log(F.lit(x))), F.lit(False)).cast("int")
    families = path.groupBy(F.floor(F.col("trial") / 4).alias("family")).agg(hit(4.0).alias("plain"), hit(16.0).alias("corrected"))
    return families.agg(F.round(F.avg("plain"), 6).alias("plain"), F.round(F.avg("corrected"), 6).alias("corrected"))


@query(_TRIALS("0.25") + ", rolled AS (SELECT topic, avg(win) OVER w AS m, count(*) OVER w AS k FROM wins WINDOW w AS (PARTITION BY topic ORDER BY request_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), tops AS (SELECT topic, max(m) AS mx FROM rolled WHERE k = 60 GROUP BY topic) SELECT round(quantile_cont(mx, 0.95), 6) AS threshold FROM tops")
def calibrated_disagreement(spark, sf):
    rolled = seqtest.rolling_mean(mc.keyed_wins(spark, TRIALS, LENGTH, SEED, 0.25), ["trial"], "request_index", "win", 60)
    return metrics.percentiles(rolled.groupBy("trial").agg(F.max("mean").alias("mx")), [], "mx", {"threshold": 0.95}).select(r6("threshold"))


# --- planning ---------------------------------------------------------------------------------


def _wald(rates: str, p0: str, p1: str) -> str:
    """Wald's formulas in SQL; the root is found by halving."""
    return f"""WITH RECURSIVE rates AS ({rates}), steps AS (SELECT *, ln({p1} / {p0}) AS lw, ln((1 - {p1}) / (1 - {p0})) AS ll, ln(0.9 / 0.05) AS up, ln(0.1 / 0.95) AS down FROM rates),
drifts AS (SELECT *, p * lw + (1 - p) * ll AS drift FROM steps),
search AS (
  SELECT *, 0 AS k, CASE WHEN drift < 0 THEN 1e-9 ELSE -1e-9 END::DOUBLE AS near, CASE WHEN drift < 0 THEN 64.0 ELSE -64.0 END::DOUBLE AS far FROM drifts
  UNION ALL
  SELECT * EXCLUDE (k, near, far, mid, below), k + 1, CASE WHEN below THEN mid ELSE near END, CASE WHEN below THEN far ELSE mid END FROM (
    SELECT *, p * exp(mid * lw) + (1 - p) * exp(mid * ll) < 1 AS below FROM (SELECT *, (near + far) / 2 AS mid FROM search WHERE k < 80))),
roots AS (SELECT *, (1 - exp(near * down)) / (exp(near * up) - exp(near * down)) AS accept FROM search WHERE k = 80),
theory AS (SELECT *, (accept * up + (1 - accept) * down) / drift AS n FROM roots)"""


@query(_wald("SELECT i / 100.0::DOUBLE AS p FROM range(40, 65) r(i)", "0.5", "0.55") + " SELECT round(p, 6) AS p, round(accept, 6) AS accept, round(n, 4) AS n FROM theory")
def wald_curve(spark, sf):
    """Promotion probability and mean length over true rates, root found in Arrow batches."""
    ship(spark)
    d = SprtDesign(0.5, 0.55)

    @F.pandas_udf("accept double, n double")
    def curve(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"accept": [d.accept_h1(x) for x in p], "n": [d.expected_n(x) for x in p]})

    rows = spark.range(40, 65).select((F.col("id") / 100.0).alias("p")).withColumn("c", curve("p"))
    return rows.select(r6("p"), F.round("c.accept", 6).alias("accept"), F.round("c.n", 4).alias("n"))


@query(_wald("SELECT h, CASE h WHEN 'h0' THEN 0.5 ELSE 0.535 END::DOUBLE AS p FROM (VALUES ('h0'), ('h1')) t(h)", "0.5::DOUBLE", "0.535::DOUBLE") + """ SELECT round(max(0.7::DOUBLE), 6) AS attenuation, round(max(1 / (0.25 * 0.9)), 6) AS requests_per_verdict, round(max(0.5::DOUBLE), 6) AS observed_p0, round(max(0.535::DOUBLE), 6) AS observed_p1,
  round(max(n) FILTER (WHERE h = 'h0'), 3) AS expected_verdicts_under_h0, round(max(n) FILTER (WHERE h = 'h1'), 3) AS expected_verdicts_under_h1, round(max(n) FILTER (WHERE h = 'h0') / (0.25 * 0.9), 3) AS expected_requests_under_h0, round(max(n) FILTER (WHERE h = 'h1') / (0.25 * 0.9), 3) AS expected_requests_under_h1 FROM theory""")
def planning_calculator(spark, sf):
    p = mathx.plan(0.5, 0.55, JudgeChannel(0.85, 0.25, 0.1))
    df = spark.createDataFrame([tuple(p.values())], ", ".join(f"{k} double" for k in p))
    return df.select(*[F.round(k, 3 if k.startswith("expected") else 6).alias(k) for k in p])


@query(with_base("""grid AS (SELECT topic, n, s FROM counted WHERE s > 0.44 * n),
mass AS (SELECT g.topic, g.n, g.s, sum(exp(lgamma(CAST(n + 5 AS DOUBLE)) - lgamma(j + 1) - lgamma(n + 5 - j) + j * ln(0.44::DOUBLE) + (n + 4 - j) * ln(0.56::DOUBLE))) AS m FROM grid g JOIN range((SELECT max(s) + 2 FROM counted)) r(j) ON j <= s + 1 GROUP BY ALL),
prior AS (SELECT sum(exp(lgamma(5) - lgamma(j + 1) - lgamma(5 - j) + j * ln(0.44::DOUBLE) + (4 - j) * ln(0.56::DOUBLE))) AS m FROM range(2) r(j)),
ratio AS (SELECT topic, n, lgamma(2 + s) + lgamma(3 + n - s) - lgamma(5 + n) + ln(mass.m) - (lgamma(2) + lgamma(3) - lgamma(5)) - ln(prior.m) - s * ln(0.44::DOUBLE) - (n - s) * ln(0.56::DOUBLE) AS log_mix FROM mass, prior)
SELECT topic, min(n) FILTER (WHERE log_mix >= ln(80.0)) AS reject_n, round(max(log_mix), 6) AS max_log_mix FROM ratio GROUP BY topic"""))
def mixture_sprt_general_prior(spark, sf):
    """Whole streams under a Beta(2, 3) prior; the ratio counts while wins are more frequent than p0."""
    path = seqtest.mixture_sprt_path(win_stream(spark, sf), ["topic"], "request_index", 0.44, 2.0, 3.0)
    hit = F.col("log_mix") >= F.log(F.lit(80.0))
    return path.groupBy("topic").agg(F.min(F.when(hit, F.col("n"))).alias("reject_n"), F.round(F.max("log_mix"), 6).alias("max_log_mix"))
