"""One query an operator over the driver's tables, each beside the SQL that says the same.

Stand-ins: ``events`` are requests (event_id the index, event_type the topic, user_id
mod 4 the arm), verdicts come from keyed draws on them, ``lineitem`` rows are votes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir, written
from ..functions import mathx
from ..functions.draws import uniform
from ..functions.mathx import JudgeChannel, SprtDesign
from ..operators import folds, judging, metrics, seqtest, traffic
from ..operators.judging import NoisyOracle
from ..sources import log

SEED = 71
JUDGE = NoisyOracle(accuracy=0.85, tie_rate=0.1, position_bias=0.1)
TOPICS = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.requests(table(spark, sf_dir, "events"))


def midpoint(df: DataFrame) -> int:
    """A changepoint halfway through the indices."""
    return df.agg(((F.min("request_index") + F.max("request_index")) / 2).cast("long")).first()[0]


def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).withColumn("source_pool", F.lit("good"))


def shadow(spark: SparkSession, sf_dir: str, rate: float = 0.8, epsilon: float = 0.3) -> DataFrame:
    r = requests(spark, sf_dir)
    return traffic.mixture(traffic.sampled(r, SEED, "__router__", rate), SEED, "challenger", traffic.step_schedule(midpoint(r), epsilon))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.pairs(champion(spark, sf_dir), shadow(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_pairs(paired(spark, sf_dir), SEED, "judge-0", JUDGE, sampling=0.9)


def win_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.wins(verdicts(spark, sf_dir))


def U(stream: str, seed: int = SEED, index: str = "request_index") -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', CAST({index} AS VARCHAR), '{stream}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


BASE = f"""
requests AS (
  SELECT event_id AS request_index, event_type AS topic, user_id % 4 AS arm, value FROM events
), mid AS (
  SELECT CAST(floor((min(request_index) + max(request_index)) / 2.0) AS BIGINT) AS cp FROM requests
), shadow AS (
  SELECT r.*, CAST(CASE WHEN r.request_index >= cp THEN 0.3 ELSE 0.0 END AS DOUBLE) AS epsilon_active,
         CASE WHEN {U('challenger#mixture')} < CASE WHEN r.request_index >= cp THEN 0.3 ELSE 0.0 END THEN 'bad' ELSE 'good' END AS source_pool
  FROM requests r, mid WHERE {U('__router__')} < 0.8
), paired AS (
  SELECT r.request_index, r.topic, 'good' AS a_pool, s.source_pool AS b_pool
  FROM requests r JOIN shadow s USING (request_index)
), shown AS (
  SELECT *, CASE WHEN {U('__judge__judge-0:swap')} < 0.5 THEN 'b' ELSE 'a' END AS first_shown
  FROM paired WHERE {U('__judge_sample__judge-0')} < 0.9
), placed AS (
  SELECT *, CASE
    WHEN {U('__judge__judge-0:tie')} < 0.1 THEN 'tie'
    WHEN {U('__judge__judge-0:bias')} < 0.1 THEN 'first'
    WHEN a_pool = b_pool THEN CASE WHEN {U('__judge__judge-0:coin')} < 0.5 THEN 'first' ELSE 'second' END
    WHEN ({U('__judge__judge-0:acc')} < 0.85) = (first_shown = 'a') THEN 'first' ELSE 'second' END AS place
  FROM shown
), verdicts AS (
  SELECT request_index, topic, first_shown, 'judge-0' AS judge_id, CASE WHEN place = 'tie' THEN 'tie'
    WHEN (place = 'first') = (first_shown = 'b') THEN 'b' ELSE 'a' END AS winner FROM placed
), wins AS (
  SELECT *, CAST(winner = 'b' AS INTEGER) AS win FROM verdicts WHERE winner <> 'tie'
), counted AS (
  SELECT *, count(*) OVER w AS n, CAST(sum(win) OVER w AS BIGINT) AS s FROM wins
  WINDOW w AS (PARTITION BY topic ORDER BY request_index)
)"""


def oracle(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body}"


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --- traffic, sampling, pairing, judging ------------------------------------------------


@query(oracle("SELECT request_index, topic, arm, round(value, 6) AS value FROM requests"))
def source_requests(spark, sf):
    return requests(spark, sf).select("request_index", "topic", F.col("arm").cast("long"), r6("value"))


@query(oracle("SELECT request_index, source_pool, epsilon_active FROM shadow"))
def shadow_mixture(spark, sf):
    return shadow(spark, sf).select("request_index", "source_pool", "epsilon_active")


@query(oracle(f"SELECT topic, count(*) AS n FROM requests WHERE {U('__canary__')} < 0.25 GROUP BY topic"))
def canary_share_filter(spark, sf):
    return traffic.sampled(requests(spark, sf), SEED, "__canary__", 0.25).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("SELECT request_index, CAST(CASE WHEN request_index >= cp AND topic = 'click' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS epsilon FROM requests, mid"))
def topic_step_schedule(spark, sf):
    r = requests(spark, sf)
    return r.select("request_index", traffic.step_schedule(midpoint(r), 0.5, "click").alias("epsilon"))


@query(
    oracle(f"""SELECT request_index, CASE WHEN request_index >= cp THEN CASE WHEN u < 0.1 THEN 'code' WHEN u < 0.4 THEN 'math' ELSE 'text' END
    ELSE CASE WHEN u < 0.5 THEN 'code' WHEN u < 0.75 THEN 'math' ELSE 'text' END END AS picked
    FROM (SELECT *, {U('__traffic__:topic')} AS u FROM requests), mid""")
)
def topic_pick(spark, sf):
    r = requests(spark, sf)
    pick = traffic.pick_topic(SEED, {"code": 2.0, "math": 1.0, "text": 1.0}, {"code": 1.0, "math": 3.0, "text": 6.0}, midpoint(r))
    return r.select("request_index", pick.alias("picked"))


@query(
    oracle(f"""SELECT request_index, source_pool || ' answer ' || CAST(CAST(floor({U('challenger:variant')} * 4) AS BIGINT) AS VARCHAR) || ' to q' || lpad(CAST(request_index % 50 AS VARCHAR), 5, '0') AS response FROM shadow""")
)
def pool_response_pick(spark, sf):
    pool = traffic.synthetic_pool(traffic.synthetic_queries(spark, 50, TOPICS))
    df = shadow(spark, sf).withColumn("query_id", F.format_string("q%05d", F.col("request_index") % 50))
    return traffic.pool_join(df, pool).select("request_index", traffic.pick_response(F.col("responses"), SEED, "challenger:variant").alias("response"))


@query("SELECT 'q' || lpad(CAST(i AS VARCHAR), 5, '0') AS id, 'Question ' || CAST(i AS VARCHAR) || ' about ' || t AS text, t AS topic FROM (SELECT i, ['click','error','purchase','signup','view'][i % 5 + 1] AS t FROM range(200) r(i))")
def synthetic_queries(spark, sf):
    return traffic.synthetic_queries(spark, 200, TOPICS)


@query(oracle(f"SELECT count(*) AS pairs FROM range(20000) r(request_index) WHERE {U('__router__')} < 0.25"))
def expected_pairs(spark, sf):
    return spark.createDataFrame([(traffic.expected_pairs(spark, 20000, SEED, 0.25),)], "pairs long")


@query(
    oracle(f"""SELECT request_index, round(80.0 * exp(0.4 * sqrt(-2 * ln(1 - {U('lat:u')})) * cos(2 * pi() * {U('lat:v')})), 3) AS latency_ms,
    round(-ln(1 - {U('__arrival__')}) / 60.0, 6) AS gap FROM requests""")
)
def latency_model(spark, sf):
    r = requests(spark, sf)
    return r.select("request_index", traffic.lognormal_latency(SEED, "lat", 80.0, 0.4).alias("latency_ms"), F.round(traffic.poisson_gap(SEED, "__arrival__", 60.0), 6).alias("gap"))


@query(oracle("SELECT request_index, topic, a_pool, b_pool FROM paired"))
def champion_shadow_join(spark, sf):
    return paired(spark, sf).select("request_index", "topic", "a_pool", "b_pool")


@query(oracle("SELECT request_index, topic, winner, first_shown, judge_id FROM verdicts"))
def judge_verdicts(spark, sf):
    return verdicts(spark, sf)


@query(
    oracle(
        "SELECT request_index, winner, disagreed FROM (SELECT *, CASE WHEN place = 'tie' THEN 'tie' WHEN (place = 'first') = (fs = 'b') THEN 'b' ELSE 'a' END AS winner FROM (SELECT *, CASE WHEN f >= 2 THEN 'first' WHEN s >= 2 THEN 'second' ELSE 'tie' END AS place FROM (SELECT request_index, fs, len(list_filter(v, lambda x: x = 'first')) AS f, len(list_filter(v, lambda x: x = 'second')) AS s, CAST(len(list_distinct(v)) > 1 AS INTEGER) AS disagreed FROM (SELECT request_index, fs, ["
        + ", ".join(
            f"CASE WHEN {U(f'__judge__panel:{k}:tie')} < 0.1 THEN 'tie' WHEN a_pool = b_pool THEN CASE WHEN {U(f'__judge__panel:{k}:coin')} < 0.5 THEN 'first' ELSE 'second' END WHEN ({U(f'__judge__panel:{k}:acc')} < {acc}) = (fs = 'a') THEN 'first' ELSE 'second' END"
            for k, acc in enumerate((0.85, 0.85, 0.75))
        )
        + f"] AS v FROM (SELECT *, CASE WHEN {U('__judge__panel:swap')} < 0.5 THEN 'b' ELSE 'a' END AS fs FROM paired)))))"
    )
)
def ensemble_majority(spark, sf):
    members = [NoisyOracle(0.85, 0.1), NoisyOracle(0.85, 0.1), NoisyOracle(0.75, 0.1)]
    return judging.ensemble(paired(spark, sf), SEED, "panel", members).select("request_index", "winner", "disagreed")


@query("""SELECT doc_id, CASE WHEN abs(sa - sb) <= 0.5 THEN 'tie' WHEN sa > sb THEN 'a' ELSE 'b' END AS winner
FROM (SELECT doc_id, coalesce(n_chars, 0) % 7 / 2.0 AS sa, doc_id % 5 / 2.0 AS sb FROM documents)""")
def reward_judge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.coalesce("n_chars", F.lit(0)) % 7 / 2.0).alias("sa"), (F.col("doc_id") % 5 / 2.0).alias("sb"))
    return d.select("doc_id", judging.reward_verdict(F.col("sa"), F.col("sb"), 0.5).alias("winner"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'first' WHEN turn % 4 = 1 THEN 'second' WHEN turn % 4 = 2 THEN 'tie' END AS place FROM conversations""")
def verdict_parse(spark, sf):
    reply = F.when(F.col("turn") % 4 == 3, "I cannot say").otherwise(F.concat(F.lit('{"winner": "'), F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("tie")), (F.col("turn") % 4 + 1).cast("int")), F.lit('"}')))
    return table(spark, sf, "conversations").withColumn("reply", F.when(F.col("turn") % 4 == 3, F.lit("I cannot say")).otherwise(reply)).select("conv_id", "turn", judging.parse_verdict_column(F.col("reply")).alias("place"))


@query("SELECT q.conv_id, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn = 0 AND a.turn = 1")
def conversation_first_turns(spark, sf):
    return judging.first_turns(table(spark, sf, "conversations"))


def _votes(spark, sf):
    won = F.when(F.col("l_returnflag") == "A", "model_a").when(F.col("l_returnflag") == "R", "model_b").otherwise("tie")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_suppkey") % 3).alias("model_a"), (F.col("l_linenumber") % 3).cast("long").alias("model_b"), won.alias("winner"))


CONSENSUS = """WITH votes AS (
  SELECT l_partkey AS question_id, l_suppkey % 3 AS a, CAST(l_linenumber % 3 AS BIGINT) AS b,
         CASE l_returnflag WHEN 'A' THEN 'model_a' WHEN 'R' THEN 'model_b' ELSE 'tie' END AS w FROM lineitem
), anchors AS (
  SELECT question_id, least(a, b) AS model_0, greatest(a, b) AS model_1,
         count_if(w <> 'tie' AND (w = 'model_a') = (a <= b))::BIGINT AS votes_a,
         count_if(w <> 'tie' AND (w = 'model_a') <> (a <= b))::BIGINT AS votes_b, count_if(w = 'tie')::BIGINT AS ties
  FROM votes GROUP BY ALL
)"""


@query(CONSENSUS + " SELECT *, CASE WHEN votes_a > votes_b THEN 'a' ELSE 'b' END AS label FROM anchors WHERE votes_a <> votes_b")
def consensus_anchors(spark, sf):
    return judging.consensus(_votes(spark, sf))


@query(CONSENSUS + " SELECT count(*) AS pairs, round(avg(greatest(votes_a, votes_b) / (votes_a + votes_b)), 6) AS agreement, count_if(least(votes_a, votes_b) = 0)::BIGINT AS unanimous FROM anchors WHERE votes_a <> votes_b AND votes_a + votes_b >= 2")
def human_agreement(spark, sf):
    return judging.human_agreement(judging.consensus(_votes(spark, sf))).select("pairs", r6("agreement"), "unanimous")


# --- rates and summaries ------------------------------------------------------------------


@query(oracle("SELECT round(avg(win), 6) AS win_rate, count(*) AS n FROM wins"))
def challenger_win_rate(spark, sf):
    return metrics.win_rate(verdicts(spark, sf)).select(r6("win_rate"), "n")


@query(oracle("SELECT round(avg(CAST(winner = first_shown AS INTEGER)) - 0.5, 6) AS position_bias, count(*) AS n FROM wins"))
def measured_position_bias(spark, sf):
    return metrics.position_bias(verdicts(spark, sf)).select(r6("position_bias"), "n")


@query(oracle("SELECT round(avg(CAST(source_pool = 'bad' AS INTEGER)), 6) AS epsilon, count(*) AS n FROM shadow, mid WHERE request_index >= cp AND request_index < cp + 100000000"))
def measured_epsilon(spark, sf):
    cp = midpoint(requests(spark, sf))
    return metrics.measured_epsilon(shadow(spark, sf), cp, cp + 100000000).select(r6("epsilon"), "n")


@query(oracle("SELECT request_index, CAST(source_pool = 'bad' AS INTEGER) AS bad FROM shadow"))
def shadow_flags(spark, sf):
    return shadow(spark, sf).select("request_index", (F.col("source_pool") == "bad").cast("int").alias("bad"))


@query(oracle("SELECT topic, winner, count(*) AS n FROM verdicts GROUP BY topic, winner"))
def counts_by_type(spark, sf):
    return verdicts(spark, sf).groupBy("topic", "winner").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("SELECT topic, round(avg(win) FILTER (WHERE request_index < cp), 6) AS before, round(avg(win) FILTER (WHERE request_index >= cp), 6) AS after FROM wins, mid GROUP BY topic"))
def topic_phase_rates(spark, sf):
    return metrics.by_phase(win_stream(spark, sf), midpoint(requests(spark, sf))).select("topic", r6("before"), r6("after"))


@query(oracle("SELECT topic, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM requests GROUP BY topic"))
def latency_percentiles(spark, sf):
    found = metrics.percentiles(requests(spark, sf), ["topic"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("topic", r6("p50"), r6("p95"), r6("p99"))


@query(
    oracle("""SELECT topic, k AS "right", n, round(k / n, 6) AS accuracy, round((k / n + w / 2 - h) / (1 + w), 6) AS low, round((k / n + w / 2 + h) / (1 + w), 6) AS high
    FROM (SELECT *, 3.8416 / n AS w, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / n / 4 / n) AS h FROM
    (SELECT topic, count_if(winner = 'a')::BIGINT AS k, count(*) AS n FROM wins JOIN paired USING (request_index, topic) WHERE b_pool = 'bad' GROUP BY topic))""")
)
def judge_calibration(spark, sf):
    labelled = paired(spark, sf).filter("b_pool = 'bad'").select("request_index", F.lit("a").alias("label"))
    return metrics.accuracy(verdicts(spark, sf).join(labelled, "request_index"), ["topic"]).select("topic", "right", "n", r6("accuracy"), r6("low"), r6("high"))


ANCHORS = f"""anchors AS (SELECT doc_id AS request_index, lang, CASE WHEN {U('__anchor__', index='doc_id')} < 0.5 THEN 'a' ELSE 'b' END AS label FROM documents),
shown_a AS (SELECT *, CASE WHEN {U('__judge__sensor:swap')} < 0.5 THEN 'b' ELSE 'a' END AS first_shown FROM anchors),
judged AS (SELECT *, CASE WHEN {U('__judge__sensor:acc')} < 0.85 THEN label WHEN label = 'a' THEN 'b' ELSE 'a' END AS winner FROM shown_a)"""


@query(f"""WITH {ANCHORS} SELECT lang, count_if(winner = label)::BIGINT AS "right", count(*) AS n, round(count_if(winner = label) / count(*), 6) AS accuracy FROM judged GROUP BY lang""")
def anchor_calibration(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("request_index"), "lang")
    judged = judging.compare_randomised(judging.anchors(items, SEED), SEED, "sensor", NoisyOracle(0.85))
    return metrics.accuracy(judged, ["lang"]).select("lang", "right", "n", r6("accuracy"))


@query(oracle("SELECT (SELECT count(*) FROM verdicts) AS verdicts_seen, round(avg(win), 6) AS recent_win_rate FROM (SELECT win FROM wins ORDER BY request_index DESC LIMIT 500)"))
def live_state(spark, sf):
    return metrics.state(verdicts(spark, sf)).select("verdicts_seen", r6("recent_win_rate"))


@query(oracle("SELECT topic, round(v - first_value(v) OVER (ORDER BY topic), 6) AS delta FROM (SELECT topic, quantile_cont(value, 0.99) AS v FROM requests GROUP BY topic)"))
def paired_delta(spark, sf):
    p = metrics.percentiles(requests(spark, sf), ["topic"], "value", {"v": 0.99})
    base = p.agg(F.min_by("v", "topic").alias("b"))  # one row
    return p.crossJoin(F.broadcast(base)).select("topic", F.round(F.col("v") - F.col("b"), 6).alias("delta"))


# --- sequential tests ---------------------------------------------------------------------

DESIGN = SprtDesign(0.5, 0.55)
LLR5 = "(s * ln(0.55 / 0.5) + (n - s) * ln(0.45 / 0.5))"
WALK = "(s * ln(0.45 / 0.5) + (n - s) * ln(0.55 / 0.5))"
CUSUM_SQL = f"walked AS (SELECT *, {WALK} AS walk FROM counted), cusum AS (SELECT *, walk - least(0.0, min(walk) OVER (PARTITION BY topic ORDER BY request_index)) AS stat FROM walked)"


@query(oracle(f"""SELECT topic, CASE WHEN up < down THEN 1 WHEN down < up THEN -1 ELSE 0 END AS decision, least(up, down, n) AS stop FROM (
    SELECT topic, coalesce(min(n) FILTER (WHERE {LLR5} >= ln(0.9 / 0.05)), 4611686018427387904) AS up,
    coalesce(min(n) FILTER (WHERE {LLR5} <= ln(0.1 / 0.95)), 4611686018427387904) AS down, max(n) AS n FROM counted GROUP BY topic)"""))
def sprt(spark, sf):
    return seqtest.sprt(win_stream(spark, sf), ["topic"], "request_index", DESIGN)


@query(oracle("").rstrip() + f", {CUSUM_SQL} SELECT topic, min(n) FILTER (WHERE stat >= 3.0) AS alarm_n, min(request_index) FILTER (WHERE stat >= 3.0) AS alarm_at, round(max(stat), 6) AS max_stat FROM cusum GROUP BY topic")
def cusum(spark, sf):
    return seqtest.cusum(win_stream(spark, sf), ["topic"], "request_index", 0.5, 0.45, 3.0).select("topic", "alarm_n", "alarm_at", r6("max_stat"))


@query(oracle("").rstrip() + f", {CUSUM_SQL} SELECT topic, request_index, round(least(stat / 3.0, 1.0), 6) AS level FROM cusum")
def cusum_level(spark, sf):
    df = seqtest.cusum_path(win_stream(spark, sf), ["topic"], "request_index", 0.5, 0.45)
    return df.select("topic", "request_index", F.round(F.least(F.col("stat") / 3.0, F.lit(1.0)), 6).alias("level"))


MIX_SQL = """logs AS (SELECT *, n - s AS f, sum(ln(n)) OVER w AS ln_n, sum(CASE WHEN win = 1 THEN ln(s) ELSE 0.0 END) OVER w AS ln_s,
  sum(CASE WHEN win = 0 THEN ln(n - s) ELSE 0.0 END) OVER w AS ln_f FROM counted WINDOW w AS (PARTITION BY topic ORDER BY request_index)),
terms AS (SELECT *, CASE WHEN win = 1 THEN 0.56 ELSE -0.44 END * exp(ln_n - ln_s - ln_f + s * ln(0.44) + f * ln(0.56)) AS term FROM logs),
tails AS (SELECT *, 0.56 + sum(term) OVER (PARTITION BY topic ORDER BY request_index) AS tail FROM terms),
mixed AS (SELECT *, CASE WHEN tail > 0 AND s > 0.44 * n THEN ln_s + ln_f - ln_n - ln(n + 1.0) + ln(CASE WHEN tail > 0 THEN tail END) - ln(0.56) - s * ln(0.44) - f * ln(0.56) END AS log_mix FROM tails)"""


@query(oracle("").rstrip() + f", {MIX_SQL} SELECT topic, min(n) FILTER (WHERE log_mix >= ln(80.0)) AS reject_n, min(request_index) FILTER (WHERE log_mix >= ln(80.0)) AS reject_at FROM mixed GROUP BY topic")
def mixture_sprt(spark, sf):
    return seqtest.mixture_sprt(win_stream(spark, sf), ["topic"], "request_index", 0.44, 0.0125)


@query(oracle("SELECT topic, min(n) FILTER (WHERE s / n - 0.4 > 0.85 * sqrt((ln(ln(2.0 * n)) + 0.72 * ln(5.2 / 0.05)) / n)) AS reject_n FROM counted GROUP BY topic"))
def stitched_confidence_sequence(spark, sf):
    return seqtest.stitched_sequence(win_stream(spark, sf), ["topic"], "request_index", 0.4, 0.05)


@query("SELECT n, round(0.85 * sqrt((ln(ln(2.0 * n)) + 0.72 * ln(5.2 / 0.05)) / n), 9) AS radius FROM (VALUES (10), (100), (1000), (10000)) t(n)")
def radius_table(spark, sf):
    return spark.createDataFrame([(n,) for n in (10, 100, 1000, 10000)], "n int").select("n", F.round(seqtest.stitched_radius(F.col("n"), 0.05), 9).alias("radius"))


@query(oracle("SELECT topic, round(max(z), 6) AS max_z, CAST(max(z) > 1.959963984540054 AS INTEGER) AS tripped FROM (SELECT topic, abs(s / n - 0.5) / sqrt(0.25 / n) AS z FROM counted WHERE n % 50 = 0) GROUP BY topic"))
def naive_peeking(spark, sf):
    return seqtest.naive_peeking(win_stream(spark, sf), ["topic"], "request_index", every=50).select("topic", r6("max_z"), "tripped")


@query(oracle("SELECT topic, request_index, round(m, 6) AS mean FROM (SELECT *, avg(CAST(source_pool = 'bad' AS INTEGER)) OVER w AS m, count(*) OVER w AS k FROM shadow WINDOW w AS (PARTITION BY topic ORDER BY request_index ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)) WHERE k = 100"))
def rolling_epsilon(spark, sf):
    df = shadow(spark, sf).withColumn("bad", (F.col("source_pool") == "bad").cast("int"))
    return seqtest.rolling_mean(df, ["topic"], "request_index", "bad", 100, centred=True).select("topic", "request_index", r6("mean"))


_Q, _P = " + ".join(f"q{i}" for i in range(5)), " + ".join(f"p{i}" for i in range(5))
_TERMS = " + ".join(f"(q{i} / ({_Q}) - p{i} / ({_P})) * ln((q{i} / ({_Q})) / (p{i} / ({_P})))" for i in range(5))


def psi_sql(window: int, stride: int) -> str:
    """arm, n, request_index, psi at each check of the requests' topics."""
    counts = "".join(f", sum(CAST(topic = '{t}' AS INTEGER)) OVER w AS c{i}, sum(CASE WHEN n <= {window} THEN CAST(topic = '{t}' AS INTEGER) ELSE 0 END) OVER (PARTITION BY arm) AS r{i}" for i, t in enumerate(TOPICS))
    shares = ", ".join(f"greatest(c{i} / {window}.0, 0.0001) AS q{i}, greatest(r{i} / {window}.0, 0.0001) AS p{i}" for i in range(5))
    return f"""SELECT arm, n, request_index, {_TERMS} AS psi FROM (SELECT *, {shares} FROM (SELECT * {counts} FROM
  (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY request_index) AS n FROM requests) WINDOW w AS (PARTITION BY arm ORDER BY request_index ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))
  WHERE n >= {2 * window} AND n % {stride} = 0)"""


@query(oracle(f"SELECT arm, n, request_index, round(psi, 6) AS psi FROM ({psi_sql(100, 25)})"))
def psi_drift_monitor(spark, sf):
    df = seqtest.psi_path(requests(spark, sf), ["arm"], "request_index", "topic", TOPICS, 100, 25)
    return df.select(F.col("arm").cast("long"), F.col("n").cast("long"), "request_index", r6("psi"))


STRATA = {"click": 2.0, "error": 2.5, "purchase": 3.0, "signup": 3.5, "view": 4.0}
_H = "CASE topic " + " ".join(f"WHEN '{t}' THEN {h}" for t, h in STRATA.items()) + " END"


@query(oracle("").rstrip() + f", {CUSUM_SQL} SELECT topic, min(n) FILTER (WHERE stat >= h) AS alarm_n, min(request_index) FILTER (WHERE stat >= h) AS alarm_at, round(least(max(stat / h), 1.0), 6) AS level FROM (SELECT *, {_H} AS h FROM cusum) GROUP BY topic")
def stratified_cusum(spark, sf):
    return seqtest.stratified_cusum(win_stream(spark, sf), "topic", "request_index", 0.5, 0.45, STRATA).select("topic", "alarm_n", "alarm_at", r6("level"))


@query(oracle("").rstrip() + f", {CUSUM_SQL} SELECT CAST(max(CAST(stat >= h AS INTEGER)) AS INTEGER) AS family_alarm, count(DISTINCT topic) FILTER (WHERE stat >= h) AS topics_alarmed FROM (SELECT *, {_H} AS h FROM cusum)")
def family_alarm(spark, sf):
    per = seqtest.stratified_cusum(win_stream(spark, sf), "topic", "request_index", 0.5, 0.45, STRATA)
    return per.agg(F.max(F.col("alarm_n").isNotNull().cast("int")).alias("family_alarm"), F.count("alarm_n").alias("topics_alarmed"))


@query(oracle("").rstrip() + f", armed AS (SELECT w.request_index, w.win, r.arm FROM wins w JOIN requests r USING (request_index)), counted2 AS (SELECT arm AS topic, request_index, win, count(*) OVER w AS n, CAST(sum(win) OVER w AS BIGINT) AS s FROM armed WINDOW w AS (PARTITION BY arm ORDER BY request_index)), {MIX_SQL.replace('FROM counted ', 'FROM counted2 ')} SELECT topic AS arm, min(n) FILTER (WHERE log_mix >= ln(80.0)) AS reject_n, min(request_index) FILTER (WHERE log_mix >= ln(80.0)) AS reject_at FROM mixed GROUP BY topic")
def multi_arm_monitor(spark, sf):
    arms = requests(spark, sf).select("request_index", F.col("arm").cast("long").alias("arm"))
    return folds.promoted_arms(win_stream(spark, sf).join(arms, "request_index"), 0.44, 0.05)


@query(oracle(f"SELECT r.request_index, coalesce(c.share, 0.0) AS share, CAST({U('__canary__', index='r.request_index')} < coalesce(c.share, 0.0) AS INTEGER) AS canary FROM requests r ASOF LEFT JOIN (SELECT request_index, topic, (request_index // 100 % 4 + 1) / 8.0 AS share FROM requests WHERE request_index % 100 = 0) c ON r.topic = c.topic AND r.request_index >= c.request_index"))
def as_of_share(spark, sf):
    r = requests(spark, sf)
    updates = r.filter("request_index % 100 = 0").select("topic", "request_index", ((F.floor(F.col("request_index") / 100) % 4 + 1) / 8.0).alias("share"))
    df = traffic.as_of(r, updates, ["topic"], "request_index", "share", 0.0)
    return df.select("request_index", "share", (uniform(SEED, "request_index", "__canary__") < F.col("share")).cast("int").alias("canary"))


# --- event log ----------------------------------------------------------------------------


def _events(spark, sf):
    r = requests(spark, sf).withColumn("query_id", F.format_string("q%05d", F.col("request_index") % 50))
    out = log.to_events(r, "run-1", "request_received", ["request_index", "query_id", "topic"])
    return out.unionByName(log.to_events(verdicts(spark, sf), "run-1", "verdict_recorded", ["request_index", "winner", "first_shown", "topic"]))


LOGGED = """logged AS (SELECT request_index * 10 AS seq, 'request_received' AS type FROM requests UNION ALL SELECT request_index * 10 + 5, 'verdict_recorded' FROM verdicts)"""


@query(oracle("").rstrip() + f", {LOGGED} SELECT type, count(*) AS n, max(seq) AS max_seq FROM logged GROUP BY type")
def idempotent_append(spark, sf):
    """Events delivered twice in one batch, and once more in a batch that comes twice."""
    store, e = log.EventLog(spark, shared_dir(spark)), written(_events(spark, sf))
    store.append(e.unionByName(e))
    store.append(e, "again", 0)
    store.append(e, "again", 0)
    return store.read_all().groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("max_seq"))


@query(oracle("").rstrip() + f", {LOGGED} SELECT 'run-1' AS run_id, max(seq) AS max_seq FROM logged UNION ALL SELECT 'run-2', max(seq) FROM logged WHERE type = 'verdict_recorded'")
def run_index(spark, sf):
    store, e = log.EventLog(spark, shared_dir(spark)), _events(spark, sf)
    store.append(e)
    store.append(e.filter("type = 'verdict_recorded'").withColumn("run_id", F.lit("run-2")))
    return store.run_ids().join(store.max_seqs(), "run_id")


@query(oracle("").rstrip() + f", {LOGGED} SELECT seq, type FROM logged WHERE seq > 1000 ORDER BY seq LIMIT 500")
def log_tail(spark, sf):
    """The page behind the last event up to seq 1000, of a log that was written in order of seq."""
    store = log.EventLog(spark, shared_dir(spark))
    store.append(_events(spark, sf).orderBy("seq"))
    at = store.arrived().filter("seq <= 1000").agg(F.max(F.struct("arrival", "place")).alias("m")).select("m.*").first()
    return store.tail(tuple(at), 500).select("seq", "type")


@query(oracle("SELECT request_index, topic, winner, first_shown FROM verdicts"))
def typed_view(spark, sf):
    return log.typed(_events(spark, sf), "verdict_recorded").select("request_index", "topic", "winner", "first_shown")


@query(oracle("").rstrip() + """, lines AS (
  SELECT sha256('{"type":"request_received","payload":{"query_id":"q' || lpad(CAST(request_index % 50 AS VARCHAR), 5, '0') || '","request_index":' || CAST(request_index AS VARCHAR) || ',"topic":"' || topic || '"}}') AS h FROM requests
), kinds AS (SELECT h, count(*) AS k FROM lines GROUP BY h),
size AS (SELECT greatest(0, CAST(ceil(ln(count(*)) / ln(16)) AS BIGINT) - 1) AS digits FROM kinds),
level1 AS (SELECT substr(h, 1, (SELECT digits FROM size)) AS key, sha256(string_agg(sha256(h || ':' || CAST(k AS VARCHAR)), '' ORDER BY h)) AS h FROM kinds GROUP BY ALL)
SELECT CASE WHEN (SELECT digits FROM size) = 0 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY key)) END AS fingerprint FROM level1""")
def content_fingerprint(spark, sf):
    return metrics.fingerprint(_events(spark, sf), log.DATA_EVENTS)


@query(oracle("""SELECT 1 AS same, CAST((SELECT count(*) FROM verdicts) = 0 AS INTEGER) AS doubled,
    CAST((SELECT count(*) FROM (SELECT request_index, winner FROM verdicts EXCEPT ALL SELECT request_index, CASE WHEN topic = 'click' THEN 'b' ELSE winner END FROM verdicts)) = 0 AS INTEGER) AS altered"""))
def verdict_set_equality(spark, sf):
    """Verdicts against those delivered twice and read back through the log, against doubled and against altered ones."""
    judged = written(verdicts(spark, sf))
    v = judged.select("request_index", "winner")
    e = log.to_events(judged, "run-1", "verdict_recorded", ["request_index", "winner", "first_shown", "topic"])
    back = written(log.typed(log.fresh(e.unionByName(e), e.limit(0)), "verdict_recorded").select("request_index", "winner", "topic"))
    altered = back.withColumn("winner", F.when(F.col("topic") == "click", "b").otherwise(F.col("winner")))
    same = [int(metrics.same_multiset(v, other.select("request_index", "winner"))) for other in (back, v.unionByName(v), altered)]
    return spark.createDataFrame([tuple(same)], "same int, doubled int, altered int")


# --- scalar functions ---------------------------------------------------------------------


@query("SELECT doc_id, round(w * 0.85 + (1 - w) * 0.15, 6) AS observed, round((w - 0.15) / 0.7, 6) AS true_rate, round(2 * 0.85::DOUBLE - 1, 6) AS attenuation, round(1 / (0.25::DOUBLE * (1 - 0.1::DOUBLE)), 6) AS requests_per_verdict FROM (SELECT doc_id, (doc_id % 101) / 101.0 AS w FROM documents)")
def channel_functions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 101 / 101.0).alias("w"))
    w, judge = F.col("w"), JudgeChannel(0.85, 0.25, 0.1)
    return d.select("doc_id", F.round(judge.observed(w), 6).alias("observed"), F.round(judge.true(w), 6).alias("true_rate"), F.round(F.lit(judge.attenuation), 6).alias("attenuation"), F.round(F.lit(judge.requests_per_verdict), 6).alias("requests_per_verdict"))


@query("SELECT k, round(sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1)) * pow(0.85, i) * pow(0.15, k - i)), 9) AS accuracy FROM (VALUES (1), (3), (5), (7)) t(k), range(8) r(i) WHERE i > k // 2 AND i <= k GROUP BY k")
def majority_accuracy(spark, sf):
    rows = [(k, mathx.majority_accuracy(0.85, k)) for k in (1, 3, 5, 7)]
    return spark.createDataFrame(rows, "k int, accuracy double").select("k", F.round("accuracy", 9).alias("accuracy"))
