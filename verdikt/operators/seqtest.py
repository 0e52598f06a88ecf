"""Sequential tests as window expressions.

A stream has a key, an order column (an integer, as request_index is) and a 0/1 column
``win``. Running integer counts come first; statistics are closed forms of them.

No stream is one task: it is cut into blocks of ``SPAN`` order values. Windows run within
a block, a row a block sums it up, and what the blocks before add is a window over those few
rows. Both uses of the stream take the same columns, so that Spark runs their exchange once.
Rows with a null key or order belong to no stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mathx import SprtDesign, betaln, log_upper_mass, normal_quantile


#: Order values of a block.
SPAN = 1 << 17


def _blocks(stream: DataFrame, key: list[str], order: str, more: Sequence[str] = ()) -> DataFrame:
    rows = stream.select(*key, *more, order, F.col("win").cast("long").alias("win"), F.floor(F.col(order) / SPAN).alias("_block"))
    return rows.dropna(subset=[*key, order])


def _within(key: list[str], order: str):
    return W.partitionBy(*key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def _before(key: list[str]):
    return W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)


def _carried(local: DataFrame, key: list[str], sums: dict[str, Column]) -> DataFrame:
    """local plus what the blocks before each block add up to, by the expressions ``sums`` of a block."""
    made = local.groupBy(*key, "_block").agg(*[c.alias(n) for n, c in sums.items()])
    zero = {n: F.coalesce(F.sum(n).over(_before(key)), F.lit(0)) for n in sums}
    return local.join(made.withColumns({f"_{n}": c for n, c in zero.items()}).drop(*sums), [*key, "_block"])


def _counted(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    w = _within(key, order)
    local = _blocks(stream, key, order).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("win").over(w))
    df = _carried(local, key, {"bn": F.max("n"), "bs": F.max("s")})
    return df.withColumns({"n": F.col("n") + F.col("_bn"), "s": F.col("s") + F.col("_bs")}).drop("_bn", "_bs")


def running(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, order, win, n, s: verdicts and wins so far."""
    return _counted(stream, key, order).drop("_block")


def _log_ratio(p0: float | str, p1: float | str, n: str = "n", s: str = "s") -> Column:
    if isinstance(p0, str):
        a, b = F.col(p0), F.col(p1)
        win, loss = F.log(b / a), F.log((1 - b) / (1 - a))
    else:
        win, loss = F.lit(math.log(p1 / p0)), F.lit(math.log((1 - p1) / (1 - p0)))
    return F.col(s) * win + (F.col(n) - F.col(s)) * loss


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series (to 14 digits), below 16 by that of x + 16."""

    def stirling(z: Column) -> Column:
        y = 1 / (z * z)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / z

    x = x.cast("double")
    steps = F.lit(0.0)
    for i in range(0, 16, 4):  # four factors a logarithm: no product overflows
        steps = steps + F.log((x + i) * (x + (i + 1)) * (x + (i + 2)) * (x + (i + 3)))
    return F.when(x < 16, stirling(x + 16) - steps).otherwise(stirling(x))


def sprt(stream: DataFrame, key: list[str], order: str, design: SprtDesign) -> DataFrame:
    """key, decision (1 H1, -1 H0, 0 censored), stop (n at the decision, or all)."""
    df = running(stream, key, order).withColumn("llr", _log_ratio(design.p0, design.p1))
    up, down = F.min(F.when(F.col("llr") >= design.upper, F.col("n"))), F.min(F.when(F.col("llr") <= design.lower, F.col("n")))
    out = df.groupBy(*key).agg(up.alias("up"), down.alias("down"), F.max("n").alias("n"))
    never = F.lit(1 << 62)
    first_up, first_down = F.coalesce("up", never), F.coalesce("down", never)
    decision = F.when(first_up < first_down, 1).when(first_down < first_up, -1).otherwise(0)
    return out.select(*key, decision.alias("decision"), F.least(first_up, first_down, F.col("n")).alias("stop"))


def cusum_path(stream: DataFrame, key: list[str], order: str, p0: float | str, p1: float | str) -> DataFrame:
    """key, order, win, n, s, stat: Page's recursion max(0, stat + step) as the walk above its running minimum.

    The rates are numbers, or columns of the stream that are the same for all rows of a key.
    """
    rates = [c for c in (p0, p1) if isinstance(c, str)]
    if not rates and not 0 < p1 < p0 < 1:
        raise ValueError("a drop is looked for: 0 < p1 < p0 < 1")
    w = _within(key, order)
    local = _blocks(stream, key, order, rates).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("win").over(w))
    local = local.withColumn("least", F.min(_log_ratio(p0, p1)).over(w))
    # of a block: its counts, and the lowest point of its own walk
    made = local.groupBy(*key, "_block").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.min("least").alias("least"), *[F.first(c).alias(c) for c in rates])
    before = _before(key)
    made = made.withColumns({"_n": F.coalesce(F.sum("n").over(before), F.lit(0)), "_s": F.coalesce(F.sum("s").over(before), F.lit(0))})
    made = made.withColumn("_walk", _log_ratio(p0, p1, "_n", "_s"))
    made = made.withColumn("_least", F.min(F.col("_walk") + F.col("least")).over(before)).drop("n", "s", "least", *rates)
    df = local.join(made, [*key, "_block"]).withColumns({"n": F.col("n") + F.col("_n"), "s": F.col("s") + F.col("_s")})
    low = F.least(F.lit(0.0), F.col("_walk") + F.col("least"), F.col("_least"))  # least skips nulls
    return df.withColumn("stat", _log_ratio(p0, p1) - low).drop("_block", "_n", "_s", "_walk", "_least", "least", *rates)


def cusum(stream: DataFrame, key: list[str], order: str, p0: float | str, p1: float | str, h: float) -> DataFrame:
    """key, alarm_n, alarm_at (order value) of the first alarm, null without one, and max_stat."""
    if h <= 0:
        raise ValueError("the threshold must be positive")
    hit = F.col("stat") >= h
    df = cusum_path(stream, key, order, p0, p1)
    return df.groupBy(*key).agg(F.min(F.when(hit, F.col("n"))).alias("alarm_n"), F.min(F.when(hit, F.col(order))).alias("alarm_at"), F.max("stat").alias("max_stat"))


def mixture_sprt_path(stream: DataFrame, key: list[str], order: str, p0: float, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """key, order, win, n, s, log_mix: ln of the mixture ratio under a Beta(a, b) prior cut to rates above p0.

    The mass that Beta(a + s, b + f) has above p0 changes by one term a verdict (the contiguous
    relations of the incomplete beta function), so it is a running sum. While wins are no more
    frequent than p0 the ratio is below 1, and the sum may have lost all its digits: log_mix is
    null there.
    """
    if not (a > 0 and b > 0 and 0 < p0 < 1):
        raise ValueError("a > 0, b > 0 and 0 < p0 < 1 are needed")
    n, s, f, won = F.col("n"), F.col("s"), F.col("n") - F.col("s"), F.col("win") == 1
    # ln of x^a' (1 - x)^b' / B(a' + 1, b' + 1) and its like: the beta functions of all counts share these three
    gs, gf, gn = _log_gamma(s + a), _log_gamma(f + b), _log_gamma(n + (a + b))
    # from (a + s - 1, b + f) by a win, from (a + s, b + f - 1) by a loss
    change = F.exp(gn - gs - gf + (s + a - won.cast("int")) * math.log(p0) + (f + b - (~won).cast("int")) * math.log1p(-p0)) / (n + (a + b - 1))
    start = math.exp(log_upper_mass(a, b, p0))
    df = _counted(stream, key, order).withColumn("term", F.when(won, change).otherwise(-change))
    df = _carried(df.withColumn("sum", F.sum("term").over(_within(key, order))), key, {"bt": F.sum("term")})
    mass = start + F.col("_bt") + F.col("sum")
    mix = gs + gf - gn - betaln(a, b) + F.log(mass) - math.log(start) - s * math.log(p0) - f * math.log1p(-p0)
    return df.withColumn("log_mix", F.when((mass > 0) & (s > p0 * n), mix)).drop("_block", "term", "sum", "_bt")


def mixture_sprt(stream: DataFrame, key: list[str], order: str, p0: float, alpha: float, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """key, reject_n, reject_at of the first crossing of ln(1 / alpha), null without one."""
    hit = F.col("log_mix") >= math.log(1 / alpha)
    path = mixture_sprt_path(stream, key, order, p0, a, b)
    return path.groupBy(*key).agg(F.min(F.when(hit, F.col("n"))).alias("reject_n"), F.min(F.when(hit, F.col(order))).alias("reject_at"))


def stitched_radius(n: Column, alpha: float) -> Column:
    n = n.cast("double")
    return 1.7 * 0.5 * F.sqrt((F.log(F.log(2 * n)) + 0.72 * math.log(5.2 / alpha)) / n)


def stitched_sequence(stream: DataFrame, key: list[str], order: str, p0: float, alpha: float) -> DataFrame:
    """key, reject_n: the first n at which the time-uniform interval stands above p0."""
    df = running(stream, key, order)
    hit = F.col("s") / F.col("n") - p0 > stitched_radius(F.col("n"), alpha)
    return df.groupBy(*key).agg(F.min(F.when(hit, F.col("n"))).alias("reject_n"))


def naive_peeking(stream: DataFrame, key: list[str], order: str, alpha: float = 0.05, every: int = 100) -> DataFrame:
    """key, tripped, max_z: a z-test against one half repeated at every ``every`` verdicts."""
    z = F.abs(F.col("s") / F.col("n") - 0.5) / F.sqrt(0.25 / F.col("n"))
    df = running(stream, key, order).filter(F.col("n") % every == 0)
    return df.groupBy(*key).agg(F.max(z).alias("max_z")).withColumn("tripped", (F.col("max_z") > normal_quantile(1 - alpha / 2)).cast("int"))


def numbered(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """stream plus n, the place of each row in its stream."""
    rows = stream.withColumn("_block", F.floor(F.col(order) / SPAN)).dropna(subset=[*key, order])
    local = rows.withColumn("n", F.row_number().over(W.partitionBy(*key, "_block").orderBy(order)).cast("long"))
    return _carried(local, key, {"bn": F.max("n")}).withColumn("n", F.col("n") + F.col("_bn")).drop("_bn", "_block")


def _halos(rows: DataFrame, back: int, ahead: int) -> DataFrame:
    """rows dealt into stretches of n (_at), each with the rows just before and after it; own says whose rows they are."""
    size = max(SPAN, 4 * (back + ahead))
    at = lambda n: F.floor(n / size)
    n = F.col("n")
    stretches = F.array_distinct(F.array(at(n), at(F.greatest(n - ahead, F.lit(0))), at(n + back)))
    return rows.withColumn("_at", F.explode(stretches)).withColumn("_own", F.col("_at") == at(n))


def rolling_mean(stream: DataFrame, key: list[str], order: str, value: str, window: int, centred: bool = False) -> DataFrame:
    """Means over full windows of rows; each stands at its last row, or at its centre."""
    back = window // 2 if centred else window - 1
    ahead = window - 1 - back
    rows = _halos(numbered(stream.select(*key, order, value), key, order), back, ahead)
    w = W.partitionBy(*key, "_at").orderBy("n").rowsBetween(-back, ahead)
    df = rows.withColumn("mean", F.avg(value).over(w)).withColumn("_full", F.count(F.lit(1)).over(w))
    return df.filter((F.col("_full") == window) & F.col("_own")).select(*key, order, "mean")


def rolling_alarm(stream: DataFrame, key: list[str], order: str, value: str, window: int, threshold: float) -> DataFrame:
    """key, alarm_n, alarm_at of the first trailing mean at or above the threshold: the rows seen by then."""
    means = numbered(rolling_mean(stream, key, order, value, window), key, order)
    hit = F.col("mean") >= threshold
    return means.groupBy(*key).agg((F.min(F.when(hit, F.col("n"))) + window - 1).alias("alarm_n"), F.min(F.when(hit, F.col(order))).alias("alarm_at"))


def psi_path(stream: DataFrame, key: list[str], order: str, category: str, categories: list[str], window: int, stride: int, floor: float = 1e-4) -> DataFrame:
    """key, n, order value, psi at each check: the first ``window`` rows are the reference, then
    the trailing window is compared whenever it is full and n is a multiple of stride."""
    ks = range(len(categories))
    one = [(F.col(category) == c).cast("long") for c in categories]
    rows = numbered(stream.select(*key, order, category), key, order)
    reference = rows.filter(F.col("n") <= window).groupBy(*key).agg(*[F.sum(one[i]).alias(f"r{i}") for i in ks])
    w = W.partitionBy(*key, "_at").orderBy("n").rowsBetween(-(window - 1), 0)
    df = _halos(rows, window - 1, 0).withColumns({f"c{i}": F.sum(one[i]).over(w) for i in ks})
    df = df.filter(F.col("_own") & (F.col("n") >= 2 * window) & (F.col("n") % stride == 0)).join(reference, key)
    share = lambda c: F.greatest(F.col(c) / float(window), F.lit(floor))
    q_all, p_all = sum((share(f"c{i}") for i in ks), F.lit(0.0)), sum((share(f"r{i}") for i in ks), F.lit(0.0))
    total = F.lit(0.0)
    for i in ks:
        q, p = share(f"c{i}") / q_all, share(f"r{i}") / p_all
        total = total + (q - p) * F.log(q / p)
    return df.select(*key, "n", order, total.alias("psi"))


def stratified_cusum(stream: DataFrame, by: str, order: str, p0: float, p1: float, thresholds: dict[str, float]) -> DataFrame:
    """by, alarm_n, alarm_at, level (the highest statistic as a share of its own threshold, 1 at most), one test a stratum."""
    h = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    df = cusum_path(stream, [by], order, p0, p1).withColumn("h", h[F.col(by)]).filter("h IS NOT NULL")
    hit = F.col("stat") >= F.col("h")
    level = F.least(F.max(F.col("stat") / F.col("h")), F.lit(1.0)).alias("level")
    return df.groupBy(by).agg(F.min(F.when(hit, F.col("n"))).alias("alarm_n"), F.min(F.when(hit, F.col(order))).alias("alarm_at"), level)


def first_crossings(df: DataFrame, key: list[str], order: str, hit: Column) -> DataFrame:
    """The first row of each key at which hit holds."""
    rest = [c for c in df.columns if c not in key]
    return df.filter(hit).groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*df.columns)
