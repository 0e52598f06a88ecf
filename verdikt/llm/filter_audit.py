"""Filter interaction audit: what each filter of a chain removes, in every order (DataFrame and SQL only).

One pass over the documents sets five failure flags. Rows are counted by part and flags
first, a few hundred rows a source at most, so the CUBE that follows expands counts and not
documents. A grouping set of the cube names a subset of flags; its row in which all of them
are false counts the survivors of that subset. A step of an order is a pair of subsets, what
came before and that plus its filter, so its figures are differences of two survivors, which
two joins bring together.

Copies are found by two 64-bit hashes of the text: the least doc_id of each repeated text is
grouped first, and only texts that repeat are joined back.

Defined cases: a null text is empty; a null source is the part ''; an empty text has no words,
so it fails A, and neither B nor C; a null doc_id stands after all others, and equal doc_ids are
no smaller than each other; of several labels of a document the greatest counts, labels of null
doc_ids count for none; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, UPPER, WORD, documents, text_of, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ["n", "good", "toxic"]


def failures(docs: DataFrame, min_words: int = 200, min_distinct: int = 50, max_upper: int = 2, marks: str = r"[#$%&*|]") -> DataFrame:
    """doc_id, part and the flags A to E of every row of docs; min_distinct and max_upper are percentages."""
    rows = docs.select(
        docs["doc_id"], F.coalesce(docs["source"], F.lit("")).alias("part"), F.coalesce(docs["doc_id"], F.lit(LAST)).alias("k"), text_of(docs).alias("text")
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    words, chars = F.size("words"), F.char_length("text")
    upper = chars - F.char_length(F.translate("text", UPPER, ""))
    flags = rows.select(
        "doc_id",
        "part",
        "k",
        F.xxhash64(F.lit(1), "text").alias("h1"),
        F.xxhash64(F.lit(2), "text").alias("h2"),
        (words < min_words).alias("A"),
        (100 * F.size(F.array_distinct("words")) < min_distinct * words).alias("B"),
        (100 * upper > max_upper * chars).alias("C"),
        F.col("text").rlike(marks).alias("D"),
    )
    # written, so that the join stands on two plain exchanges, of which Spark splits those of a hot text
    firsts = written(flags.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    return flags.join(firsts, ["h1", "h2"], "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("k"), F.lit(False)).alias("E"))


def subset_survivors(flagged: DataFrame) -> DataFrame:
    """part, subset (bit i for filter i), n, good, toxic: the rows that fail no filter of the subset.

    flagged: part, A to E, good, toxic (0 or 1). Subsets that nothing survives have no row.
    """
    counted = flagged.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = counted.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_{f}") for f in FILTERS])
    # in a row of a grouping set the flags outside it are null, and those inside must be false
    none_fails = ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FILTERS])
    subset = sum(((1 - F.col(f"_{f}")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return cube.filter((F.col("_all") == 0) & none_fails).select("part", subset.cast("int").alias("subset"), *COUNTS)


def order_steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, subset before, subset after) of all orders."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), k + 1, f, sum(bit[x] for x in p[:k]), sum(bit[x] for x in p[: k + 1])) for p in permutations(FILTERS) for k, f in enumerate(p)]


def audit(flagged: DataFrame) -> DataFrame:
    """A row for each part, order and step with what its filter does there; see subset_survivors."""
    spark = flagged.sparkSession
    # a row a part and subset, 32 times the parts at most; written, as it is read five times
    there = written(subset_survivors(flagged))
    steps = spark.createDataFrame(order_steps(), "filter_order string, step int, filter string, before int, after int")
    steps = steps.withColumn("others", ALL - F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), F.col("filter")))

    def survivors(name: str) -> DataFrame:
        return there.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])

    # the empty subset is what every part has, and every order's first step starts from it
    parts = there.filter("subset = 0").select("part", F.col("n").alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("before"))
    df = parts.join(F.broadcast(steps), "before")  # 600 rows
    for name in ("before", "after"):
        df = df.join(survivors(name), ["part", name], "left")
    df = df.join(survivors("others").select("part", "others", "others_n"), ["part", "others"], "left")
    rest = there.filter(F.col("subset") == ALL).select("part", F.col("n").alias("rest"))
    own = there.select("part", F.col("n").alias("own"), (ALL - F.col("subset")).alias("others"))
    df = df.join(rest, "part", "left").join(own, ["part", "others"], "left")

    def left(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    removed = left("before_n") - left("after_n")
    df = df.select(
        "part",
        "filter_order",
        "step",
        "filter",
        left("after_n").alias("kept"),
        removed.alias("removed"),
        (F.col("rows") - left("own") - removed).alias("redundant"),
        (left("others_n") - left("rest")).alias("unique_fails"),
        (left("before_good") - left("after_good")).alias("good_lost"),
        (left("before_toxic") - left("after_toxic")).alias("toxic_lost"),
    )
    shapley = df.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return df.join(shapley, ["part", "filter"]).select(*[c for c in df.columns if c != "filter"], "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.groupBy(labels["doc_id"].alias("label_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    flagged = failures(documents(spark, sf_dir))
    flagged = flagged.join(labels, flagged["doc_id"] == labels["label_id"], "left")
    one = lambda c: F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))
    return audit(flagged.select("part", *FILTERS, one("quality").alias("good"), one("toxic").alias("toxic")))


OP13_SQL = r"""
WITH words AS (
  SELECT *, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), firsts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1
), marked AS (
  SELECT coalesce(d.source, '') AS part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * len(d.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN f.first < d.doc_id THEN 'E' ELSE '' END AS fails,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM words d JOIN firsts f ON d.t = f.t
  LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM marked GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)
), seen AS (
  SELECT c.*, o, s, f, contains(c.fails, f) AS fails_it,
         earlier <> '' AND len(translate(c.fails, earlier, '')) < len(c.fails) AS gone
  FROM counted c, steps
), steps_of AS (
  SELECT part, o AS filter_order, s::INTEGER AS step, f,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM steps_of
"""
