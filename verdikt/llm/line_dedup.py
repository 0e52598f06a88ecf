"""Line dedup over levelled sorted runs (DataFrame operations only).

A *run* is a table of the line keys one batch brought first, bucketed and sorted
by key. A new batch is grouped by key, merge-anti-joined with the runs, and what
is left becomes a run of level 0; once a level holds ``fanout`` runs they are
compacted into one run of the next. Runs are bucketed alike, so a batch shuffles
its own keys only; a run moves when it is compacted, once a level.

Batches arrive in ascending order of documents, so the first document of a key
within the batch that brings it is the first of all. Both joins of a batch are
free of hot keys: one has a row per key, the other joins on key and document.

Defined cases: a null or empty text is one empty line; rows of equal ``doc_id``
are one document; null ``doc_id`` counts as one last document. An empty table
gives an empty result. Keys are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, SPACE_CHARS, ascii_lower, documents, shared_dir, text_of, written

KEY = ["h1", "h2"]


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(dk, th, idx, h1, h2) of every line whose key has at least min_chars code points."""
    rows = docs.select(
        F.coalesce(docs["doc_id"], F.lit(LAST)).alias("dk"),
        F.xxhash64(text_of(docs)).alias("th"),
        F.split(text_of(docs), "\n", -1).alias("lines"),
    )
    lines = rows.select("dk", "th", F.posexplode("lines").alias("idx", "line"))
    keys = lines.select("dk", "th", "idx", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS))).alias("key"))
    return keys.filter(F.char_length("key") >= min_chars).select(
        "dk", "th", "idx", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")
    )


class LineRuns:
    """The runs of all batches so far. ``add`` decides a batch against them."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"verdikt_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        path = shared_dir(self.spark)  # the table's files outlive the executor that wrote them
        run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        return table

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of ``line_keys``; returns (dk, th, idx) of the lines to drop, written."""
        first = lines.groupBy(*KEY).agg(F.min("dk").alias("first"))
        for table in [t for level in self.levels for t in level]:
            first = first.join(self.spark.table(table), KEY, "left_anti")
        fresh = self.spark.table(self._write(first, 0))
        drops = written(
            lines.join(fresh.withColumnRenamed("first", "dk"), [*KEY, "dk"], "left_anti").select("dk", "th", "idx")
        )
        self._compact()
        return drops

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                merged = reduce(DataFrame.unionByName, [self.spark.table(t) for t in old])
                self._write(merged.repartition(self.buckets, *KEY), level + 1)
                for t in old:
                    self.spark.sql(f"DROP TABLE {t}")

    def close(self) -> None:
        for t in [t for level in self.levels for t in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = [[]]


def line_dedup(docs: DataFrame, batches: int = 4, min_chars: int = 10, fanout: int = 3) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped of every row of docs."""
    spark = docs.sparkSession
    cuts = docs.select(
        F.percentile_approx(F.coalesce("doc_id", F.lit(LAST)), F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(1000)).alias("c")
    ).first()["c"]
    cuts = sorted(set(cuts or []))
    batch = reduce(lambda a, c: a + (F.col("dk") > c).cast("int"), cuts, F.lit(0))
    lines = written(line_keys(docs, min_chars).withColumn("batch", batch), "batch")
    runs = LineRuns(spark, fanout)
    try:
        drops = [runs.add(lines.filter(F.col("batch") == b).drop("batch")) for b in range(len(cuts) + 1)]
    finally:
        runs.close()
    dropped = reduce(DataFrame.unionByName, drops).groupBy("dk", "th").agg(F.collect_set("idx").alias("d"))
    rows = docs.select(
        docs["doc_id"],
        F.coalesce(docs["doc_id"], F.lit(LAST)).alias("dk"),
        F.xxhash64(text_of(docs)).alias("th"),
        F.split(text_of(docs), "\n", -1).alias("lines"),
    )
    out = rows.join(dropped, ["dk", "th"], "left")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("d")), lambda i: F.get(F.col("lines"), i)
    )
    return out.select(
        "doc_id",
        F.array_join(F.when(F.col("d").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("d"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    n = F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(0).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.idx, k.line, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
