"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius: itself and,
for radius 2, its 64 one-bit neighbours. Two fingerprints within the radius share
a variant, so a shuffle on variants brings all links together. The fingerprints at
one variant lie in a ball of at most 65 (radius 2), whatever the input holds, and
any two of them are within the radius: linking each to the least of the ball loses
no connection. Links are deduplicated and verified by counting differing bits, and
connected components run over distinct fingerprints, so copies cost one row each.

Defined cases: null and wordless texts have fingerprint zero, linked like any
other; rows of equal doc_id are rows of their own; a component whose doc_ids are
all null has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, free_name, ship, text_of, written
from .components import components

BITS = 64
#: Words hashed before the bit counts are added up, which bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles."""
    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    joined, ends = b" ".join(tokens), ends.tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        last = ends[words - 1 + at : words - 1 + stop] or ends[-1:]
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at:stop], last)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): fp is the unsigned fingerprint's bits as a long; th a hash of the text."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64(text_of(docs)).alias("th"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def ball(fp: str, radius: int) -> Column:
    """All variants of fp within radius bits."""
    out = F.array(F.col(fp))
    for _ in range(radius):
        flips = F.transform(out, lambda x: F.concat(F.array(x), *[F.array(x.bitwiseXOR(F.lit(np.int64(np.uint64(1 << i)).item()))) for i in range(BITS)]))
        out = F.array_distinct(F.flatten(flips))
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between the distinct fingerprints of column fp, connecting just those within the radius."""
    if radius % 2:
        raise ValueError("the radius is halved: it must be even")
    # dealt out first, as the table of distinct fingerprints may be a few files
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = distinct.select("fp").repartition(n, "fp").select("fp", F.explode(ball("fp", radius // 2)).alias("variant"))
    least = variants.withColumn("least", F.min("fp").over(W.partitionBy("variant"))).filter("fp <> least")
    pairs = least.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row of docs."""
    fps = written(fingerprints(docs))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps.join(nodes.join(ids, "root").select("fp", "component_id"), "fp")


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs with one row of each group of near duplicates: the least doc_id, then the least text hash."""
    near = near_duplicates(docs, radius)
    # of a group with null doc_ids only, and of repeated rows, the least text hash stays
    best = near.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("k")
    )
    return first_rows(docs, best.select("k.doc_id", "k.th").distinct())


def first_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, th) of keep; th is the hash of the text."""
    d, t, h, n = (free_name(docs, c) for c in ("_d", "_t", "_h", "_n"))
    keep = keep.toDF(d, t)
    rows = docs.withColumn(h, F.xxhash64(text_of(docs)))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep[d]) & (rows[h] == keep[t]), "left_semi")
    first = W.partitionBy("doc_id", h).orderBy(F.lit(0))
    return rows.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
