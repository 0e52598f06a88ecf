"""Document fingerprints by order MinHash.

A text's k-mers are its ``K``-byte windows, each numbered by its occurrence. For each
of ``SKETCHES`` hash functions the ``PICKS`` numbered k-mers of least hash are taken,
put back in text order, and the tuple of their k-mers hashed to 16 bits. Two texts
agree at a sketch about as often as they share both the k-mers and their order, so
the share of agreeing sketches follows edit distance, not just common words.

Defined cases: null text is empty; the empty text has a fingerprint of its own, a
text shorter than a window is one k-mer; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, ship, text_of, written

K, SKETCHES, PICKS = 8, 64, 2
#: Hashes worked on at once, which bounds memory for very long texts.
CELLS = 1 << 21
_U = np.uint64
_POSITION = 24


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _salts(n: int, seed: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    n = len(h)
    if n <= 1 << _POSITION:  # value and place in one word sort faster than an argsort
        packed = np.sort((h >> _U(_POSITION) << _U(_POSITION)) | np.arange(n, dtype=np.uint64))
        place, value = (packed & _U((1 << _POSITION) - 1)).astype(np.int64), packed >> _U(_POSITION)
    else:
        place = np.argsort(h, kind="stable")
        value = h[place]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    at = np.arange(n)
    out = np.empty(n, np.uint64)
    out[place] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return out


def fingerprint(text: bytes, seed: int = 11) -> np.ndarray:
    """SKETCHES values of 16 bits."""
    if not text:
        return np.zeros(SKETCHES, np.uint16)
    if len(text) < K:
        kmers = np.array([int.from_bytes(text, "little") | len(text) << 56], np.uint64)
    else:
        kmers = np.ndarray((len(text) - K + 1,), "<u8", text, 0, (1,)).copy()
    h = mix64(kmers)
    keys = (mix64(h + occurrences(h) * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32)
    n, salts = len(keys), _salts(SKETCHES, seed)
    picks = min(PICKS, n)
    at = np.empty((SKETCHES, picks), np.int64)
    step = max(1, CELLS // n)
    for i in range(0, SKETCHES, step):
        s = salts[i : i + step, None]
        hashed = (keys[None, :] ^ (s >> np.uint32(7))) * s
        rows = np.arange(len(s))
        for j in range(picks):
            at[i : i + step, j] = best = hashed.argmin(axis=1)
            hashed[rows, best] = 0xFFFFFFFF
    at.sort(axis=1)
    value = np.full(SKETCHES, seed, np.uint64)
    for j in range(picks):
        value = mix64(value * _U(3) + h[at[:, j]])
    return (value >> _U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of agreeing sketches."""
    return float(np.count_nonzero(a == b)) / SKETCHES


def as_hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def from_hex(f: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(f), ">u2").astype(np.uint16)


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of ``after``."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [as_hex(fingerprint(t or b"")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(prints, pa.string())], [*b.schema.names[:-1], "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fingerprint string")


ROW = "part int, row long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _compared(part: int, row: int, doc_id: int | None, text: str, own: np.ndarray, after: str, next_print: np.ndarray) -> tuple:
    new = edited(text, after).encode()
    e = fingerprint(new)
    return (part, row, doc_id, len(text), hashlib.sha256(new).hexdigest(), as_hex(own), as_hex(e), likeness(own, e), likeness(own, next_print), None)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each compared with the next. The last of the part, whose next is
    the first of another, and the first are also given with their texts."""
    names = [c.split(" ")[0] for c in ROW.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, ROW.split(", "))])
    part, row, before = TaskContext.get().partitionId(), 0, None
    for b in batches:
        out: list[tuple] = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            own = fingerprint(text.encode())
            if before is None:
                out.append((part, -1, doc_id, len(text), None, as_hex(own), None, None, None, text))
            else:
                out.append(_compared(part, row, *before, text, own))
                row += 1
            before = (doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)
    if before is not None:
        doc_id, text, own = before
        last = (part, row, doc_id, len(text), None, as_hex(own), None, None, None, text)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, schema.types)], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            _compared(r["part"], r["row"], r["doc_id"], r["text"], from_hex(r["fingerprint"]), r["next_text"], from_hex(r["next_fingerprint"]))[2:9]
            for r in b.to_pylist()
        ]
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every row of docs compared with its edited text and with the next document in
    descending order of doc_id (null last, equal ones by text; after the last, the first).

    One range shuffle sorts the texts; a part compares its own rows as they stream by.
    Only the row at the end of a part needs another part's first text: those two rows
    a part are joined afterwards.
    """
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long"), text_of(docs).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    done = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").mapInArrow(_in_order, ROW))
    heads = done.filter("row = -1")
    parts = heads.select("part").withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("part")))
    parts = parts.withColumn("of", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).withColumn("next_k", F.pmod(F.col("k"), F.col("of")) + 1)
    heads = heads.join(parts.select("part", F.col("k").alias("next_k")), "part").select("next_k", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = done.filter("row >= 0 AND text IS NOT NULL").join(parts.select("part", "next_k"), "part").join(heads, "next_k")
    ends = tails.select("part", "row", "doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return done.filter("text IS NULL").select(*RESULT).unionByName(ends.mapInArrow(_joined, kinds))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(documents(spark, sf_dir))
