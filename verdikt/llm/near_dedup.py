"""Near-dedup by SimHash and by the Jaccard similarity of word shingles, for the pipeline.

Texts whose SimHash fingerprints differ in two bits or fewer are linked, by ball hashing.
SimHash puts texts of similarity 0.8 up to a dozen bits apart, which ball hashing does
not reach, so more links are found by MinHash: ``BANDS`` bands of ``ROWS`` minima. A
pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS, which is
0.9999 at 0.8. Candidates are verified by their exact shingle sets, and connected
components run over the distinct texts that are linked.

Of the texts of one band value each is compared with one leader first: the text whose bands
most others share, as the text that near copies were made from, so leaders are the same in most
bands and a group of near copies costs about a pair a text. What is linked by then is a class.
Texts of different classes that share a band value are then all compared, in blocks of about
``BLOCK`` rows, by counts of their shingles' hashes: the sum of the lesser counts is no less than
the number of shingles in common, so a pair that it puts below ``SIMILARITY`` is none. That is
exact, and only the pairs it leaves bring their texts together.

Defined cases: words are lower-cased by A-Z; a text of fewer words than a shingle is one
shingle; wordless and null texts are equal; rows of equal doc_id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_broadcast, ship, text_of, written
from .components import components
from .order_minhash import mix64
from .simhash import fingerprint, first_rows
from .simhash import links as ball_links

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Rows of a block, of which two meet in a task, and the most counts kept of a text.
BLOCK, COUNTS = 256, 1 << 14
#: Hashes worked on at once, which bounds memory for very long texts.
CELLS = 1 << 21
_U = np.uint64
_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + _U(77))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = text.lower().split()
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * _U(3) + w[k : len(w) - size + 1 + k])
    return np.unique(out)


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS minima."""
    least = np.full(BANDS * ROWS, ~_U(0), np.uint64)
    step = max(1, CELLS // len(_SALTS))
    for i in range(0, len(s), step):
        x = (s[None, i : i + step] ^ _SALTS[:, None]) * _U(0x9E3779B97F4A7C15)
        np.minimum(least, (x ^ (x >> _U(32))).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    value = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        value = mix64(value * _U(3) + least[:, k])
    return value


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def counts(s: np.ndarray) -> bytes:
    """How many hashes have each value of the low bits, for about one or two hashes a count; empty if a count passes a byte."""
    size = min(COUNTS, 1 << (len(s).bit_length() - 1))
    c = np.bincount((s & _U(size - 1)).view(np.int64), minlength=size)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def folded(c: np.ndarray, size: int) -> np.ndarray:
    """Rows of counts as ``counts`` makes them by fewer bits."""
    return c if c.shape[1] == size else c.reshape(len(c), -1, size).sum(axis=1, dtype=np.uint32)


def alike(n: np.ndarray, kinds: np.ndarray, side: np.ndarray, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different classes and, if there are two, sides that by their counts may have similarity SIMILARITY."""
    at, size = np.arange(len(n)), np.array(list(map(len, made)))
    tables = {k: np.frombuffer(b"".join(made[i] for i in np.flatnonzero(size == k)), np.uint8).reshape(-1, k) for k in set(size.tolist()) if k}
    row = np.zeros(len(n), np.int64)  # in the table of its size
    for k in tables:
        row[size == k] = np.arange(len(tables[k]))
    fold: dict[tuple[int, int], np.ndarray] = {}
    first, second = [], []
    later = side if side.any() else at
    for i in at.tolist():
        # sets whose sizes differ by more cannot be similar
        others = np.flatnonzero((later > later[i]) & (kinds != kinds[i]) & (np.minimum(n, n[i]) >= SIMILARITY * np.maximum(n, n[i])))
        for k in set(size[others].tolist()):
            same = others[size[others] == k]
            least = min(k, int(size[i]))
            if least:
                for x in (k, int(size[i])):
                    if (x, least) not in fold:
                        fold[x, least] = folded(tables[x], least)
                both = np.minimum(fold[k, least][row[same]], fold[int(size[i]), least][row[i]]).sum(axis=1, dtype=np.int64)
                same = same[both / (n[same] + n[i] - both) >= SIMILARITY]
            first.append(np.full(len(same), i))
            second.append(same)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, made, kept, prints = [], [], [], []
        for text in b.column("text"):  # one at a time: a batch of sets is larger than its texts
            text = text.as_py()
            s = shingles(text)
            n.append(len(s))
            made.append(bands(s))
            kept.append(counts(s))
            prints.append(fingerprint(text))
        flat = np.array(made, np.uint64).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(flat))
        own = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(n, pa.int64()), lists, own, pa.array(kept, pa.binary())], ["th", "n", "bands", "fp", "counts"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of blocks stand together, which may go on in the next batch."""

    def pairs(b: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        th, n, kinds, side = (b.column(c).to_numpy() for c in ("th", "n", "class", "side"))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            i, j = alike(n[a:z], kinds[a:z], side[a:z], b.column("counts").slice(a, z - a).to_pylist())
            u.append(th[a:z][i])
            v.append(th[a:z][j])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    rest = None
    for b in batches:
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        own = b.column("own").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        yield pairs(b, first)
        rest = b.slice(int(first[-1]))
    if rest is not None:
        yield pairs(rest, np.array([0, rest.num_rows]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last, known, near = None, None, []
        for u, x, y in zip(b.column("u").to_pylist(), b.column("tu"), b.column("tv")):
            if u != last:
                last, known = u, shingles(x.as_py())
            near.append(similarity(known, shingles(y.as_py())) >= SIMILARITY)
        keep = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])


def _near(pairs: DataFrame, texts: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Of the pairs (u, v), those of similarity SIMILARITY at least, written. Only texts of pairs move."""
    pairs = written(pairs)
    needed = pairs.select(F.explode(F.array("u", "v")).alias("th")).distinct()
    own = texts.join(bounded_broadcast(needed, max_broadcast), "th", "left_semi")
    side = lambda c: own.select(F.col("th").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "tu", "tv")
    return written(both.mapInArrow(_verified, "u long, v long"))


def _led(rows: DataFrame) -> DataFrame:
    """(u, v): of the texts that share a key, each with the one whose bands most others share."""
    heads = rows.groupBy("key").agg(F.min(F.struct(-F.col("fame"), "th", "n")).alias("lead")).select("key", F.col("lead.th").alias("u"), F.col("lead.n").alias("un"))
    fit = F.least("n", "un") >= SIMILARITY * F.greatest("n", "un")
    met = rows.join(heads, "key").filter("th <> u").filter(fit)
    return met.select(F.greatest("th", "u").alias("u"), F.least("th", "u").alias("v")).distinct()


def _crossing(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(u, v): the texts of different classes that share a key and may be similar by their counts.

    A class of more rows at a key than a block has blocks of its own, which do not meet each
    other; the other rows are dealt over mixed ones, which meet themselves too.
    """
    sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("of")).withColumn("big", F.col("of") > BLOCK)
    mixed = sizes.groupBy("key").agg(F.sum(F.when(F.col("big"), 0).otherwise(F.col("of"))).alias("mixed"))
    rows = rows.join(sizes, ["key", "class"]).join(mixed, "key")
    part = F.pmod(F.xxhash64("th"), F.ceil(F.when(F.col("big"), F.col("of")).otherwise(F.col("mixed")) / BLOCK))
    rows = rows.withColumn("block", F.struct("big", F.when(F.col("big"), F.col("class")).otherwise(0).alias("class"), part.alias("part")))
    blocks = rows.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    rows = rows.join(blocks, "key").select("key", "th", "n", "class", "block", F.explode("blocks").alias("other"))
    rows = rows.filter("NOT (block.big AND other.big AND block.class = other.class)")
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    own = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("own")
    rows = rows.select(own, side, "th", "n", "class").join(made.select("th", "counts"), "th")
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("own", "side", "th", "n", "class", "counts").repartition(n, "own").sortWithinPartitions("own")
    return rows.mapInArrow(_compared, "u long, v long").distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of keys that texts of more than one class have, written."""
    several = rows.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("key")
    return written(rows.join(several, "key", "left_semi"))


def printed(texts: DataFrame) -> DataFrame:
    """(u, v): every text of (th, fp), with the least text of its component of fingerprints, but for that one."""
    nodes = written(texts.groupBy("fp").agg(F.min("th").alias("least")))
    roots = components(ball_links(nodes)).withColumnRenamed("node", "fp")
    nodes = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    leads = nodes.groupBy("root").agg(F.min("least").alias("v"))
    return texts.join(nodes.join(leads, "root").select("fp", "v"), "fp").filter("th <> v").select(F.col("th").alias("u"), "v")


def links(texts: DataFrame) -> DataFrame:
    """(u, v): links between text hashes, by fingerprint or of similarity SIMILARITY at least; texts has th and text, once each."""
    ship(texts.sparkSession)
    texts = texts.select("th", F.col("text").cast("binary").alias("text"))
    made = written(texts.mapInArrow(_banded, "th long, n long, bands array<long>, fp long, counts binary"))
    rows = made.select("th", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    rows = written(rows.join(sizes, "key"))
    fame = rows.groupBy("th").agg(F.sum("of").alias("fame"))
    rows = written(rows.drop("of").join(fame, "th"))
    texts = written(texts.join(fame.select("th"), "th", "left_semi"))
    found = written(_near(_led(rows), texts).unionByName(printed(made.select("th", "fp"))))
    # a text without a link is a class of its own
    classes = components(found).toDF("th", "class")
    rest = _shared(rows.join(classes, "th", "left").withColumn("class", F.coalesce("class", "th")))
    return found.unionByName(_near(_crossing(rest, made), texts))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: the least doc_id, then the least text hash."""
    own = docs.select(F.xxhash64(text_of(docs)).alias("th"), docs["doc_id"].alias("d"), text_of(docs).alias("text"))
    texts = own.groupBy("th").agg(F.min(F.struct(F.col("d").isNull().alias("n"), F.col("d").alias("doc_id"))).alias("k"))
    texts = written(texts)
    # of each distinct text, the rows of its least doc_id stand for it
    one = own.join(texts, (own["th"] == texts["th"]) & own["d"].eqNullSafe(texts["k.doc_id"]), "left_semi")
    roots = components(links(written(one.select("th", "text").dropDuplicates(["th"])))).withColumnRenamed("node", "th")
    texts = texts.join(roots, "th", "left").withColumn("root", F.coalesce("root", "th"))
    best = texts.groupBy("root").agg(F.min(F.struct("k", "th")).alias("b"))
    return first_rows(docs, best.select("b.k.doc_id", "b.th"))
