"""Phrase collocations counted by minimal perfect hashing over Apriori-safe candidates.

Words that occur often enough get numbers, and texts become arrays of these numbers, with a
gap wherever a piece ends or a word is rare. A phrase of k + 1 words is a pair of phrases of
k words one word apart, so each further length works on pairs of numbers in three passes:

1. Bound. Mappers count hashed pairs; the sparse arrays are summed in a tree, by page of
   buckets. A pair whose bucket stays below the least count cannot reach it.
2. Candidates. The distinct pairs of frequent parts whose bucket reaches it: few more than are
   frequent. A minimal perfect hash (a cascade of bit arrays in which a key takes the first bit
   it has for itself; a bit's rank is its slot) is built over them, in numpy, with the keys
   stored by slot: a pair is a candidate only if the key at its slot is its own.
3. Counts. Mappers count slots with bincount, and the arrays are summed in a tree. The slots of
   frequent pairs are the numbers of the next length.

A pair's key holds the two numbers of its parts, so what a cut of a phrase needs is read by slot:
the counts of its first and last words and of its first and last pairs.

Memory is bounded: a hash holds ``max_slots`` keys at most, and more candidates go into several
hashes, with a pass of the encoded texts each. Words are compared by a 64-bit key; all words of
the input are checked for two with equal keys, and another seed is taken if there are any.

Defined cases: null and empty texts have no words; a null lang is 'und', as is a lang of that
name; equal rows count each; phrases that tie keep the order of their bytes; further columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_broadcast, documents, ship, text_of, written

#: Stands between pieces; it is no word, as it ends one.
GAP = b"."
BREAKS = bytes.maketrans(b",;:!?\n\x0b\f\r", GAP * 9)
#: Bytes of a text that are split at a time.
PART = 1 << 20
#: Different words that a task counts or remembers at a time; it changes no result.
WORDS = 100_000
#: Keys that a mapper gathers before it sorts them.
FLUSH = 1 << 19
#: Values of a batch's lists that are worked on together; their arrays are copied several times over.
SLICE = 1 << 17
#: Slots whose counts travel as one row.
CHUNK = 13
#: Shares in which a language's phrases are ranked first.
SHARES = 32
#: Branches of the tree in which arrays are summed.
BRANCHES = 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer (multiplications and shifts by splitmix64's fixed values)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to the slots 0 to n - 1; other keys to -1."""

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        words, self.sizes, rest = [], [], keys
        while rest.size:
            if len(self.sizes) == 64:
                raise ValueError("keys repeat")
            size = -(-int(load * rest.size) // 64) * 64 or 64
            at = (_mixed(rest, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            rest = rest[~alone[at]]
        self.bits = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.keys = np.zeros(keys.size, np.int64)
        self.keys[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            held = self.bits[word] >> bit
            hit = (held & np.uint64(1)).astype(bool)
            lower = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(lower))[hit]
            left = left[~hit]
            base += size >> 6
            if not left.size:
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A key's slot if the key stored there is its own, else -1."""
        out = self._slots(keys)
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out


def _rows(batches: Iterable[pa.RecordBatch], column: str, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat values and offsets of a list column, a slice of a batch or a whole one at a time."""
    for b in batches if whole else _slices(batches, column):
        lists = b.column(column)
        offsets = lists.offsets.to_numpy()
        yield lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows of batches in groups of about SLICE values of a list column, a long row by itself."""
    for b in batches:
        offsets, at = b.column(column).offsets.to_numpy(), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield b.slice(at, stop - at)
            at = stop


def _pairs(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of the pair that begins at each place, or -1: at a gap, and at the last place of a row."""
    after = np.append(ids[1:], -1)
    after[offsets[1:][np.diff(offsets) > 0] - 1] = -1
    return np.where((ids >= 0) & (after >= 0), ids << 32 | after, -1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The pairs' keys of a partition, in arrays of about FLUSH."""
    held, n = [], 0
    for ids, offsets in _rows(batches, "ids"):
        keys = _pairs(ids, offsets)
        held.append(keys[keys >= 0])
        n += held[-1].size
        if n >= FLUSH:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


TALLY = "chunk long, branch int, at binary, n binary"


def _tally(places: np.ndarray, counts: np.ndarray, bits: int, branch: int) -> Iterator[pa.RecordBatch]:
    """Ascending places and their counts, as a row for each chunk of 2^bits places."""
    chunks, starts = np.unique(places >> bits, return_index=True)
    ends = [*starts[1:].tolist(), places.size]
    at = places & ((1 << bits) - 1)
    rows = [_packed(at[a:b], counts[a:b], bits) for a, b in zip(starts.tolist(), ends)]
    columns = [pa.array(chunks, pa.int64()), pa.array(np.full(chunks.size, branch), pa.int32()), *(pa.array(list(c), pa.binary()) for c in zip(*rows))]
    yield pa.RecordBatch.from_arrays(columns, ["chunk", "branch", "at", "n"])


def _packed(at: np.ndarray, n: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Places of a chunk and their counts, in the fewest bytes that hold them all."""
    size = next(s for s in (1, 2, 4, 8) if n.size == 0 or int(n.max()) < 1 << 8 * s)
    return at.astype("<u2" if bits <= 16 else "<u4").tobytes(), n.astype(f"<u{size}").tobytes()


def _unpacked(at: bytes, n: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(at, "<u2" if bits <= 16 else "<u4")
    size = len(n) // max(1, places.size)
    return places.astype(np.int64), np.frombuffer(n, f"<u{size or 1}").astype(np.int64)


def _tree_sum(tallies: DataFrame, bits: int, least: int) -> DataFrame:
    """(chunk, at, n): counts of all mappers summed, branch by branch and then across; those of ``least`` or more."""

    def summed(keep: int):
        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(1 << bits, np.int64)
            for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist()):
                places, counts = _unpacked(at, n, bits)
                total[places] += counts  # places of one array are distinct
            at = np.flatnonzero(total >= keep)
            first = [[group.column(c)[0].as_py()] for c in ("chunk", "branch")]
            return pa.table([*first, *([x] for x in _packed(at, total[at], bits))], schema=pa.schema([("chunk", pa.int64()), ("branch", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

        return add

    branches = tallies.groupBy("chunk", "branch").applyInArrow(summed(1), TALLY)
    return branches.groupBy("chunk").applyInArrow(summed(max(1, least)), TALLY).select("chunk", "at", "n")


def _branch() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) % BRANCHES


def _spread(keys: np.ndarray, width: int) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(64 - width)).astype(np.int64)


def _safe_pairs(seqs: DataFrame, total: int, least: int, max_slots: int) -> DataFrame:
    """(key) of the distinct pairs that may occur ``least`` times, written; total: pairs at most."""
    width = min(38, max(16, total.bit_length()))
    page = max(16, width - 16)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _gathered(batches):
            yield from _tally(*np.unique(_spread(keys, width), return_counts=True), page, _branch())

    # pages of the buckets that reach the least count
    each = 2 if page <= 16 else 4  # bytes of a place
    safe = written(_tree_sum(seqs.mapInArrow(bound, TALLY), page, least).select("chunk", "at", (F.octet_length("at") / each).cast("long").alias("n")))
    sizes = safe.select("chunk", "n").orderBy("chunk").collect()  # a page stands for 2^16 buckets or more
    ranges, size = [], max_slots + 1
    for chunk, n in sizes:
        if size + n > max_slots:
            ranges.append([chunk, chunk])
            size = 0
        ranges[-1][1] = chunk
        size += n
    found = []
    for low, high in ranges:
        rows = safe.filter(F.col("chunk").between(low, high)).select("chunk", "at").collect()
        buckets = np.sort(np.concatenate([(r["chunk"] << page) + _unpacked(r["at"], b"", page)[0] for r in rows]))
        held = seqs.sparkSession.sparkContext.broadcast(buckets)  # max_slots and a page at most

        def candidates(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for keys in _gathered(batches):
                keys = np.unique(keys)
                spread = _spread(keys, width)
                at = np.minimum(np.searchsorted(held.value, spread), held.value.size - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[held.value[at] == spread])], ["key"])

        found.append(written(seqs.mapInArrow(candidates, "key long").distinct()))
        held.unpersist()
    return reduce(DataFrame.unionByName, found) if found else seqs.sparkSession.createDataFrame([], "key long")


class Slots:
    """A table of distinct keys as perfect hashes of at most about max_slots keys, each built in one task."""

    def __init__(self, keys: DataFrame, max_slots: int):
        n = keys.count()
        parts = -(-n // max_slots)

        def build(group: pa.Table) -> pa.Table:
            own = PerfectHash(group.column("key").to_numpy())
            return pa.table({"part": [group.column("part")[0].as_py()], "n": pa.array([own.keys.size], pa.int64()), "hash": [pickle.dumps(own)]})

        dealt = keys.select(F.pmod(F.xxhash64("key"), F.lit(max(1, parts))).alias("part"), "key")
        self.table = written(dealt.groupBy("part").applyInArrow(build, "part long, n long, hash binary"))
        self.spark, self.bases, base = keys.sparkSession, {}, 0
        for part, size in sorted(map(tuple, self.table.select("part", "n").collect())):
            self.bases[part] = base
            base += size
        self.size = base

    def each(self) -> Iterator[tuple]:
        """(number of the first slot, broadcast hash) of each part, one at a time in memory."""
        for part, base in self.bases.items():
            held = self.spark.sparkContext.broadcast(pickle.loads(self.table.filter(F.col("part") == part).first()["hash"]))
            yield base, held
            held.unpersist()


def _pair_numbers(seqs: DataFrame, slots: Slots, frequent: DataFrame) -> DataFrame:
    """(ids): for each place of the arrays ``ids`` the number of the pair that begins there, if it is in ``frequent`` (id), else -1."""
    rows = seqs.select("ids", F.lit(None).cast("array<int>").alias("out"))
    for base, held in slots.each():
        size = held.value.keys.size
        mask = np.zeros(size, bool)
        for b in frequent.filter(F.col("id").between(base, base + size - 1)).select("id").toArrow().to_batches():  # the hash's slots at most
            mask[b.column("id").to_numpy() - base] = True
        keep = seqs.sparkSession.sparkContext.broadcast(np.packbits(mask))

        def fill(batches: Iterator[pa.RecordBatch], base=base, held=held, keep=keep) -> Iterator[pa.RecordBatch]:
            kept = np.unpackbits(keep.value, count=held.value.keys.size).astype(bool)
            for b in _slices(batches, "ids"):
                values, offsets = next(_rows([b], "ids", whole=True))
                keys = _pairs(values, offsets)
                out = np.full(keys.size, -1, np.int32)
                at = np.flatnonzero(keys >= 0)
                got = held.value.slots(keys[at])
                own = got >= 0
                own[own] = kept[got[own]]
                out[at[own]] = got[own] + base
                if base:  # not the first hash
                    out = np.maximum(out, next(_rows([b], "out", whole=True))[0]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept_columns), lists], [*kept_columns, "out"])

        kept_columns = ["ids"] if len(slots.bases) > 1 else []
        rows = written(rows.mapInArrow(fill, ", ".join([*(f"{c} array<int>" for c in kept_columns), "out array<int>"])))
        keep.unpersist()
    return rows.select(F.col("out").alias("ids"))


def frequent_pairs(seqs: DataFrame, total: int, least: int, max_slots: int) -> tuple[Slots, DataFrame]:
    """The slots of all candidates, and (id, x, y, f) of the pairs (x, y) that occur ``least`` times or more in arrays of numbers."""
    slots = Slots(_safe_pairs(seqs, total, least, max_slots), max_slots)
    found = []
    for base, held in slots.each():

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            size = held.value.keys.size
            counts = np.zeros(size, np.int64)
            for keys in _gathered(batches):
                at = held.value.slots(keys)
                counts += np.bincount(at[at >= 0], minlength=size)
            at = np.flatnonzero(counts)
            if at.size:
                yield from _tally(at, counts[at], CHUNK, _branch())

        def listed(batches: Iterator[pa.RecordBatch], held=held, base=base) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, at, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "at", "n"))):
                    places, counts = _unpacked(at, n, CHUNK)
                    slot = (chunk << CHUNK) + places
                    key = held.value.keys[slot]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot + base, key >> 32, key & 0xFFFFFFFF, counts)], ["id", "x", "y", "f"])

        sums = _tree_sum(seqs.mapInArrow(count, TALLY), CHUNK, least)
        found.append(written(sums.mapInArrow(listed, "id long, x long, y long, f long")))
    empty = seqs.sparkSession.createDataFrame([], "id long, x long, y long, f long")
    return slots, reduce(DataFrame.unionByName, found) if found else empty


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, with a GAP where a piece ends; a long text comes in parts."""
    text = text.lower().translate(BREAKS).replace(GAP, b" %b " % GAP)  # bytes: A-Z only
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + PART) if len(text) - at > PART else -1
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()  # blanks and tabs: other white space has become gaps
        at = stop


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), text_of(docs).cast("binary").alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(GAP, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text")):  # a row at a time
            for tokens in _tokens(text.as_py()):
                counts.setdefault(lang.as_py(), Counter()).update(tokens)
                if sum(map(len, counts.values())) > WORDS:
                    yield from emptied()
    yield from emptied()


def _word_key(seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed} ".encode()), F.encode("lang", "utf-8"), F.lit(b"\0"), "word"))


def _encoded(texts: DataFrame, slots: Slots, seed: int) -> DataFrame:
    """(ids): for each text the numbers of its words, -1 for a gap and a word without one.

    A word's number is looked up once and remembered, for as many words as memory is given. Each
    hash is a pass; what one finds is laid over what those before have found.
    """
    rows = texts.withColumn("out", F.lit(None).cast("array<int>"))
    for base, held in slots.each():

        def fill(batches: Iterator[pa.RecordBatch], base=base, held=held) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = {}

            def numbers(texts: list[tuple[str, list[bytes]]]) -> list[np.ndarray]:
                if sum(map(len, known.values())) > WORDS:
                    known.clear()
                for lang in {lang for lang, _ in texts}:
                    own = known.setdefault(lang, {GAP: -1})
                    new = list({t for k, tokens in texts if k == lang for t in tokens if t not in own})
                    prefix = f"{seed} {lang}\0".encode()
                    got = held.value.slots(np.array([xxh64_intdigest(prefix + t, 42) for t in new], np.uint64).view(np.int64))
                    own.update(zip(new, np.where(got >= 0, got + base, -1).tolist()))
                return [np.fromiter(map(known[lang].__getitem__, tokens), np.int32, len(tokens)) for lang, tokens in texts]

            for b in batches:
                ids, ends, at, waiting, size = [], [0], 0, [], 0
                for i in range(b.num_rows):
                    lang = b.column("lang")[i].as_py()
                    for tokens in _tokens(b.column("text")[i].as_py()):  # a long text comes in parts
                        waiting.append((lang, tokens))
                        size += len(tokens)
                        if len(tokens) > SLICE // 4:
                            ids += numbers(waiting)
                            waiting = []
                    ends.append(size)
                    if size >= SLICE or i == b.num_rows - 1:
                        part, out = b.slice(at, i + 1 - at), np.concatenate([np.zeros(0, np.int32), *ids, *numbers(waiting)])
                        if base:  # not the first hash
                            out = np.maximum(out, next(_rows([part], "out", whole=True))[0]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))], [*kept, "out"])
                        ids, ends, at, waiting, size = [], [0], i + 1, [], 0

        kept = ["lang", "text"] if len(slots.bases) > 1 else []
        rows = written(rows.mapInArrow(fill, ", ".join([*(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept), "out array<int>"])))
    return rows.select(F.col("out").alias("ids"))


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    a, l, r = (f"cast({c} as decimal(19, 0))" for c in (a, l, r))  # noqa: E741
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {a} * {a}) div ({l} * {r})")


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, max_slots: int = 1 << 22) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two or three words that occurs ``least`` times in its
    language and that no longer candidate with ``cover`` percent of its occurrences holds."""
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs)
    words = written(texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    seed = 0
    while words.groupBy(_word_key(seed)).agg(F.count(F.lit(1)).alias("c"), F.max("f").alias("f")).filter((F.col("c") > 1) & (F.col("f") >= least)).limit(1).count():
        seed += 1
    often = words.filter(F.col("f") >= least).withColumn("key", _word_key(seed))
    slots = Slots(often.select("key"), max_slots)
    seqs = _encoded(texts, slots, seed)
    numbers = often.join(_slot_ids(often.select("key"), slots), "key").select("id", "lang", F.col("word").cast("string").alias("word"), "f")
    numbers = written(numbers)
    total = numbers.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]

    slots, pairs = frequent_pairs(seqs, total, least, max_slots)
    small = bounded_broadcast(numbers, 200_000)
    first, second = small.select(F.col("id").alias("x"), "lang", F.col("word").alias("w1"), F.col("f").alias("l")), small.select(F.col("id").alias("y"), F.col("word").alias("w2"), F.col("f").alias("r"))
    two = written(pairs.join(first, "x").join(second, "y").select("id", "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "w2", F.col("f").alias("a"), "l", "r"))

    total = two.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    _, triples = frequent_pairs(_pair_numbers(seqs, slots, pairs), total, least, max_slots)
    small = bounded_broadcast(two, 200_000)
    head = small.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("p"), F.col("l").alias("l1"), F.col("a").alias("l2"))
    tail = small.select(F.col("id").alias("y"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    three = triples.join(head, "x").join(tail, "y")
    # the lowest score counts, of equal ones the earliest cut
    cuts = F.least(*[F.struct(_score("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    three = written(three.select("x", "y", "lang", F.concat_ws(" ", "p", "w3").alias("phrase"), F.col("f").alias("a"), cuts.alias("c")))

    longest = three.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
    two = two.join(longest, "id", "left").filter((100 * F.coalesce("most", F.lit(0))) < (cover * F.col("a")))
    both = two.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    both = both.unionByName(three.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    return both.join(bounded_broadcast(sizes, 100_000), "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def _slot_ids(keys: DataFrame, slots: Slots) -> DataFrame:
    """(key, id) of keys that the slots hold."""
    found = []
    for base, held in slots.each():

        def number(batches: Iterator[pa.RecordBatch], held=held, base=base) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column("key").to_numpy()
                at = held.value.slots(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at >= 0]), pa.array(at[at >= 0] + base)], ["key", "id"])

        found.append(written(keys.mapInArrow(number, "key long, id long")))
    return reduce(DataFrame.unionByName, found) if found else keys.sparkSession.createDataFrame([], "key long, id long")


def top_phrases(found: DataFrame, most: int = 2000) -> DataFrame:
    """found with rank: each language's first ``most`` by score, occurrences and phrase."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language is no single task: the first of each share of it, then the first of those
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(phrases(documents(spark, sf_dir))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT rid, lang, unnest(p) AS piece, unnest(range(len(p))) AS pi
  FROM (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
        FROM documents)
), w1 AS (
  SELECT rid, lang, pi, unnest(w) AS a, unnest(range(len(w))) AS wi
  FROM (SELECT rid, lang, pi, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)
), w3 AS (
  SELECT lang, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM w1 WINDOW s AS (PARTITION BY rid, pi ORDER BY wi)
), sizes AS (SELECT lang, count(*) AS n FROM w3 GROUP BY 1),
f1 AS (SELECT lang, a, count(*) AS f FROM w3 GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM w3 WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM w3 WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
two AS (
  SELECT f2.lang, f2.a, f2.b, f2.f, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
), three AS (
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f, x.l AS l1, y.f AS r1, x.f AS l2, y.r AS r2,
         (1000000::HUGEINT * f3.f * f3.f) // (x.l::HUGEINT * y.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * y.r) AS s2
  FROM f3 JOIN two x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN two y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
), covers AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL
), found AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, t.l, t.r, t.score
  FROM two t LEFT JOIN covers v ON v.lang = t.lang AND v.a = t.a AND v.b = t.b WHERE v.f IS NULL OR 100 * v.f < 50 * t.f
  UNION ALL
  SELECT lang, phrase, f, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
